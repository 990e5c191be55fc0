"""HTML extraction: the distribution decides, names rule out no article text, and all pages agree with a plain version."""

import html
import re
import time

import duckdb
import pytest

from termweave.llm import htmltext, queries

LOREM = "Some long sentence of the main text that goes on for a while. "


def test_the_distribution_decides_without_marks(monkeypatch):
    page = f"<div>Notice</div>{'<div><a href=x>one</a></div>' * 4}<h2>Title</h2><p>{LOREM}</p><p>Short.</p><p>{LOREM}</p>{'<hr><div><a>more</a></div>' * 4}<div>Imprint</div>"
    assert htmltext.main_text(page).split("\n") == ["Title", LOREM.strip(), "Short.", LOREM.strip()]
    monkeypatch.setattr(htmltext, "stretches", lambda lengths, window=3: [(0, len(lengths), sum(lengths))])
    assert "Imprint" in htmltext.main_text(page)


def test_the_distribution_decides_among_articles(monkeypatch):
    cards = "".join(f"<article><h3>Card {k}</h3></article>" for k in range(4))
    page = f"<main><h1>Head</h1><article><p>{LOREM * 3}</p><p>End.</p></article>{cards}</main>"
    assert htmltext.main_text(page) == f"Head\n{(LOREM * 3).strip()}\nEnd."
    monkeypatch.setattr(htmltext, "stretches", lambda lengths, window=3: [(0, len(lengths), sum(lengths))])
    assert "Card 2" in htmltext.main_text(page)


def test_stretches_against_their_definition():
    for lengths in ([], [0, 0], [5], [0, 3, 0, 0, 4, 0, 0, 0, 2], [1, 0, 0, 0, 1], [0, 0, 0, 7, 7, 0, 0, 1]):
        windows = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
        want, run = [], []
        for i, w in enumerate([*windows, 0]):
            if w:
                run.append(i)
            elif run:
                full = [k for k in run if lengths[k]]
                want.append((full[0], full[-1] + 1, max(windows[k] for k in run)))
                run = []
        assert htmltext.stretches(lengths) == want


@pytest.mark.parametrize("block", [
    '<h2 id="related-work">Related work</h2>', '<section id="search-methods"><p>Related work</p></section>', '<p class="side-effects">Related work</p>', '<p class="notice">Related work</p>',
    '<div class="comments-on-method">Related work</div>', '<div id="shared">Related work</div>', '<h3 class="header">Related work</h3>', "<header><p>Related work</p></header>",
])
def test_names_keep_article_text(block):
    assert htmltext.main_text(f"<article><p>One.</p>{block}<p>Two.</p></article>") == "One.\nRelated work\nTwo."


@pytest.mark.parametrize("block", [
    '<div class="ad">x</div>', '<div class="post ad-box-2">x</div>', '<div id="comments"><p>x</p></div>', '<section class="commentList"><p>x</p></section>', '<div class="cookie_banner">x</div>',
    '<aside>x</aside>', '<footer>x</footer>', '<div role="navigation">x</div>', '<ul class="share-buttons"><li>x</li></ul>', '<form><p>x</p></form>', "<nav>x</nav>", "<script>x</script>", "<!-- x -->",
    '<article class="comment"><p>x</p></article>', '<div class="site-footer">x</div>',
])
def test_what_is_no_article_goes(block):
    for page in (f"<article><p>{LOREM}</p>{block}<p>Two.</p></article>", f"{block}<article><p>{LOREM}</p><p>Two.</p></article>{block}", f"<body>{block}<p>{LOREM}</p><p>Two.</p></body>"):
        assert htmltext.main_text(page) == f"{LOREM.strip()}\nTwo."


def test_blocks_stay_whole_and_all_stay():
    assert htmltext.main_text('<article><p>a <span class="ad">x</span>b <a href=y>c</a></p></article>') == "a b c"
    gaps = "<aside>x</aside>" * 6
    assert htmltext.main_text(f"<article><p>a</p>{gaps}<p>b</p>{gaps}<p>c</p></article>") == "a\nb\nc"
    assert htmltext.main_text(f"<p>{LOREM}</p>{gaps}<p>{LOREM}</p>").count("\n") == 1
    assert htmltext.main_text(f"<form><div><p>{LOREM}</p></div><input></form><footer>x</footer>") == LOREM.strip()
    assert htmltext.main_text("<article><p>a</p></article><article><p>b</p></article>") == "a"
    assert htmltext.main_text("<body><p>tiny</p></body>") == "tiny"


def test_time_is_linear_in_nesting():
    def took(n):
        began = time.perf_counter()
        htmltext.main_text('<div class="sidebar"><h2>x</h2>' * n + "text" + "</div>" * n + "<div>" * n + "</p>" * n)
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 12 * min(took(1000) for _ in range(3)) + 0.2


def test_query_on_all_pages(spark):
    def plain(page):
        inner = re.sub(r"<br\s*/?>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner))
        return "\n".join(x for x in blocks if x)

    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{folder}/pages.parquet'").fetchall()
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in queries.op5_html_extraction(spark, folder).collect()}
    assert got == {(i, u, plain(h), len(plain(h))) for i, u, h in rows}
