"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, and over the lines' text lengths slide windows of ``WINDOW``
lines. Where a window's sum leaves zero the text surges, where it falls back to zero it dives; the lines between are a
stretch. Text of elements that hold no article text by their kind, by their role, or by an exact class or id, has length
zero and is never kept; text of links has length zero unless an article is marked around it, so menus make no surge.
Where the page marks articles, ``WINDOW`` empty lines stand at the borders of each, and the article whose stretches have
the most text is kept with what else its main element holds, of further articles there those with ``SHARE`` of its
text. Where it marks none, stretches in which some window reaches ``SURGE`` characters are kept, or the largest if none.

Defined cases: null and empty html give an empty text; unclosed elements end where their parent or the page ends; of
equal articles the first counts; repeated rows give the same text; time is linear in a page's length, however its
elements are nested. Other columns of the input stay out of the result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SHARE = 0.25
SURGE = 40

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe textarea title xmp noembed noframes".split()
NO_TEXT = frozenset("head nav footer aside form menu select button svg canvas object audio video dialog header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img ruby rb rt rp".split())
#: Elements that an open one of the same kind ends at, and those that no class or id rules out in an article.
SELF_ENDING = frozenset("p li dd dt tr td th option".split())
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre table figcaption".split())
#: Roles, and names in class or id, of what isn't the article; a name may stand between a place and parts.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
PLACES = "site page main top bottom left right global primary secondary user reader article entry post blog web mobile"
PARTS = "box container wrapper wrap area block section list item bar banner slot unit top bottom left right inner outer content notice consent popup panel message form links menu thread posts articles stories buttons widget media icons policy"
NAMES = (
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead topbar header cookie cookies gdpr notice notices disclaimer popup modal overlay comment comments commentlist reply replies respond disqus "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget widgets pagination pager toolbar banner banners alert alerts copyright consent"
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(f"(?:(?:{PLACES.replace(' ', '|')})-)?(?:{NAMES.replace(' ', '|')})(?:-(?:{PARTS.replace(' ', '|')}|{NAMES.replace(' ', '|')}|[0-9]+))*")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marks(attributes: str) -> tuple[set[str], bool]:
    """Words of role and itemprop, and whether a class or id names what isn't the article."""
    words, named = set(), False
    if "=" not in attributes:
        return words, named
    for m in MARK.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() in ("role", "itemprop"):
            words.update(value.lower().split())
        else:
            each = [CAMEL.sub("-", x).lower().replace("_", "-") for x in value.split()]
            words.update({"articlebody", "article-body"} & {*each})
            named = named or any(NAME.fullmatch(x) for x in each)
    return words, named


@dataclass(slots=True)
class Line:
    """text: of a block; length: its weight in the distribution; kept: whether no element rules it out; article, main: numbers of the innermost article and of the outermost marked element around it (0: none)."""

    text: str
    length: int
    kept: bool
    article: int
    main: int


def _matches(tokens: list[re.Match[str]]) -> list[int]:
    """For each token that opens an element the place of the one that closes it, or the number of tokens."""
    out, open_ = [len(tokens)] * len(tokens), {}
    for i, m in enumerate(tokens):
        if m[3] and not m[4].endswith("/"):
            tag = m[3].lower()
            if not m[2]:
                open_.setdefault(tag, []).append(i)
            elif open_.get(tag):
                out[open_[tag].pop()] = i
    return out


def lines_of(page: str) -> list[Line]:
    tokens = [m for m in TOKEN.finditer(page) if m[3] or m[5]]
    match = _matches(tokens)
    holds: list[int] = []  # tokens that begin an article or a first heading
    size = [0]  # characters of text before each token
    for i, m in enumerate(tokens):
        size.append(size[-1] + (len(m[5]) if m[5] else 0))
        if m[3] and not m[2]:
            tag = m[3].lower()
            if tag in ("h1", "article", "main") or "=" in m[4] and {"articlebody", "article-body", "main"} & _marks(m[4])[0]:
                holds.append(i)
    out: list[Line] = []
    words: list[str] = []
    linked = length = 0
    in_link = False
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # open elements: tag, ruled out, article, main
    counts: Counter[str] = Counter()
    number = 0

    def flush() -> None:
        nonlocal length, linked
        if words:
            _, off, article, main = stack[-1]
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                # the share of link text is taken before references are decoded; it only has to tell some from none
                own = len(text) if main else len(text) * (length - linked) // max(1, length)
                out.append(Line(text, 0 if off else own, not off, article, main))
            words.clear()
        length = linked = 0

    def excluded(i: int) -> bool:
        """Whether the element opened here may be ruled out: it is closed, and holds neither the article nor, as a form, most of the page."""
        end, inner = match[i], bisect_left(holds, i + 1)
        return end < len(tokens) and not (inner < len(holds) and holds[inner] < end) and not (tokens[i][3].lower() == "form" and 2 * (size[end] - size[i]) > size[-1])

    skip = 0
    for i, m in enumerate(tokens):
        if i < skip:
            continue
        if m[5]:
            words.append(m[5])
            n = len(m[5].strip())
            length += n
            linked += n * in_link
            continue
        tag = m[3].lower()
        if tag == "br":
            words.append(" ")
            continue
        if tag == "a":
            in_link = not m[2]
        marks, named = (set(), False) if m[2] else _marks(m[4])
        if tag in INLINE:
            if named and excluded(i):
                skip = match[i]
            continue
        if m[2]:
            if counts[tag]:
                flush()
                while True:
                    closed = stack.pop()[0]
                    counts[closed] -= 1
                    if closed == tag:
                        break
            else:
                flush()
            continue
        flush()
        if tag in VOID or m[4].endswith("/"):
            continue
        if tag in SELF_ENDING and stack[-1][0] == tag:
            stack.pop()
            counts[tag] -= 1
        _, off, article, main = stack[-1]
        if not off:
            ruled = tag in NO_TEXT and not (tag == "header" and article) or bool(marks & ROLES) or named and not (main and tag in TEXT)
            off = ruled and tag not in ("html", "body") and excluded(i)
            if not off and (tag in ("article", "main") or {"articlebody", "article-body", "main"} & marks):
                number += 1
                article, main = number, main or number
        if match[i] < len(tokens) or tag not in SELF_ENDING:
            stack.append((tag, off, article, main))
            counts[tag] += 1
    flush()
    return out


def bordered(lines: list[Line], window: int = WINDOW) -> list[Line]:
    """The lines with empty ones where an article begins or ends."""
    out: list[Line] = []
    for line in lines:
        if out and line.kept and line.article != out[-1].article:
            out += [Line("", 0, False, 0, 0)] * window
        out.append(line)
    return out


def stretches(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first, end, most) of the lines from each surge, where the window's sum leaves zero, to its dive, where it is zero again, trimmed to lines with a length; most: the largest window's sum."""
    total = [0]
    for n in lengths:
        total.append(total[-1] + n)
    out, first, last, most = [], -1, -1, 0
    for i in range(len(lengths)):
        here = total[min(i + window, len(lengths))] - total[i]  # of the window that begins at i
        if here:
            most = max(most, here)
            if lengths[i]:
                first, last = (i if first < 0 else first), i
        elif first >= 0:
            out.append((first, last + 1, most))
            first, most = -1, 0
    return out if first < 0 else [*out, (first, last + 1, most)]


def main_text(page: str | None) -> str:
    """The page's article, one line for each block."""
    lines = bordered(lines_of(page or ""))
    found = stretches([x.length for x in lines])
    size: Counter[int] = Counter()
    for a, b, _ in found:
        if lines[a].main:
            size[lines[a].article] += sum(x.length for x in lines[a:b])
    if size:
        best = max(size, key=lambda k: (size[k], -k))
        main = next(lines[a].main for a, _, _ in found if lines[a].article == best)
        # in its main element: its own lines, and articles of a like size
        found = [r for r in found if lines[r[0]].main == main and (lines[r[0]].article == main or size[lines[r[0]].article] >= SHARE * size[best])]
    else:
        least = min(SURGE, max((most for _, _, most in found), default=0))
        found = [r for r in found if r[2] >= least]
    return "\n".join(x.text for a, b, _ in found for x in lines[a:b] if x.kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; one pass, no shuffle."""
    rows = pages.select(pages[f"`{key}`"].alias("page_id"), pages[f"`{url}`"].alias("url"), pages[f"`{page}`"].alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
