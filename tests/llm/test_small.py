"""Operators without Spark, against plain versions."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import ann, bpe, decontam, htmltext, langid, lmscore, simhash, substringdedup, urlfilter, wordspans

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.text(alphabet=st.sampled_from("ab CD\t\n.é中😀,!'1"), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8))
def test_words_and_hashes(texts):
    w = wordspans.words(pa.array(texts, pa.string()))
    got = [(int(d), w.bytes[a:b].tobytes()) for d, a, b in zip(w.doc, w.starts, w.ends)]
    want = [(i, x) for i, t in enumerate(texts) for x in (t or "").encode().lower().split()]
    assert got == want
    h = dict(zip((x for _, x in got), w.hashes().tolist()))
    assert len(set(h.values())) == len(h) and [h[x] for _, x in got] == w.hashes().tolist()


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    look = wordspans.Lookup(keys, np.arange(len(keys), dtype=np.int32))
    assert (look(keys) == np.arange(len(keys))).all() and (look(keys + np.uint64(1)) < 0).sum() >= len(keys) - 5
    assert (wordspans.Lookup(keys[:0], np.zeros(0, np.int32))(keys[:9]) < 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS, st.text(max_size=30)), max_size=6))
def test_bpe_equals_the_library(texts):
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == ref.encode_ordinary(t or "") and c.decode(ids) == (t or "").encode()


def test_bpe_long_pieces():
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(1)
    texts = ["a" * 5000, "".join(r.choice("abcdefgh") for _ in range(4000)), "é" * 900, "".join(r.choice("ehtin") for _ in range(1000))]
    assert [x.tolist() for x in c.encode(texts)] == [ref.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("http://A.Example.com:80/en/7?x#y", "a.example.com:80", "/en/7"), ("https://h#/x", "h", ""), ("https://h?a://b", "h", ""), ("x://É.com/a://b", "É.com", "/a://b"),
        (None, "", ""), ("no scheme/en/", "", ""), ("://h/p", "h", "/p"), ("", "", ""),
    ],
)
def test_url_parts(url, host, path):
    assert urlfilter.parts(url) == (host, path)


def unwanted(*urls):
    return urlfilter.probabilities(urlfilter.default_model(), *zip(*map(urlfilter.parts, urls)))


def test_url_model_separates_its_kinds():
    bad = ["cheap-pills.example.net", "casino-win.example.org", "free-bets.example.com", "ads-track.example.net", "spam-phish.example.org", "adult-x.example.com", "malware-phish.net", "dating-lottery.example.com", "hotgirls.net"]
    assert (unwanted(*[f"http://{h}{p}" for h in bad for p in ("/en/1", "/de/77.html", "/")]) > 0.5).all()
    assert (unwanted(*[f"http://{h}/fr/12" for h in ("ththre.example.com", "www.library.org", "therin.example.net", "news.university.edu", "blog.farm.org")]) < 0.5).all()
    assert urlfilter.train([])[1] == 0


def test_url_model_on_words_it_has_not_seen():
    """Each word held out in turn of a fifth: without its grams a host is judged by parts it shares with others."""
    labels, right = urlfilter.default_labels(), []
    for k in range(0, 5):
        out = set(urlfilter.UNWANTED[k::5]) | set(urlfilter.WANTED[k::5])
        rest = [(u, y) for u, y in labels if not any(w in urlfilter.parts(u)[0] for w in out)]
        model = urlfilter.train(rest, rounds=400)
        bad, good = ([f"http://{w}.example.com/en/5" for w in words[k::5]] for words in (urlfilter.UNWANTED, urlfilter.WANTED))
        p = urlfilter.probabilities(model, *zip(*map(urlfilter.parts, bad + good)))
        right += [(y, x > 0.5) for x, y in zip(p, [True] * len(bad) + [False] * len(good))]
    clean = [r for y, r in right if not y]
    print("caught", np.mean([r for y, r in right if y]), "blocked of wanted", np.mean(clean))
    assert np.mean(clean) < 0.5


def test_url_features_one_by_one_and_together():
    hosts, paths = ["a.b", "", "ex.org", "é.de", "a" * 5000], ["/x", "", "/x", "/ü", "/" * 3000]
    row, at, value = urlfilter.features(hosts, paths)
    for k in range(len(hosts)):
        r, a, v = urlfilter.features(hosts[k : k + 1], paths[k : k + 1])
        assert sorted(zip(at[row == k].tolist(), value[row == k].tolist())) == sorted(zip(a.tolist(), v.tolist())) and set(r.tolist()) <= {0}


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p><p>x";</script></head><body><nav><a href="/">Home</a></nav>
<header>Site</header><div class="ad">Buy</div><div id="cookie-notice">We use</div><article><h1>Title &amp; more</h1><p><b>One<br>two&nbsp;three</b></p><p>Short.</p>
<form><input>Sign</form><div class="comments"><p>me too</p></div></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html_main_text():
    assert htmltext.main_text(PAGE) == "Title & more\nOne two three\nShort."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p>") == ""
    assert htmltext.main_text("<article><p>open <p>next") == "open\nnext"
    assert htmltext.main_text("plain &lt;b&gt; text") == "plain <b> text"
    bare = "<body><ul class=menu><li>a</li></ul><div><p>" + "long text " * 30 + "</p><p>tail</p></div></body>"
    assert htmltext.main_text(bare) == ("long text " * 30).strip() + "\ntail"
    assert len(htmltext.main_text("<article>" + "<p>x y</p>" * 5000 + "</article>").split("\n")) == 5000


def slow_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=6), st.sampled_from([1, 3, 5]))
def test_fingerprints(texts, size):
    assert simhash.fingerprints(pa.array(texts, pa.string()), size).tolist() == [slow_fingerprint(t, size) for t in texts]


def test_any_two_bits_are_masked_by_some_table():
    masks = [set(bits) for bits in simhash.lines()]
    assert all(any({a, b} <= m for m in masks) for a in range(64) for b in range(64))
    assert sum(map(len, masks)) == 64 * len(simhash.LINE)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontam.common(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


def test_latent_space_is_that_of_the_exact_decomposition():
    r = np.random.default_rng(3)
    counts = r.poisson(0.3, (400, 60)).astype(float) + np.outer(r.poisson(1, 400), r.random(60) < 0.2)
    omega = r.standard_normal((60, decontam.RANK + decontam.EXTRA))
    df = (counts > 0).sum(0)
    space = decontam.latent(400, df, counts.T @ (counts @ omega), omega, rank=1)
    idf = np.log(401 / (1 + df)) + 1
    _, _, v = np.linalg.svd(counts * idf, full_matrices=False)
    assert abs((space[:, 0] / idf) @ v[0]) > 0.99


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b" ab"]
    prob = np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.25]])
    p = dict(zip(pieces, prob[:, 0]))

    def total(word):
        return sum(p[x] * total(word[len(x) :]) for x in pieces if word.startswith(x)) if word else 1.0

    rows = np.frombuffer(b" abab", np.uint8)[None]
    assert langid.forward(langid.Pieces(pieces).lattice(rows), 1, 5, prob)[-1][0, 0] == pytest.approx(total(b" abab"))


def test_language_edge_cases():
    model = langid.fit([("xx", "abc abd " * 9), ("yy", "zzy zyx " * 9)], langid.load_pieces(PATH))
    lang, score = langid.Scorer(model)(pa.array(["abc", "ZZY zyx", None, "", "12 ... 中", "3 !", "q" * 5000]))
    assert lang[:4] == ["xx", "yy", "und", "und"] and lang[5] == "und" and lang[4] != "und" and score[2] == score[5] == 0
    assert ((score >= 0) & (score <= 1)).all()
    lang, score = langid.Scorer(langid.fit([], langid.load_pieces(PATH)))(pa.array(["abc"]))
    assert lang == ["und"] and score[0] == 0


def test_bloom_levels():
    r = np.random.default_rng(1)
    key, level = r.integers(0, 2**63, 3000, dtype=np.uint64) | np.uint64(1), r.integers(1, 9, 3000)
    data = lmscore.build(key, level)
    f = lmscore.Filter.of({1: len(data)}, [(1, data)], 2)
    got = f.level(key)
    assert (got >= level).all() and (got > level).mean() < 0.02
    other = r.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (f.level(other | np.uint64(1)) > 0).mean() < 0.01 and (f.level(other & ~np.uint64(1)) == 0).all()


def test_levels_hold_what_they_say():
    c = np.arange(1, 5000)
    level = lmscore.levels(c)
    least = lmscore.least(level)
    assert (least <= c).all() and (c < 1.5 * least + 1).all() and (np.diff(level) >= 0).all()
    assert lmscore.least(lmscore.levels(np.array([1, 2, 3]))).tolist() == [1, 2, 3]


def test_tokens_end_each_text():
    h, before, row = lmscore.tokens(pa.array(["a b", None, "A"]))
    assert row.tolist() == [0, 0, 0, 1, 2, 2] and h[[2, 3, 5]].tolist() == [int(lmscore.END)] * 3
    assert before[[0, 3, 4]].tolist() == [int(lmscore.START)] * 3 and h[0] == h[4] == before[1]


def test_spans_do_not_depend_on_surroundings():
    r = random.Random(5)
    passage = " ".join("".join(r.choice("abcdefg") for _ in range(5)) + ("." if k % 9 == 8 else "") for k in range(60))
    found = []
    for text in ("x y z " + passage + " q", passage, "one two three. " + passage + " more words here."):
        found.append({h for *_, s in substringdedup._cut(pa.array([text]), 20) for h in s.tolist()})
    assert found[0] & found[1] and found[0] & found[2]


def test_spans_of_a_batch_take_bounded_memory():
    r = random.Random(6)
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", ".", "\n"]) for _ in range(3000)]
    texts = [" ".join(r.choices(names, k=350)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([0] * 2000, pa.int64()), pa.array(texts)], names=["doc", "text_hash", "text"])
    tracemalloc.start()
    for _ in substringdedup._find(20)(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * batch.nbytes


def test_hashes_do_not_depend_on_how_many_are_made_at_once(monkeypatch):
    w = wordspans.words(pa.array(["one two\nthree " + "long" * 40, None, "", "é 中 two " + "x" * 9]))
    want = w.hashes()
    for part in (1, 7, 20, 1 << 20):
        monkeypatch.setattr(wordspans, "PART", part)
        assert w.hashes().tolist() == want.tolist()
    assert want[1] == want[6] and not len(wordspans.words(pa.array([None, ""], pa.string())).hashes())


def test_hadamard_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 48))
    y = ann.rotate(x, 2)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and y.shape == (5, 64)


def test_answers():
    assert decontam.answer_of("What is it? The first of five words.").strip() == "The first of five words."
    assert "Why" in decontam.answer_of("Why? So.") and decontam.answer_of("") == ""


def test_bitmaps_never_rule_out_what_is_near():
    r = random.Random(12)
    for trial in range(300):
        n = r.choice([1, 2, 5, 40, 300, 2000])
        base = [f"w{r.randrange(10 * n)}" for _ in range(n)]
        other = [w for w in base if r.random() > 0.05] + [f"x{k}" for k in range(int(n * r.random() * 0.3))]
        p = simhash.profiles(pa.array([" ".join(base), " ".join(other)]), 5, 0.8, 2, np.zeros(0, np.uint64), np.zeros(0, np.int64)).to_pylist()
        sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in (base, other)]
        assert [x["n"] for x in p] == [len(s) for s in sets]
        differ = len(sets[0] ^ sets[1])
        assert simhash.least_difference(p[0]["bits"], p[1]["bits"]) <= differ
        both, either = len(sets[0] & sets[1]), len(sets[0] | sets[1])
        if either and both >= 0.8 * either:
            assert simhash.may_be_near(p[0]["bits"], p[1]["bits"], p[0]["n"], p[1]["n"], 0.8)
            assert {*p[0]["rare"]} & {*p[1]["rare"]}
    assert not simhash.may_be_near(*[x["bits"] for x in simhash.profiles(pa.array([" ".join(f"a{k}" for k in range(200)), " ".join(f"b{k}" for k in range(200))]), 5, 0.8, 2, np.zeros(0, np.uint64), np.zeros(0, np.int64)).to_pylist()], 196, 196, 0.8)
