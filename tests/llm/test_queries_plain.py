"""Queries that SQL can't express, over whole tables, against plain versions."""

import collections
import hashlib

import duckdb
import public_tokenizers
import pyarrow as pa
import tiktoken

from termweave.llm import bpe, queries, substringdedup, urlfilter, wordspans

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def documents(folder=SF):
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY 1").fetchall()


def test_byte_bpe(spark):
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.VOCABULARY)), special_tokens={})
    want = set()
    for i, t in documents(LARGER):
        ids = ref.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_byte_bpe(spark, LARGER).collect()} == want


def plain_rule(url):
    head, sep, rest = (url or "").partition("://")
    rest = rest if sep else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(-len(h + p), h + p, kind) for kind, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *min(fits)[1:]) if fits else (host, path, None, None)


def test_url_filter(spark):
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{LARGER}/pages.parquet'").fetchall())
    rows = queries.op4_url_filter(spark, LARGER).collect()
    assert {r.page_id for r in rows} == urls.keys() and len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_url_filter_on_long_repeated_and_tied(spark):
    urls = ["http://a.b.org/es/" + "x" * 200_000, "http://" + "h" * 100_000 + ".com/en/1", "http://x.com/en/", "http://x.com/en/", "http://X.COM?/en/", "://", "x://", "http://example.com/en/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert [got[i].rule for i in range(8)] == ["org/es/", "com/en/", "com/en/", "com/en/", None, None, None, "example.com/en/7"] and got[2].score == got[3].score
    tied = [("block", "com", "/ab"), ("allow", "x.com", "/")]
    assert urlfilter.judge(df.limit(3), rules=[("allow", "com", "/e"), ("block", "com", "/e")]).where("page_id = 2").first().rule == "com/e"
    assert len(tied[0][1] + tied[0][2]) == len(tied[1][1] + tied[1][2]) and urlfilter.judge(spark.createDataFrame([(1, "http://x.com/ab")], df.schema), rules=tied).first().rule == "com/ab"


def test_substring_dedup(spark):
    texts = [(i, t) for i, t in documents() if t is not None]
    spans, cut = collections.defaultdict(list), {}
    for i, t in texts:
        w = wordspans.words(pa.array([t]))
        first, end = (x.tolist() for x in substringdedup.sentences(w, w.hashes()))
        each = [w.bytes[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist())]
        cut[i] = [int(w.starts[k]) for k in first]
        n, mine = len(first), set()
        for s in range(n):
            last = next((e for e in range(s + 1, n) if end[e] - first[s] >= substringdedup.MIN_WORDS), None)
            if last is not None:
                mine.add((s, last))
        begin = next((s for s in range(n - 2, -1, -1) if end[n - 1] - first[s] >= substringdedup.MIN_WORDS), None) if n > 1 else None
        for s, e in sorted(mine):
            spans[tuple(each[first[s] : end[e]])].append((i, s, e))
        if begin is not None and (begin, n - 1) not in mine:
            spans[tuple(each[first[begin] : end[n - 1]])].append((i, begin + substringdedup.TO_END, n - 1))
    gone = collections.defaultdict(set)
    for places in spans.values():
        for i, s, e in sorted(places)[1:]:
            gone[i].update(range(s % substringdedup.TO_END, e + 1))
    got = {r.doc_id: r for r in queries.op3_substring_dedup(spark, SF).collect()}
    for i, t in texts:
        data = t.encode()
        edge = [*cut[i], len(data)]
        want = data[: edge[0]] + b"".join(data[a:b] for k, (a, b) in enumerate(zip(edge, edge[1:])) if k not in gone[i])
        assert (got[i].text, got[i].n_removed) == (want.decode(), len(gone[i])), i
