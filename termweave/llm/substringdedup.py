"""Removal of repeated passages by sliding sentence spans.

A text is divided into sentences (after . ! ? and at line breaks); sentences of over ``LONG`` words are divided further
after words chosen by their own hash, so that the places don't depend on what stands around a passage. From every
sentence runs the shortest span of at least two sentences and ``MIN_WORDS`` words, and another such ends with the text. Spans are hashed and grouped over all
documents, and every sentence that a span covers which isn't the first with its hash, by doc_id and then place, goes.

Each batch marks repeats among its own spans, which need no partner any more, so a passage that stands in a third of all
rows reaches the grouping at most once from each batch; there its rows are ranked by a sort, which holds none of them.
Runs of one repeated word or line within a text are repeats like others. A run of under ``MIN_WORDS`` words is no passage.

Defined cases: a null text has no sentences and stays null; the empty text stays empty; texts without a repeated span
stay byte for byte. Rows with the same doc_id and text count as one document and are treated alike; null doc_ids sort
first. Case of A-Z and the kind of white space don't matter to a match. Other columns stay, but
one named n_removed is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.columns import fresh, without
from termweave.llm.wordspans import _STEP, SMALL, Words, chunks, mix, powers, release, words

MIN_WORDS = 20
LONG = 10
CUT = np.uint64(3)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def sentences(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word, and word after the last, of each sentence; sentences don't cross texts."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(w.bytes == 10)
    after = np.concatenate((w.starts[1:], [len(w.bytes)]))
    stop = np.isin(w.bytes[w.ends - 1], np.frombuffer(b".!?", np.uint8)) | (np.searchsorted(breaks, after) > np.searchsorted(breaks, w.ends)) | np.concatenate((w.doc[1:] != w.doc[:-1], [True]))
    ends = np.flatnonzero(stop) + 1
    size = np.diff(np.concatenate(([0], ends)))
    ends = np.flatnonzero(stop | (np.repeat(size, size) > LONG) & (h & CUT == 0)) + 1
    return np.concatenate(([0], ends[:-1])), ends


#: Added to the number of a sentence whose span runs to the end of the text.
TO_END = 1 << 30


def spans(w: Words, h: np.ndarray, first: np.ndarray, end: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each span: its first and last sentence, whether it is its text's last one, and its hash."""
    n = len(first)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)
    text_end = np.searchsorted(w.doc, w.doc[first], "right")
    least = np.maximum(np.append(end[1:], len(w.doc) + 1), first + min_words)
    last = np.searchsorted(end, least, "left")
    ok = (last < n) & (least <= text_end)
    ok[ok] = end[last[ok]] <= text_end[ok]
    at = np.flatnonzero(ok)
    # the last sentences of a text, where no span from a sentence ends with it
    final = np.flatnonzero(end == text_end)
    begin = np.minimum(np.searchsorted(first, end[final] - min_words, "right") - 1, final - 1)
    fits = (begin >= 0) & (w.doc[first[begin]] == w.doc[first[final]])
    fits[fits] &= ~(ok[begin[fits]] & (last[begin[fits]] == final[fits]))
    tail = np.concatenate([np.zeros(len(at), bool), np.ones(int(fits.sum()), bool)])
    at, last = np.concatenate([at, begin[fits]]), np.concatenate([last[at], final[fits]])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)))))
    back = np.full(len(h) + 1, _BACK)
    back[0] = 1
    back = np.multiply.accumulate(back)
    a, b = first[at], end[last]
    return at, last, tail, mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))


def _cut(texts: pa.Array, min_words: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi in chunks(texts, SMALL):
        w = words(texts.slice(lo, hi - lo))
        h = w.hashes()
        first, end = sentences(w, h)
        begins = np.searchsorted(w.doc[first] if len(first) else first, np.arange(hi - lo), "left")  # each text's first sentence
        yield lo, w, first, end, begins, *spans(w, h, first, end, min_words)


def _find(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "text_hash"))
            found = [(lo + w.doc[first[at]], at - begins[w.doc[first[at]]] + tail * TO_END, h) for lo, w, first, _, begins, at, _, tail, h in _cut(batch.column("text"), min_words)]
            row, number, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((number, text[row], doc[row], h))
            row, number, h = row[order], number[order], h[order].astype(np.uint64)
            again = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
            same = np.concatenate(([False], (row[1:] != row[:-1]) & (doc[row][1:] == doc[row][:-1]) & (text[row][1:] == text[row][:-1]) & (number[1:] == number[:-1]) & again[1:])) if len(h) else again
            row, number, h, again = row[~same], number[~same], h[~same], again[~same]
            # known repeats need no partner any more: a key of their own keeps them apart
            key = np.where(again, mix(h ^ mix(doc[row].astype(np.uint64) ^ (number.astype(np.uint64) << np.uint64(40)))), h)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(again), pa.array(doc[row]), pa.array(text[row]), pa.array(number.astype(np.int32))], names=["h", "again", "doc", "text_hash", "number"])
        release()

    return run


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, text_hash, numbers: for each document with repeats, the sentences at which non-first spans start."""
    rows = docs.where("text is not null").select(*_key(), "text")
    found = rows.mapInArrow(_find(min_words), "h long, again boolean, doc long, text_hash long, number int")
    order = Window.partitionBy("h", "again").orderBy("doc", "text_hash", "number")
    ranked = found.withColumns({"r": F.rank().over(order)})
    return ranked.where("again or r > 1").groupBy("doc", "text_hash").agg(F.collect_set("number").alias("numbers"))


def _key() -> tuple:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("text_hash")


def cover(text: str, numbers: np.ndarray, min_words: int) -> tuple[str, int]:
    """The text without the sentences that the spans starting at these sentences cover, and how many those are."""
    (_, w, first, end, _, at, last, tail, _), *_ = _cut(pa.array([text]), min_words)
    gone = np.zeros(len(first) + 1, np.int64)
    hit = np.isin(at + tail * TO_END, numbers)
    np.add.at(gone, at[hit], 1)
    np.add.at(gone, last[hit] + 1, -1)
    gone = np.cumsum(gone)[:-1] > 0
    data = text.encode()
    edge = [*w.starts[first].tolist(), len(data)]
    return (data[: edge[0]] + b"".join([data[a:b] for a, b, g in zip(edge, edge[1:], gone) if not g])).decode(), int(gone.sum())


def dedupe(docs: DataFrame, min_words: int = MIN_WORDS, count: str = "n_removed") -> DataFrame:
    """The rows with repeated passages taken out of text, and how many sentences those were."""
    docs = without(docs, count)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in batches:
            out, n = [], []
            for t, k in zip(texts.to_pylist(), numbers.to_pylist()):
                t, removed = cover(t, np.array(k), min_words) if k else (t, 0)
                out.append(t)
                n.append(removed)
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64())], ["text", "n"])
        release()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    doc, text_hash = _key()
    a, b, done = (fresh(docs, c) for c in ("_doc", "_text_hash", "_done"))
    keyed = docs.withColumns({a: doc, b: text_hash})
    found = repeated(docs, min_words)
    both = keyed.join(found, (keyed[a] == found["doc"]) & (keyed[b] == found["text_hash"]), "left")
    both = both.select(*[keyed[f"`{c}`"] for c in docs.columns], F.arrow_udf(run, "text string, n long").asNondeterministic()(keyed["text"], found["numbers"]).alias(done))
    return both.select(*[F.col(done)["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col(done)["n"].alias(count))
