"""Benchmark decontamination by latent semantic retrieval.

One pass over all documents counts, in passages of ``PASSAGE`` words, in how many each benchmark word occurs, and sums
the Gram matrix of the passages times a random matrix. From these comes a randomised singular value decomposition
(Nystroem's, which needs no second pass) of the TF-IDF matrix of passages, whose first right vectors span the latent
space. A second pass slides windows of each item's length over every text and keeps those whose cosine to the item in
that space is at least ``COSINE``; each of these is a candidate until one of its run is accepted. It is contaminated if the
longest common subsequence of words covers ``WHOLE`` of the item, or, as a paraphrase, ``PART`` of it and ``ANSWER`` of
its answer, which is its last sentence.

The latent space has the benchmark's words only, without those in over ``STOP`` of the distinct items, but always with
the ``RAREST`` rarest words of each. The search proper is approximate: a window is looked at if it holds ``SHARE`` as
many of these words as the item, and passes by its cosine. What can't be accepted is not compared word by word: a
subsequence of ``PART`` of an item's n words leaves out at most (1 - PART) n of them, so of its f features f - (1 - PART) n
stand in the window with its margins. Sums and products are of whole numbers, so they don't depend on the texts around.
Items are taken in blocks of ``BLOCK``, which bounds what is broadcast and gathered: a block's words times the rank.

Defined cases: null and empty texts, and items without words, match nothing. Of equal items each is reported. Repeated
rows get the same findings. Other columns stay, but one named leaks is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.columns import without
from termweave.llm.wordspans import NOT_ALNUM, Lookup, chunks, words

PASSAGE = 64
RANK, EXTRA = 24, 8
COSINE = 0.6
STOP = 0.08
#: A window is looked at if it holds this share of an item's number of features, be they its own or not.
SHARE = 0.6
#: Steps of the latent coordinates, and of unit vectors: sums of 24 products of these are exact in single precision.
STEP, UNIT = 2.0**-14, 2.0**-11
#: So many words of every item are features however many items they are in, so that each item is searched.
RAREST = 8
WHOLE, PART, ANSWER = 0.8, 0.6, 0.8
BLOCK = 2_000
#: Items whose lengths differ by up to this factor share windows of their median length.
STRETCH = 1.2
#: Windows whose words are looked at together; a matter of memory, not of results.
AT_ONCE = 4_096
#: Features that go into one row of the partial sums.
ROW = 256


@dataclass
class Items:
    """ids; seq: word hashes of each; answer: of its last sentence; features: of each item, with repeats; lookup: word to feature."""

    ids: list[int]
    seq: list[np.ndarray]
    answer: list[np.ndarray]
    features: list[np.ndarray]
    lookup: Lookup
    size: int


def hashes(text: str) -> np.ndarray:
    return words(pa.array([text]), NOT_ALNUM).hashes()


def answer_of(text: str, least: int = 5) -> str:
    """The last sentence, or more of them up to ``least`` words."""
    parts = re.findall(r"[^.!?\n]+[.!?\n]*", text)
    out = ""
    while parts and len(out.split()) < least:
        out = parts.pop() + out
    return out


def prepare(rows: list[tuple[int, str]]) -> Items:
    rows = [(i, t) for i, t in rows if t and len(hashes(t))]
    seq = [hashes(t) for _, t in rows]
    df: dict[int, int] = {}
    distinct = [np.unique(s).tolist() for s in {s.tobytes(): s for s in seq}.values()]
    for words_ in distinct:
        for h in words_:
            df[h] = df.get(h, 0) + 1
    most = max(2, STOP * len(distinct))
    rarest = {h for words_ in distinct for h in sorted(words_, key=lambda h: (df[h], h))[:RAREST]}
    vocabulary = np.array(sorted(h for h, n in df.items() if n <= most or h in rarest), np.uint64)
    lookup = Lookup(vocabulary, np.arange(len(vocabulary), dtype=np.int32))
    features = [f[f >= 0] for f in map(lookup, seq)]
    return Items([i for i, _ in rows], seq, [hashes(answer_of(t)) for _, t in rows], features, lookup, len(vocabulary))


def test_matrix(size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).standard_normal((size, RANK + EXTRA)).astype(np.float32)


# -- statistics -------------------------------------------------------------------------------------------------------
def _gather(texts: pa.Array, lookup: Lookup, size: int, omega: np.ndarray, df: np.ndarray, sketch: np.ndarray) -> int:
    """Add the passages of these texts to df and sketch; how many those are."""
    w = words(texts, NOT_ALNUM)
    if not len(w.starts):
        return 0
    n = w.counts()
    per = (n + PASSAGE - 1) // PASSAGE
    first = np.cumsum(n) - n
    passage = (np.cumsum(per) - per)[w.doc] + (np.arange(len(w.doc)) - first[w.doc]) // PASSAGE
    f = lookup(w.hashes())
    have = f >= 0
    key, tf = np.unique(passage[have] * size + f[have], return_counts=True)
    row, f = key // size, key % size
    if len(f):
        df += np.bincount(f, minlength=size)
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        y = np.add.reduceat(omega[f] * tf[:, None].astype(np.float32), starts)
        part = y[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))] * tf[:, None].astype(np.float32)
        order = np.argsort(f, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], f[order][1:] != f[order][:-1])))
        sketch[f[order][begin]] += np.add.reduceat(part[order], begin)
    return int(per.sum())


def statistics(docs: DataFrame, items: Items) -> tuple[int, np.ndarray, np.ndarray]:
    """Passages in all documents, in how many each feature occurs, and their Gram matrix times the test matrix."""
    shared = docs.sparkSession.sparkContext.broadcast((items.lookup, items.size))
    width = RANK + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, size = shared.value
        omega, df, sketch, count = test_matrix(size), np.zeros(size, np.int64), np.zeros((size, width)), 0
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in chunks(texts):
                count += _gather(texts.slice(lo, hi - lo), lookup, size, omega, df, sketch)
        if count:
            salt = TaskContext.get().partitionId() % 32  # the same if the task runs again
            blocks = range(0, size, ROW)
            out = [np.concatenate([df[lo : lo + ROW, None], sketch[lo : lo + ROW]], 1).astype(np.float64).tobytes() for lo in blocks] + [np.float64(count).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(out))], pa.int32()), pa.array([salt] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["block", "salt", "sums"])

    def add(table: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in table["sums"])
        return pd.DataFrame({"block": [table["block"][0]], "salt": [0], "sums": [total.tobytes()]})

    kind = "block int, salt int, sums binary"
    parts = docs.select("text").mapInArrow(run, kind)
    rows = parts.groupBy("block", "salt").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind).collect()
    sums = {r["block"]: np.frombuffer(bytes(r["sums"])) for r in rows}
    if not sums:
        return 0, np.zeros(items.size), np.zeros((items.size, width))
    count = int(sums.pop(max(sums))[0])
    both = np.concatenate([sums[k].reshape(-1, width + 1) for k in sorted(sums)]) if sums else np.zeros((0, width + 1))
    return count, both[:, 0], both[:, 1:]


def latent(count: int, df: np.ndarray, sketch: np.ndarray, omega: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Each feature's row in the latent space, idf included.

    With D = diag(idf), the sketch is T'T O for raw counts T, so D times it is G O' for the TF-IDF Gram matrix G = D T'T D
    and the test matrix O' = O / idf; Nystroem's formula then gives G's first eigenvectors, the right singular vectors.
    """
    idf = np.log((1 + count) / (1 + df)) + 1
    y, test = sketch * idf[:, None], omega / idf[:, None]
    scale = np.linalg.norm(test, axis=0)
    y, test = y / scale, test / scale
    core = test.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    ok = value > 1e-9 * max(value.max(initial=0), 1e-30)
    if not ok.any():
        return np.zeros((len(df), 1), np.float32)
    u, s, _ = np.linalg.svd((y @ vector[:, ok]) / np.sqrt(value[ok]), full_matrices=False)
    u = u[:, :rank][:, s[:rank] > 0]
    return (u * idf[:, None]).astype(np.float32)


# -- search -----------------------------------------------------------------------------------------------------------
def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Searcher:
    def __init__(self, items: Items, space: np.ndarray, cosine: float = COSINE) -> None:
        space = np.rint(space / STEP).astype(np.int32)
        self.items, self.space, self.cosine = items, space, cosine
        at = np.array([space[f].sum(0) if len(f) else np.zeros(space.shape[1]) for f in items.features]).reshape(len(items.ids), -1)
        self.unit = np.rint(at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12) / UNIT).astype(np.float32)
        size = np.array([len(s) for s in items.seq])
        self.size, self.n_features = size, np.array([len(f) for f in items.features])
        #: So many of an item's features at least stand in whatever is accepted for it.
        self.needed = np.maximum(1, np.ceil(self.n_features - (1 - PART) * size - 1e-9)).astype(np.int64)
        #: Items of about equal length share their windows.
        self.groups: dict[int, np.ndarray] = {}
        bucket = np.round(np.log(np.maximum(size, 1)) / np.log(STRETCH)).astype(int)
        for b in np.unique(bucket):
            which = np.flatnonzero((bucket == b) & (self.n_features > 0))
            if len(which):
                self.groups[int(np.median(size[which]))] = which
        self.own = np.zeros((len(items.ids), max(1, items.size)), bool)
        for i, f in enumerate(items.features):
            self.own[i, f] = True

    def candidates(self, w, h: np.ndarray) -> Iterator[tuple[tuple[int, int], int, int, int, float]]:
        """(run, text, item, first word, cosine): every window that passes, run by run, the best first."""
        f = self.items.lookup(h)
        at = np.flatnonzero(f >= 0)
        if not len(at):
            return
        doc = w.doc[at]
        text_end = np.searchsorted(w.doc, doc, "right")
        total = np.zeros((len(at) + 1, self.space.shape[1]), np.int32)
        np.cumsum(self.space[f[at]], 0, out=total[1:])  # may pass the range of int32, but differences come out right
        for length, which in self.groups.items():
            end = np.searchsorted(at, np.minimum(at + length, text_end))
            least = SHARE * self.n_features[which]
            some = np.flatnonzero(end - np.arange(len(at)) >= least.min())
            parts = [self._passing(total, some[lo : lo + AT_ONCE], end, which, least) for lo in range(0, len(some), AT_ONCE)]
            if not sum(len(k) for k, _, _ in parts):
                continue
            k, i, value = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((k, i))
            k, i, value = k[order], i[order], value[order]
            start = at[k]
            new = np.concatenate(([True], (i[1:] != i[:-1]) | (doc[k[1:]] != doc[k[:-1]]) | (start[1:] - start[:-1] > length // 2)))
            run = np.cumsum(new) - 1
            # a window moved by some words holds at most so many more of the item's, so one in each cell tells of all
            stride = max(1, length // 6)
            first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (start[1:] // stride != start[:-1] // stride))))
            item = which[i]
            may = self._own_words(f, at, doc, k[first], item[first]) + stride > self.needed[item[first]]
            some = np.flatnonzero(np.repeat(may, np.diff(np.append(first, len(k)))))
            some = some[self._own_words(f, at, doc, k[some], item[some]) >= self.needed[item[some]]]
            for r in some[np.lexsort((-value[some], run[some]))].tolist():
                yield (length, int(run[r])), int(doc[k[r]]), int(item[r]), int(start[r]), float(value[r])

    def _own_words(self, f: np.ndarray, at: np.ndarray, doc: np.ndarray, k: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many of the item's own words stand in each window, begun at the k-th feature, and its margins."""
        out = np.zeros(len(k), np.int64)
        for lo in range(0, len(k), AT_ONCE):
            begin, which = at[k[lo : lo + AT_ONCE]], item[lo : lo + AT_ONCE]
            size = self.size[which]
            first, last = np.searchsorted(at, begin - size // 2), np.searchsorted(at, begin + size + size // 2)
            n = last - first
            each = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = self.own[np.repeat(which, n), f[at[each]]] & (doc[each] == np.repeat(doc[k[lo : lo + AT_ONCE]], n))
            out[lo : lo + AT_ONCE] = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
        return out

    def _passing(self, total: np.ndarray, some: np.ndarray, end: np.ndarray, which: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in which, cosine) of the pairs of these windows and items that pass."""
        x = (total[end[some]] - total[some]).astype(np.float32)
        norm = np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x), 1e-12))
        x = np.rint(x * (1 / UNIT / norm)[:, None].astype(np.float32))
        dot = x @ self.unit[which].T * np.float32(UNIT**2)
        k, i = np.divmod(np.flatnonzero(dot >= np.float32(self.cosine)), len(which))
        full = (end[some] - some)[k] >= least[i]
        k, i = k[full], i[full]
        return some[k], i, dot[k, i]

    def __call__(self, texts: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for lo, hi in chunks(texts):
            w = words(texts.slice(lo, hi - lo), NOT_ALNUM)
            h = w.hashes()
            begin, end = np.searchsorted(w.doc, np.arange(hi - lo), "left"), np.searchsorted(w.doc, np.arange(hi - lo), "right")
            best: dict[tuple[int, int], tuple[float, float]] = {}
            now, done, seen = None, False, []
            for run, d, i, start, cos in self.candidates(w, h):
                if run != now:
                    now, done, seen = run, False, []
                n = int(self.size[i])
                # a window moved by k words shares at most k words more, so near a poor one none is enough
                if done or any(shared + abs(start - s) < PART * n for s, shared in seen):
                    continue
                window = h[max(begin[d], start - n // 2) : min(end[d], start + n + n // 2)]
                shared = common(self.items.seq[i], window)
                share = shared / n
                if share >= WHOLE or share >= PART and common(self.items.answer[i], window) >= ANSWER * len(self.items.answer[i]):
                    best[d, i] = max(best.get((d, i), (0.0, 0.0)), (share, cos))
                    done = True
                elif share < PART:
                    seen.append((start, shared))
            for (d, i), (share, cos) in sorted(best.items()):
                out[lo + d].append({"item_id": self.items.ids[i], "lcs_share": share, "cosine": float(cos)})
        return out


def search(docs: DataFrame, benchmark: DataFrame, leaks: str = "leaks") -> DataFrame:
    """The rows with leaks: an array of (item_id, lcs_share, cosine) of the items that the text holds, by place in the benchmark; null text: empty."""
    docs = without(docs, leaks)
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-rows.count() // BLOCK))
    kind = "array<struct<item_id: long, lcs_share: double, cosine: double>>"
    out = docs.withColumn(leaks, F.lit(None).cast(kind))
    for b in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        items = prepare([(r["item_id"], r["text"]) for r in some.orderBy("item_id", "text").collect()])
        if not items.ids:
            continue
        space = latent(*statistics(docs, items), test_matrix(items.size))
        shared = spark.sparkContext.broadcast((items, space))
        out = out.withColumn(leaks, F.concat(F.coalesce(leaks, F.array().cast(kind)), _finder(shared, kind)("text")))
    return out.withColumn(leaks, F.coalesce(leaks, F.array().cast(kind)))


def _finder(shared, kind: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(*shared.value)
        struct = pa.list_(pa.struct([("item_id", pa.int64()), ("lcs_share", pa.float64()), ("cosine", pa.float64())]))
        for texts in batches:
            yield pa.array(searcher(texts), struct)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_share, cosine: one row for each item that a document's text holds."""
    found = search(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.lcs_share", "x.cosine")
