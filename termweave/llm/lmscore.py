"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts.

The model is a bigram one over lower-cased words with a mark at the end of each text. Every bigram of the training texts
is held in a Bloom filter under the keys (bigram, 1) .. (bigram, level), level growing with the logarithm of the count;
probing level after level until a miss gives the count, rounded down to its level. With c the counts, T(h) the number of
different words after h by Heaps' law, c(h) ** beta, and p1 the add-one unigram probability,
    p(w | h) = c(hw) / (c(h) + T(h))  where the filter knows hw, else  T(h) / (c(h) + T(h)) * p1(w);
after a history that wasn't learned it is p1(w). These add up to at most 1 for each h. beta is fitted so that the T(h)
add up to the number of different bigrams. Counts of words are exact: the ``HOT`` most frequent words are broadcast, the
others are joined by a shuffle of each document's distinct rare words.

The filter grows with the corpus. It is cut into segments by key, as many as the number of tokens asks for; a pass
broadcasts segments of at most ``PASS_BYTES`` together and scores the bigrams that belong to them, and there are as many
passes over the documents as that takes, so what is broadcast or gathered at once stays bounded. A filter's only error
is to take an unseen key for a seen one, at a rate of about 0.3 %. Bigrams are known by 64-bit hashes.

Defined cases: a null text counts as the empty one, which is its end mark alone. Documents with null doc_id are training
documents. If nothing is to be learned all counts are zero. Repeated rows count as often as they stand and are all
returned. Other columns of the input stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.wordspans import Lookup, chunks, mix, words
from termweave.session import remove, written

HOT = 1 << 16
BASE = 1.5
BITS, PROBES = 16, 5
#: Tokens that a task sums before it passes them on; a matter of memory, not of results.
AT_ONCE = 2_000_000
#: Training tokens for each segment, which bounds its size and what is gathered to build it.
SEGMENT_TOKENS = 1_500_000
PASS_BYTES = 96 << 20
START, END = np.uint64(0x51), np.uint64(0xE1)
_B, _C = np.uint64(0xA24BAED4963EE407), np.uint64(0xC2B2AE3D27D4EB4F)
#: Exponents among which beta is sought.
BETAS = [k / 40 for k in range(41)]


# -- the filter -------------------------------------------------------------------------------------------------------
def levels(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for each further factor of BASE."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def least(level: np.ndarray) -> np.ndarray:
    """The smallest whole count of the level."""
    return np.ceil(BASE ** (np.maximum(level, 1) - 1.0) - 1e-6)


def _probe(key: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where to look, and PROBES bits of one 64-bit word: a blocked filter, whose probes share a memory access."""
    a = mix(key + np.asarray(level, np.uint64) * _C)
    b = mix(a ^ _B)
    bits = np.zeros(len(a), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((b >> np.uint64(6 * i)) & np.uint64(63))
    return a, bits


def build(key: np.ndarray, level: np.ndarray, bits: int = BITS) -> bytes:
    """The words of a segment that holds each key at its level; bits: of the filter for each key and level."""
    many = np.repeat(key, level)
    each = np.arange(len(many)) - np.repeat(np.cumsum(level) - level, level) + 1
    out = np.zeros(max(1, -(-len(many) * bits // 64)), np.uint64)
    a, ones = _probe(many, each)
    np.bitwise_or.at(out, (a % np.uint64(len(out))).astype(np.int64), ones)
    return out.tobytes()


@dataclass
class Filter:
    """Segments end to end: words, and the place and size of each; size 0: not here."""

    words: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, sizes: dict[int, int], segments: Iterable[tuple[int, bytes]], count: int) -> Filter:
        """sizes: bytes of each segment here; segments: one after the other, so no second copy of all is made."""
        size = np.zeros(count, np.uint64)
        for k, n in sizes.items():
            size[k] = n // 8
        first = np.cumsum(size) - size
        words = np.zeros(int(size.sum()), np.uint64)
        for k, data in segments:
            words[int(first[k]) : int(first[k] + size[k])] = np.frombuffer(data, np.uint64)
        return cls(words, first, size)

    def level(self, key: np.ndarray) -> np.ndarray:
        """The level of each key, 0 for a key that isn't held, by probing level after level."""
        out = np.zeros(len(key), np.int64)
        segment = segment_of(key, len(self.size))
        live = np.flatnonzero(self.size[segment] > 0)
        key, first, size = key[live], self.first[segment[live]], self.size[segment[live]]
        level = 1
        while len(live):
            a, bits = _probe(key, level)
            hit = self.words[(first + a % size).astype(np.int64)] & bits == bits
            live, key, first, size = (x[hit] for x in (live, key, first, size))
            out[live] = level
            level += 1
        return out


def segment_of(key: np.ndarray, count: int) -> np.ndarray:
    return (key % np.uint64(count)).astype(np.int64)


def bigram(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _B + w)


# -- tokens -----------------------------------------------------------------------------------------------------------
def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the token before, and row, of every token; each text ends with END."""
    w = words(texts)
    n = w.counts()
    row = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    h = np.full(len(row), END)
    inner = np.ones(len(row), bool)
    inner[last] = False
    h[inner] = w.hashes()
    before = np.concatenate(([START], h[:-1]))
    before[np.concatenate(([0], last[:-1] + 1))] = START
    return h, before, row


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi in chunks(texts):
        yield lo, hi, *tokens(texts.slice(lo, hi - lo))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sum of n of each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[starts], np.add.reduceat(n, starts)


# -- counts -----------------------------------------------------------------------------------------------------------
def _summing(train: DataFrame, kind: str, keys, send) -> DataFrame:
    """Keys of each text's tokens and the tokens before, summed within a task over AT_ONCE tokens and sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for _, _, w, h, _ in _parts(batch.column("text")):
                found.append(np.unique(keys(h, w), return_counts=True))
                size += len(w)
                if size >= AT_ONCE:
                    yield send(*_summed(*(np.concatenate(x) for x in zip(*found))))
                    found, size = [], 0
        if found:
            yield send(*_summed(*(np.concatenate(x) for x in zip(*found))))

    return train.select("text").mapInArrow(run, kind)


def unigrams(train: DataFrame) -> DataFrame:
    """h (word hash), c (count): exact, of all tokens with their end marks."""

    def send(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "c"])

    return _summing(train, "h long, c long", lambda h, w: w, send).groupBy("h").agg(F.sum("c").alias("c"))


def segments(train: DataFrame, count: int, bits: int = BITS) -> DataFrame:
    """segment, filter (its words), n (its different bigrams)."""

    def send(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = segment_of(key, count)
        order = np.argsort(at, kind="stable")
        key, n, at = key[order], n[order].astype(np.uint32), at[order]
        some = np.unique(at)
        lo, hi = np.searchsorted(at, some), np.searchsorted(at, some, "right")
        cut = [[x[a:b].tobytes() for a, b in zip(lo, hi)] for x in (key, n)]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cut)], names=["segment", "keys", "counts"])

    def filled(table: pa.Table) -> pa.Table:
        key, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("counts", np.uint32)))
        key, n = _summed(key, n.astype(np.int64))
        return pa.table({"segment": table.column("segment")[:1], "filter": pa.array([build(key, levels(n), bits)], pa.binary()), "n": pa.array([len(key)], pa.int64())})

    blobs = _summing(train, "segment int, keys binary, counts binary", bigram, send)
    return blobs.groupBy("segment").applyInArrow(filled, "segment int, filter binary, n long")


def heaps(ones: DataFrame, different: int) -> float:
    """The exponent of c at which the sum over all words is the number of different bigrams, between those of BETAS; c of at least 1."""
    sums = ones.agg(*[F.sum(F.pow("c", F.lit(b))) for b in BETAS]).first()
    if sums[0] is None or different <= sums[0]:
        return 0.0
    return float(np.interp(np.log(different), np.log(np.array(sums, float)), BETAS))


# -- scoring ----------------------------------------------------------------------------------------------------------
@dataclass
class Known:
    """Frequent words: lookup of their place; whether each was learned, and log10 of its p1, of T and of c + T."""

    lookup: Lookup
    seen: np.ndarray
    one: np.ndarray
    types: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, c: np.ndarray, spread: float, beta: float) -> Known:
        some = np.maximum(c, 1).astype(float)
        return cls(Lookup(h, np.arange(len(h), dtype=np.int32)), c > 0, np.log10((c + 1) / spread), beta * np.log10(some), np.log10(np.where(c > 0, some + some**beta, 1.0)))


#: Of a pass: what the words and bigrams known to it give; and the document's other words w: how often each stands (first pass only), and how often after, or as, the history of a bigram unknown to it.
PASS = "text_hash long, held_out boolean, n_tokens long, known long, base double, score double, w array<long>, times array<int>, open array<int>, opens array<int>"


def _score(texts: DataFrame, shared, here: list[int], first: bool) -> DataFrame:
    """One pass over doc_id, text_hash, held_out, text: PASS for each row, by the filter's segments here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, big = shared.value
        mine = np.zeros(len(big.size), bool)
        mine[here] = True
        for batch in batches:
            for lo, hi, w, h, row in _parts(batch.column("text")):
                n = hi - lo
                key = bigram(h, w)
                # of each document's bigrams of these segments, which the filter doesn't know
                some = np.flatnonzero(mine[segment_of(key, len(mine))])
                pairs, pair = np.unique(key[some], return_inverse=True)
                level = big.level(pairs)
                unknown = np.zeros(len(w), bool)
                unknown[some] = (level == 0)[pair]
                place = hot.lookup(w)
                before = np.concatenate(([0], place[:-1]))
                start = h == START
                before[start] = hot.lookup(np.array([START]))[0]
                frequent = place >= 0
                at = np.maximum(place, 0)
                score = np.bincount(row[some], np.log10(least(level))[pair] * (level > 0)[pair], n)
                score += np.bincount(row, np.where(unknown & frequent, hot.one[at], 0.0), n)
                score += np.bincount(row, np.where(unknown & (before >= 0), hot.types[np.maximum(before, 0)], 0.0), n)
                size = np.bincount(row, minlength=n)
                base, known = np.zeros(n), np.zeros(n)
                if first:
                    base = np.bincount(row, np.where(frequent, hot.one[at], 0.0), n)
                    known = np.bincount(row, frequent & hot.seen[at], n)
                    score -= np.bincount(row, np.where(before >= 0, hot.total[np.maximum(before, 0)], 0.0), n)
                # a rare word is the history of the token after it, which stands in the same text as it is no end mark
                other = np.flatnonzero(~frequent)
                after = unknown[np.minimum(other + 1, len(w) - 1)]
                if not first:
                    keep = unknown[other] | after
                    other, after = other[keep], after[keep]
                order = np.lexsort((w[other], row[other]))
                other, after = other[order], after[order]
                starts = np.flatnonzero(np.concatenate(([True], (w[other][1:] != w[other][:-1]) | (row[other][1:] != row[other][:-1])))) if len(other) else other
                times = np.diff(np.append(starts, len(other))) * first
                open_, opens = (np.add.reduceat(x.astype(np.int64), starts) if len(starts) else times for x in (unknown[other], after))
                bounds = pa.array(np.searchsorted(row[other][starts], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, t)) for x, t in ((w[other][starts].view(np.int64), pa.int64()), (times, pa.int32()), (open_, pa.int32()), (opens, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, n) for k in range(3)), pa.array(size), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), *lists],
                    names=["doc_id", *(c.split()[0] for c in PASS.split(", "))],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, {PASS}")


def _passes(sizes: dict[int, int], room: int) -> list[dict[int, int]]:
    """Segments and their sizes, as many at once as there is room for; one pass at least."""
    out, left = [{}], room
    for k in sorted(sizes):
        if sizes[k] > left and out[-1]:
            out.append({})
            left = room
        out[-1][k] = sizes[k]
        left -= sizes[k]
    return out


def score(docs: DataFrame, held_out: Column, hot: int = HOT, pass_bytes: int = PASS_BYTES, bits: int = BITS, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; learns from those that aren't held out."""
    sc = docs.sparkSession.sparkContext
    train = docs.where(~held_out)
    ones = written(unigrams(train), "unigrams")
    n, v = ones.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    count = max(8, -(-n // segment_tokens))
    found = written(segments(train, count, bits), "segments")
    beta = heaps(ones, found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    spread = float(n + v + 1)
    end = END.view(np.int64).item()
    ends = ones.where(F.col("h") == end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = ones.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(hot).toPandas()
    # the marks count as frequent words; there are as many starts as ends
    h = np.concatenate([top["h"].to_numpy(np.int64).view(np.uint64), [START, END]])
    known = Known.of(h, np.concatenate([top["c"].to_numpy(np.int64), [ends, ends]]), spread, beta)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), held_out.alias("held_out"), "text")
    sizes = {r["segment"]: r["n"] for r in found.select("segment", F.length("filter").alias("n")).collect()}
    # bigrams of segments that nothing fell into are unknown to the first pass
    empty, passes = sorted({*range(count)} - sizes.keys()), []
    for here in _passes(sizes, pass_bytes):
        rows = found.where(F.col("segment").isin([*here])).select("segment", "filter").toLocalIterator() if here else ()
        shared = sc.broadcast((known, Filter.of(here, ((r["segment"], r["filter"]) for r in rows), count)))
        passes.append(written(_score(texts, shared, [*here] if passes else [*here, *empty], not passes), "scores"))
        shared.destroy()
    remove(found)
    return _total(passes, ones, n, spread, beta)


def _total(passes: list[DataFrame], ones: DataFrame, n: int, spread: float, beta: float) -> DataFrame:
    """The passes' sums and what the rare words add, for each row of the first pass."""
    key = ["doc_id", "text_hash"]
    c = F.coalesce("c", F.lit(0)).cast("double")
    one, types = F.log10((c + 1) / F.lit(spread)), F.lit(beta) * F.log10(F.greatest(c, F.lit(1.0)))
    total = F.when(c > 0, F.log10(c + F.pow(c, F.lit(beta)))).otherwise(0.0)
    rare, parts = None, None
    for k, rows in enumerate(passes):
        some = rows.select(*key, F.explode(F.arrays_zip("w", "times", "open", "opens")).alias("x")).select(*key, "x.*")
        part = rows.select(*key, F.lit(int(k == 0)).alias("rows"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "score")
        rare, parts = (some, part) if rare is None else (rare.unionByName(some), parts.unionByName(part))
    rare = rare.join(ones.withColumnRenamed("h", "w"), "w", "left")
    more = rare.groupBy(*key).agg(
        F.lit(0).alias("rows"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * one).alias("base"),
        F.sum(F.col("open") * one + F.col("opens") * types - F.col("times") * total).alias("score"),
    )
    # rows that repeat give their sums as often as they stand
    sums = parts.unionByName(more).groupBy(*key).agg(*[F.sum(x).alias(x) for x in ("rows", "known", "base", "score")])
    sums = sums.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "rows", F.col("known").alias("more_known"), F.col("base").alias("more_base"), F.col("score").alias("all"))
    out = passes[0].join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.expr("more_known div rows")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") / F.col("rows")).alias("base_score"), (F.col("all") / F.col("rows")).alias("score"),
    )
