"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the XXH64 values (seed 42) of the text's word
shingles, repeats included. Words are what stands between white space, with A-Z in lower case; a text of fewer words
than a shingle is one shingle, one without words has fingerprint zero.

Covering tables: the bits are dealt to the points of a projective plane, and each table masks out the bits of one line.
Any two points are on a line, so two fingerprints that differ in up to two bits agree in some table, always. Within the
buckets that hold several fingerprints, links are found without forming pairs: two fingerprints are within two bits if
and only if some value is within one bit of both, and each member names the at most 1 + |line| such values that its
table allows. So work grows with the members of a bucket, not their pairs.

Defined cases: a null text counts as the empty one. Repeated rows and equal fingerprints are linked by being equal, and
grouped before any table is formed. Null doc_ids are linked like others but name no component unless all of it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.columns import fresh
from termweave.llm.components import components
from termweave.llm.wordspans import SMALL, Words, chunks, mix, release, words
from termweave.session import gathered, remove, written

#: A perfect difference set modulo 13; its shifts are the lines of the projective plane of order 3.
LINE, POINTS = (0, 1, 3, 9), 13
SEED = 42


def lines() -> list[list[int]]:
    """For each table the bits that it masks out."""
    return [[b for b in range(64) if (b - t) % POINTS in LINE] for t in range(POINTS)]


def spaced(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between, and where each begins and ends there."""
    n = w.ends - w.starts
    start = np.cumsum(n + 1) - n - 1
    out = np.full(int((n + 1).sum()), 32, np.uint8)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[within + np.repeat(start, n)] = w.bytes[within + np.repeat(w.starts, n)]
    return out.tobytes(), start, start + n


def shingle_hashes(texts: pa.Array, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and how many each text has."""
    w = words(texts)
    data, start, end = spaced(w)
    n = w.counts()
    have = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = np.cumsum(n) - n
    at = np.repeat(first, have) + np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have)
    last = np.minimum(at + size, np.repeat(first + n, have)) - 1
    one = xxhash.xxh64_intdigest
    return np.array([one(data[a:b], seed) for a, b in zip(start[at].tolist(), end[last].tolist())], np.uint64), have


def fingerprints(texts: pa.Array, size: int, seed: int = SEED) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in chunks(texts):
        h, have = shingle_hashes(texts.slice(lo, hi - lo), size, seed)
        some = np.flatnonzero(have)
        if len(some):
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, (np.cumsum(have) - have)[some], axis=0, dtype=np.int64)
            out[lo + some] = np.packbits(2 * counts > have[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_udf(size: int, seed: int = SEED):
    """Text to fingerprint, as a signed long with the same bits."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(fingerprints(texts, size, seed).view(np.int64))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long").asNondeterministic()


def _spread(values: DataFrame) -> DataFrame:
    """The rows over all partitions: a small table sits in few files, and each row becomes many."""
    return values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def links(values: DataFrame) -> DataFrame:
    """values: distinct fp (long). src, dst: links that connect exactly those within two bits, dst the smallest of those around a common value."""
    masked = lines()
    keep = [~sum(1 << b for b in bits) & (2**64 - 1) for bits in masked]
    signed = [k - (1 << 64) if k >> 63 else k for k in keep]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for t, k in enumerate(signed)])
    rows = _spread(values).select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    full = written(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key"), "buckets")
    members = rows.join(full, ["t", "key"], "left_semi")
    flips = F.element_at(F.create_map(*[F.lit(x) for t, bits in enumerate(masked) for x in (t, [0, *[(1 << b) - (1 << 64) if b == 63 else 1 << b for b in bits]])]), F.col("t"))
    near = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    # no value has over 65 fingerprints within one bit, so these sets are bounded
    groups = near.groupBy("near").agg(F.array_sort(F.collect_set("fp")).alias("all")).where("size(all) > 1")
    return groups.select(F.explode(F.slice("all", 2, 64)).alias("src"), F.col("all")[0].alias("dst")).distinct()


def near_groups(docs: DataFrame, size: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: smallest doc_id that links reach."""
    rows = written(docs.select("doc_id", fingerprint_udf(size, seed)("text").alias("fp")), "fingerprints")
    values = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    found = written(components(links(values.select("fp"))), "components")
    rooted = values.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reach = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(rooted.join(reach, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies by similarity ----------------------------------------------------------------------------------------
#: Sixteen odd numbers that give as many independent sets of bits.
SALTS = [0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(16)]
SETS, CENTRES = 4, 4
#: One text in SAMPLE tells which shingles are frequent, and so many of these are named; neither changes the results.
SAMPLE, FREQUENT = 16, 1 << 16
#: Rows up to which a table of ids is broadcast; of 16 bytes each, beside what a hash table adds.
BROADCAST_IDS = 500_000


def _shingles(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each distinct shingle of each text, as joined from its words' hashes, and its row; in order of row and hash."""
    n = w.counts()
    have = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), have)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
    end = (first + n)[row]
    out = np.zeros(len(row), np.uint64)
    for k in range(size):
        there = at + k < end
        out[there] = mix(out[there] * np.uint64(3) + h[at[there] + k])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.concatenate(([True], (out[1:] != out[:-1]) | (row[1:] != row[:-1]))) if len(out) else np.zeros(0, bool)
    return out[new], row[new]


def word_fingerprints(w: Words, h: np.ndarray, sets: int) -> np.ndarray:
    """Each text's fingerprints over words weighted by the root of their number; zero without words."""
    out = np.zeros((len(w.bounds) - 1, sets), np.uint64)
    order = np.lexsort((h, w.doc))
    h, doc = h[order], w.doc[order]
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    weight = np.round(1024 * np.sqrt(np.diff(np.append(first, len(h)))))  # whole numbers, whose sums don't depend on their order
    h, doc = h[first], doc[first]
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ends = np.append(starts[1:], len(h))
    parts = [weight[a:b] for a, b in zip(starts, ends)]
    half = np.array([[p.sum() / 2] for p in parts])
    for k in range(sets):
        bits = np.unpackbits(mix(h ^ np.uint64(SALTS[k])).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # a text's words at a time, so that what is added stays in the processor's cache
        total = np.stack([part @ bits[a:b] for a, b, part in zip(starts, ends, parts)])
        out[doc[starts], k] = np.packbits(total > half, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def odd_bits(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each text a bitmap of about as many bits as it has shingles: which bits an odd number of them fall on."""
    width = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.cumsum(width) - width
    at = first[row] + (mix(h ^ np.uint64(SALTS[-1])) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=int(width.sum())).astype(np.int64) & 1 > 0, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(first.tolist(), (first + width).tolist())]


def least_difference(a: bytes, b: bytes) -> int:
    """In how many shingles two texts differ at least, by their bitmaps: each differing bit needs one."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), 8 * len(a)
    while n > 8 * len(b):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def may_be_near(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """False only if texts of n and m shingles can't have the similarity: then they'd differ in at most (n + m)(1 - s) / (1 + s)."""
    return min(n, m) >= similarity * max(n, m) - 1e-9 and least_difference(a, b) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def prefixes(h: np.ndarray, row: np.ndarray, n: np.ndarray, similarity: float, frequent: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the first of its n distinct shingles, rare ones before frequent ones, their row, and whether they are frequent.

    Texts of n and m <= n shingles and at least this similarity s share o >= s / (1 + s) * (n + m) shingles, which is at
    least s * n. Whatever the order, the first one they share has o - 1 behind it in both, so it stands among the first
    n - o + 1 of the one and m - o + 1 of the other, and these are in the prefixes of n - ceil(s * n) + 1.
    """
    often = np.zeros(len(h), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        often = np.where(frequent[at] == h, count[at], 0)
    order = np.lexsort((h, often, row))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    take = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    keep = place < take[row]
    return h[order][keep], row[keep], often[order][keep] > 0


#: rare, hot: the prefix's shingles that aren't and, after them, that are frequent.
PROFILE = "node long, fps array<long>, n int, bits binary, rare array<long>, hot array<long>"


def profiles(texts: pa.Array, size: int, similarity: float, sets: int, frequent: np.ndarray, count: np.ndarray) -> pa.StructArray:
    """What near_copies needs of each text: a hash of its word sequence, fingerprints, number of shingles, bitmap, prefix."""
    node, fps, sizes, bits = [], [], [], []
    tokens: tuple[tuple[list, list], tuple[list, list]] = (([], []), ([], []))
    for lo, hi in chunks(texts, SMALL):
        w = words(texts.slice(lo, hi - lo))
        wh = w.hashes()
        data, start, end = spaced(w)
        k = w.counts()
        node += [xxhash.xxh64_intdigest(data[start[b - a] : end[b - 1]] if a else b"", SEED) for b, a in zip(np.cumsum(k).tolist(), k.tolist())]
        fps.append(word_fingerprints(w, wh, sets))
        h, row = _shingles(w, wh, size)
        n = np.bincount(row, minlength=hi - lo)
        sizes.append(n)
        bits += odd_bits(h, row, n)
        h, row, often = prefixes(h, row, n, similarity, frequent, count)
        for (at, values), some in zip(tokens, (~often, often)):
            at.append(np.bincount(row[some], minlength=hi - lo))
            values.append(h[some])

    def joined(parts: list, kind: type) -> np.ndarray:
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(joined(at, np.int64)))), pa.int32()), pa.array(joined(values, np.uint64).view(np.int64))) for at, values in tokens]
    flat = pa.array(joined([x.ravel() for x in fps], np.uint64).view(np.int64))
    each = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * sets, pa.int32()), flat)
    return pa.StructArray.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), each, pa.array(joined(sizes, np.int64).astype(np.int32)), pa.array(bits, pa.binary()), *lists], [x.split()[0] for x in PROFILE.split(", ")])


def _profile_udf(size: int, similarity: float, sets: int, shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield profiles(texts, size, similarity, sets, *shared.value)
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, PROFILE).asNondeterministic()


def _shingle_udf(size: int):
    """Text to the hashes of its distinct shingles."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for lo, hi in chunks(texts, SMALL):
                w = words(texts.slice(lo, hi - lo))
                h, row = _shingles(w, w.hashes(), size)
                bounds.append(bounds[-1][-1] + np.cumsum(np.bincount(row, minlength=hi - lo)))
                out.append(h)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), pa.array(np.concatenate(out).view(np.int64)))
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>").asNondeterministic()


def _frequent(docs: DataFrame, size: int):
    """Broadcast: the most frequent shingles of a sample of the texts, in order, and their numbers."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.explode(_shingle_udf(size)("text")).alias("h"))
    top = some.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return docs.sparkSession.sparkContext.broadcast((h[order], top["c"].to_numpy(np.int64)[order]))


def _need(n: Column, m: Column | int, similarity: float) -> Column:
    """How many shingles texts of n and m must share."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9).cast("int")


def _members(rows: DataFrame, similarity: float) -> DataFrame:
    """token, node, n, place, centre: shingles of prefixes that several nodes have, their places there, and whether these
    allow the text to be the smaller of two near ones. Frequent shingles pass as they are, so no group that is gathered here is large."""
    rare = rows.select("node", "n", F.posexplode("rare").alias("place", "token"))
    group = Window.partitionBy("token")
    rare = rare.withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)}).where("lo < hi").select("token", "node", "n", "place")
    hot = rows.select("node", "n", F.size("rare").alias("before"), F.posexplode("hot").alias("place", "token")).select("token", "node", "n", (F.col("place") + F.col("before")).alias("place"))
    return rare.unionByName(hot).distinct().withColumn("centre", F.col("place") + _need(F.col("n"), F.col("n"), similarity) <= F.col("n"))


def _sized(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


class _Verifier:
    """Which candidate pairs are near: those whose bitmaps allow it are compared by their sets of shingles."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, similarity: float) -> None:
        self.docs, self.size, self.similarity = docs, size, similarity
        self.marks = nodes.select("node", "n", "bits")
        self.rows = nodes.select("node", "row.doc_id", "row.text_hash")
        self.sets: DataFrame | None = None

    def _allowed(self):
        similarity = self.similarity

        def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([may_be_near(*x, similarity) for x in zip(*(c.to_pylist() for c in batch))], pa.bool_())

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "boolean")

    def _add(self, wanted: DataFrame) -> None:
        """Sets of the nodes wanted that aren't there yet."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = written(self.rows.join(wanted, "node"), "wanted")
        texts = self.docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
        texts = texts.join(_sized(wanted), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash"))).select("node", "text")
        # rows that repeat give a node twice
        more = written(texts.select("node", _shingle_udf(self.size)("text").alias("h")).groupBy("node").agg(F.min("h").alias("h")), "shingles")
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        remove(wanted)

    def __call__(self, pairs: DataFrame) -> DataFrame | None:
        """pairs: a, b, written. src, dst of those that are near, written; None if there are none."""
        rows = pairs.count()
        if not rows:
            return None
        a, b = (self.marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
        may = written(gathered(pairs.join(a, "a").join(b, "b").where(self._allowed()("bitsa", "bitsb", "na", "nb")).select("a", "b"), rows), "allowed")
        rows, out = may.count(), None
        if rows:
            ends = may.select(F.col("a").alias("node")).unionByName(may.select(F.col("b").alias("node"))).distinct()
            self._add(ends)
            x, y = self.sets.select(F.col("node").alias("a"), F.col("h").alias("x")), self.sets.select(F.col("node").alias("b"), F.col("h").alias("y"))
            shared = F.size(F.array_intersect("x", "y"))
            near = may.join(x, "a").join(y, "b").where(shared >= F.lit(self.similarity) * (F.size("x") + F.size("y") - shared))
            out = written(gathered(near.select(F.col("a").alias("src"), F.col("b").alias("dst")), rows), "links")
            out = out if out.limit(1).count() else None
        remove(may)
        return out


def _complete(members: DataFrame, linked: DataFrame, check: _Verifier, similarity: float) -> DataFrame:
    """members: from ``_members``, the groups of nodes that share a shingle of their prefixes; linked: src, dst so far. All links' components.

    Each round takes a few of those members of every group that may be the smaller text of a pair as centres, compares
    them with all members that are larger, stand early enough for both sizes, and that no link has joined to them yet,
    then drops them as centres, and groups that are in one component or have no centre left. At the end each pair of a
    group has been compared, can't be near, or is joined by other links. Centres multiply each round, so that few rounds do.
    """
    found = written(components(linked), "components")
    k = CENTRES
    while True:
        rooted = members.join(found, "node", "left").select("token", "node", "n", "place", "centre", F.coalesce("root", "node").alias("root"))
        live = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("centre").alias("c")).where("lo < hi and c").select("token")
        rows = members.count()
        left = written(gathered(rooted.join(live, "token", "left_semi"), rows), "members")
        remove(members)
        rows = left.count()
        if not rows:
            remove(left)
            return found
        centres = left.where("centre").groupBy("token", F.pmod(F.xxhash64("node", F.lit(k)), F.lit(k)).alias("salt")).agg(F.min(F.struct("node", "n", "root", "place")).alias("c"))
        centres = written(gathered(centres.select("token", F.col("c.node").alias("cn"), F.col("c.n").alias("m"), F.col("c.root").alias("croot"), F.col("c.place").alias("cplace")), rows), "centres")
        n, m, need = F.col("n"), F.col("m"), _need(F.col("n"), F.col("m"), similarity)
        near = left.join(centres, "token").where((F.col("root") != F.col("croot")) & (n >= m) & (F.col("place") + need <= n) & (F.col("cplace") + need <= m))
        pairs = written(gathered(near.select(F.least("node", "cn").alias("a"), F.greatest("node", "cn").alias("b")).distinct(), 2 * rows), "pairs")
        new = check(pairs)
        if new is not None:
            old = found.select(F.col("node").alias("src"), F.col("root").alias("dst"))  # stars that say the same as all links so far
            more = written(components(old.unionByName(new)), "components")
            remove(found)
            remove(new)
            found = more
        used = centres.select("token", F.col("cn").alias("node"), F.lit(True).alias("used"))
        members = left.join(used, ["token", "node"], "left").select("token", "node", "n", "place", (F.col("centre") & F.col("used").isNull()).alias("centre"))
        members = written(gathered(members, rows), "members")
        for done in (left, centres, pairs):
            remove(done)
        k *= 8


def _close(values: DataFrame) -> DataFrame:
    """values: s, fp, node, one row for each s and fp. a, b: nodes within two bits, by way of up to CENTRES nodes of each group around a common value."""
    masked = lines()
    keep = [~sum(1 << b for b in bits) & (2**64 - 1) for bits in masked]
    signed = [k - (1 << 64) if k >> 63 else k for k in keep]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for t, k in enumerate(signed)])
    rows = _spread(values).select("s", "fp", "node", F.explode(keys).alias("k")).select("s", "fp", "node", "k.t", "k.key")
    full = written(rows.groupBy("s", "t", "key").agg(F.count("*").alias("n")).where("n > 1").select("s", "t", "key"), "buckets")
    members = rows.join(_sized(full), ["s", "t", "key"], "left_semi")
    flips = F.element_at(F.create_map(*[F.lit(x) for t, bits in enumerate(masked) for x in (t, [0, *[(1 << b) - (1 << 64) if b == 63 else 1 << b for b in bits]])]), F.col("t"))
    near = members.select("s", "node", F.explode(flips).alias("flip"), "fp").select("s", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"), F.struct((F.col("flip") != 0).alias("off"), "node").alias("m"))
    # at most 65 fingerprints lie within one bit of a value, the one that equals it first
    groups = near.groupBy("s", "near").agg(F.array_sort(F.collect_set("m")).alias("all")).where("size(all) > 1")
    pairs = groups.select(F.explode("all").alias("x"), F.slice("all", 1, CENTRES).alias("c")).select(F.col("x.node").alias("x"), F.explode("c.node").alias("c"))
    return pairs.where("x <> c").select(F.least("x", "c").alias("a"), F.greatest("x", "c").alias("b"))


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, sets: int = SETS) -> DataFrame:
    """doc_id, text_hash, group_id (its smallest doc_id), first (whether the row's doc_id and text are the group's representative).

    Texts are linked if the sets of their word shingles have at least this Jaccard similarity. First candidates agree in
    all but two bits of one of ``sets`` fingerprints over words. Then all that share a shingle of their prefixes, as any
    two of this similarity do, are compared unless links join them already, so no link between groups is missed. Texts
    of equal words are one node throughout. Shingles are known by 64-bit hashes.
    """
    shared = _frequent(docs, size)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _profile_udf(size, similarity, sets, shared)("text").alias("p"))
    rows = written(rows.select("doc_id", "text_hash", "p.*"), "profiles")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.min("fps").alias("fps"), F.min("n").alias("n"), F.min("bits").alias("bits"))
    nodes = written(nodes, "nodes")
    members = written(_members(rows, similarity), "members")
    each = nodes.select("node", F.posexplode("fps").alias("s", "fp"))
    least = written(each.groupBy("s", "fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "least")
    equal = each.join(least.where("n > 1"), ["s", "fp"]).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = written(equal.unionByName(_close(least.select("s", "fp", F.col("least").alias("node")))).distinct(), "pairs")
    check = _Verifier(docs, nodes, size, similarity)
    near = check(pairs)
    found = _complete(members, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).limit(0) if near is None else near, check, similarity)
    rooted = nodes.join(found, "node", "left").select("node", "row", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("row").alias("first"), F.min("row.doc_id").alias("group_id"))
    labels = written(rooted.join(first, "root").select("node", "first", "group_id"), "labels")
    out = rows.join(labels, "node")
    return out.select("doc_id", "text_hash", "group_id", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("first"))


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8, sets: int = SETS) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id; of repeated rows one."""
    d, t = fresh(docs, "_d"), fresh(docs, "_t")
    first = near_copies(docs, size, similarity, sets).where("first").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct()
    keyed = docs.withColumns({fresh(docs, "_k"): F.xxhash64("text")})
    k = keyed.columns[-1]
    both = keyed.join(first, keyed["doc_id"].eqNullSafe(first[d]) & (keyed[k] == first[t]), "left_semi")
    return both.dropDuplicates(["doc_id", k]).drop(k)
