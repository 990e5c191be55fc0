"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates vectors by sign flips and Hadamard transforms, three times, and assigns each to the signed axis that is
nearest. Several rotations give several axes, the last one of fewer dimensions, which are joined into one code of as
many bits as the plan says, so buckets keep their size while the rows grow. A query probes the codes whose axes are
nearest to it in each table. A bucket's rows and the queries that probe it meet in one group and are ranked exactly, by
Euclidean distance in double precision on the vectors as given; each group passes on its nearest k at most. Buckets of
over ``CELL`` rows are split by a hash of the id, so a vector that a third of all rows share is spread; the queries are
sent to all parts.

The plan (bits, tables, probes) is fitted: the true neighbours of at most ``SAMPLE`` queries are found by brute force
over all rows, and of the plans whose probes meet ``RECALL`` of them the one that looks at the fewest rows is taken. So
where vectors have near neighbours few buckets are enough, and where they have none most of the rows are looked at, as
any search must. Every row is indexed.

A query with fewer than k found meets every bucket of one table in a second run, so small tables give all that they have.

Hashing sees directions. Where lengths differ by over 1 %, vectors get another coordinate that makes their lengths equal.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with
null ids; vectors meet only those of their own number of components. Rows that repeat an id with the same vector count
once; of different vectors under one id the nearest counts, and as a query the first in order. Any finite length will
do; a distance beyond the range of doubles is infinite. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.session import written

K = 10
CELL = 2048
#: Queries by which the plan is fitted, the share of their true neighbours that it must meet, and codes that a query may probe in a table.
SAMPLE, RECALL, MOST = 64, 0.96, 512
#: Rows that a bucket should hold, and what one more bucket costs a query, in rows.
ROWS, TOLL = 256, 32
TABLES = 6
#: A table's number stands above the bits of its codes.
SHIFT = 48
#: Lengths are handled in this unit, so that their squares stay in range.
UNIT = 2.0**-20


# -- hashing ----------------------------------------------------------------------------------------------------------
def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the width is a power of two."""
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@cache
def _signs(table: int, part: int, width: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([table, part, width]))
    return rng.choice([-1.0, 1.0], (3, width))


def width_of(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def rotate(x: np.ndarray, table: int, part: int = 0) -> np.ndarray:
    """One pseudo-rotation of a table, after padding to a power of two."""
    width = width_of(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for signs in _signs(table, part, width):
        x = hadamard(x * signs)
    return x


def parts_of(bits: int, width: int) -> list[int]:
    """Bits of each axis of a code: a full one has 1 + log2(width), the last what is left."""
    full = width.bit_length()
    return [full] * (bits // full) + [bits % full] * (bits % full > 0)


def codes(x: np.ndarray, table: int, bits: int, probes: int = 1) -> np.ndarray:
    """The codes of each row whose axes are nearest, nearest first; -1 where there are no more."""
    out, far, have = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1)), 0
    for part, b in enumerate(parts_of(bits, width_of(x.shape[1]))):
        r = rotate(x, table, part)[:, : 1 << (b - 1)]
        ends = np.stack([r, -r], 2).reshape(len(x), -1)  # 2 * axis, + 1 for its negative end
        off = (ends.max(1, keepdims=True) - ends) ** 2
        some = np.argsort(off, axis=1, kind="stable")[:, :probes]
        off = np.take_along_axis(off, some, 1)
        far = (far[:, :, None] + off[:, None, :]).reshape(len(x), -1)
        out = (out[:, :, None] + (some[:, None, :] << have)).reshape(len(x), -1)
        if far.shape[1] > probes or part:
            best = np.argsort(far, axis=1, kind="stable")[:, :probes]
            far, out = np.take_along_axis(far, best, 1), np.take_along_axis(out, best, 1)
        have += b
    out = out + (table << SHIFT)
    return np.pad(out, ((0, 0), (0, probes - out.shape[1])), constant_values=-1)


def unified(x: np.ndarray, top: float | None) -> np.ndarray:
    """Rows of length 1; with top, the greatest length in UNIT, of equal length by another coordinate."""
    if top is not None:
        x = np.ldexp(x, -20) / top
        return np.concatenate([x, np.sqrt(np.maximum(1 - (x**2).sum(1, keepdims=True), 0))], 1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each number of components."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


@dataclass(frozen=True)
class Plan:
    """bits of a code, tables, codes probed in each; recall and share: of the sample's true neighbours met and of rows looked at, repeats included, as estimated."""

    bits: int
    tables: int
    probes: int
    recall: float
    share: float


def codes_udf(plan: Plan, probes: int, top: float | None):
    """Vector to the codes of each table, table after table."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            out: list = [None] * len(vectors)
            for rows, x in _matrices(vectors):
                for lo in range(0, len(rows), 256):
                    y = unified(x[lo : lo + 256], top)
                    each = np.concatenate([codes(y, t, plan.bits, probes) for t in range(plan.tables)], 1)
                    for r, c in zip(rows[lo : lo + 256].tolist(), each):
                        out[r] = c[c >= 0]
            yield pa.array(out, pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<long>").asNondeterministic()


# -- exact ranking ----------------------------------------------------------------------------------------------------
def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, taken in units of each pair's greatest difference so that no square leaves the range."""
    big = np.maximum(np.abs(a).max(-1), np.abs(b).max(-1))
    down = -np.frexp(big)[1] - 1  # powers of two change no digit
    diff = np.ldexp(a, down[..., None]) - np.ldexp(b, down[..., None])
    more = np.frexp(np.abs(diff).max(-1))[1]
    with np.errstate(over="ignore"):
        return np.ldexp(np.sqrt((np.ldexp(diff, -more[..., None]) ** 2).sum(-1)), more - down)


def nearest(a: np.ndarray, aid: np.ndarray, b: np.ndarray, bid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's row, place in b and distance of the k nearest ids other than its own of each row of a; ties to smaller ids. b: in order of bid."""
    ids = np.flatnonzero(np.concatenate(([True], bid[1:] != bid[:-1])))
    down = -int(np.frexp(max(np.abs(a).max(), np.abs(b).max()))[1])
    y = np.ldexp(b, down)
    middle = y.mean(0)  # differences don't change, and sums of squares lose less
    y = y - middle
    yy = (y**2).sum(1)
    found: tuple[list, list, list] = ([], [], [])
    for lo in range(0, len(a), 128):
        x = np.ldexp(a[lo : lo + 128], down) - middle
        xx = (x**2).sum(1)
        rough = xx[:, None] + yy - 2 * x @ y.T
        # what rounding can have done to each
        slack = 4e-16 * (b.shape[1] + 16) * (xx[:, None] + yy) + 1e-290
        own = aid[lo : lo + 128, None] == bid
        most = rough + slack
        most[own] = np.inf
        # an id with several vectors counts once, so the limit is that of k different ids
        least = most if len(ids) == len(bid) else np.minimum.reduceat(most, ids, axis=1)
        n = min(k, len(ids))
        limit = np.partition(least, n - 1, axis=1)[:, n - 1 : n]
        row, at = np.nonzero((rough - slack <= limit) & ~own)
        for s in range(0, len(row), 1 << 16):
            # blocks may divide a query's rows; what is cut here is cut again later
            r, c = row[s : s + (1 << 16)], at[s : s + (1 << 16)]
            exact = distances(a[lo + r], b[c])
            order = np.lexsort((bid[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            if len(ids) < len(bid):
                again = np.lexsort((np.arange(len(r)), bid[c], r))
                new = np.concatenate(([True], (r[again][1:] != r[again][:-1]) | (bid[c][again][1:] != bid[c][again][:-1])))
                keep = np.sort(again[new])
                r, c, exact = r[keep], c[keep], exact[keep]
            begin = np.searchsorted(r, r, "left")
            keep = np.arange(len(r)) - begin < k
            for part, v in zip(found, (lo + r[keep], c[keep], exact[keep])):
                part.append(v)
    return tuple(np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, (np.int64, np.int64, np.float64)))


def _sorted(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _in_cell(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = (t.column("v").combine_chunks() for t in (queries, rows))
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(q) and len(x):
            (_, a), (_, b) = next(_matrices(q)), next(_matrices(x))
            aid = queries.column("id").to_numpy()
            bid, b = _sorted(rows.column("id").to_numpy(), b)
            r, c, exact = nearest(a, aid, b, bid, k)
            out = (aid[r], bid[c], exact)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out))))

    return run


# -- the plan ---------------------------------------------------------------------------------------------------------
def _true(data: DataFrame, asked: list, k: int) -> list:
    """(query's place, id, v) of the k nearest ids of each of these queries, by brute force over all rows."""
    shared = data.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            for rows, x in _matrices(vectors):
                mine = [i for i, (_, v) in enumerate(shared.value) if len(v) == x.shape[1]]
                if mine:
                    a = np.array([shared.value[i][1] for i in mine])
                    bid, b = _sorted(ids[rows], x)
                    r, c, exact = nearest(a, np.array([shared.value[i][0] for i in mine]), b, bid, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(mine, np.int32)[r]), pa.array(bid[c]), pa.array(exact), pa.array(b[c].tolist(), pa.list_(pa.float64()))], names=["q", "id", "score", "v"]
                    )

    each = data.select("id", "v").mapInArrow(run, "q int, id long, score double, v array<double>")
    one = each.groupBy("q", "id").agg(F.min_by("v", F.struct("score", "v")).alias("v"), F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", "id")
    return one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "id", "v").collect()


def fit(data: DataFrame, asked: DataFrame, count: int, top: float | None, k: int = K) -> Plan:
    """The plan for these rows (id, v) and queries; count: of rows."""
    some = [(r["id"], r["v"]) for r in asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    near = _true(data, some, k) if some else []
    if not near:
        return Plan(1, 1, 2, 1.0, 1.0)
    pairs = [(unified(np.array([some[r["q"]][1]]), top), unified(np.array([r["v"]]), top)) for r in near]
    groups = [np.concatenate([np.concatenate(p) for p in pairs if p[0].shape[1] == d]).reshape(-1, 2, d) for d in {p[0].shape[1] for p in pairs}]
    best: tuple[float, Plan] | None = None
    for bits in range(1, max(1, min(SHIFT - 1, int(np.log2(max(2, count / ROWS))))) + 1):
        most = min(1 << bits, MOST)
        met = np.full((len(pairs), 0), MOST)
        for table in range(TABLES):
            place = []
            for g in groups:
                for lo in range(0, len(g), 64):
                    probed, mine = codes(g[lo : lo + 64, 0], table, bits, most), codes(g[lo : lo + 64, 1], table, bits)
                    hit = probed == mine
                    place.append(np.where(hit.any(1), hit.argmax(1), MOST))
            met = np.concatenate([met, np.concatenate(place)[:, None]], 1)
            first = np.sort(met.min(1))
            need = first[min(len(first) - 1, int(np.ceil(RECALL * len(first))) - 1)] + 1
            if need <= most:
                share = (table + 1) * need / (1 << bits)
                cost = share * count + (table + 1) * need * TOLL + 0.02 * (table + 1) * count
                if best is None or cost < best[0]:
                    best = cost, Plan(bits, table + 1, int(need), float((first < need).mean()), float(min(1.0, share)))
    return best[1] if best else Plan(1, 1, 2, 1.0, 1.0)


# -- search -----------------------------------------------------------------------------------------------------------
def usable(rows: DataFrame) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ok)


def _length():
    """A vector's length in UNIT."""
    big = F.array_max(F.transform("v", F.abs))
    return F.transform(F.array(big), lambda m: m * UNIT * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / m) * (x / m))))[0]


def search(rows: DataFrame, queries: DataFrame, k: int = K, plan: Plan | None = None, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row (both: vec_id, embedding), nearest first."""
    # vectors travel as they came; float32 holds what float32 columns held
    kind = "array<float>" if dict(rows.dtypes).get("embedding") == "array<float>" else "array<double>"
    data = written(usable(rows).distinct().select("id", F.col("v").cast(kind).alias("v")), "vectors")
    asked = written(usable(queries).groupBy("id").agg(F.min("v").alias("v")), "asked")
    count, low, high = data.select(F.col("v").cast("array<double>").alias("v")).agg(F.count("*"), F.min(_length()), F.max(_length())).first()
    top = None
    if count and high > 1.01 * low:
        top = max(high, asked.agg(F.max(_length())).first()[0] or 0.0)  # queries may be longer than any row
    plan = plan or fit(data, asked, count, top, k)
    indexed = written(data.select("id", "v", F.size("v").alias("d"), codes_udf(plan, 1, top)("v").alias("codes")), "indexed")
    sizes = indexed.select("d", F.explode("codes").alias("code")).groupBy("d", "code").agg(F.count("*").alias("n"))
    sizes = written(sizes.select("d", "code", F.ceil(F.col("n") / cell).cast("int").alias("parts")), "sizes")
    probing = asked.select("id", F.size("v").alias("d"), F.explode(codes_udf(plan, plan.probes, top)("v")).alias("code"))
    found = written(_ranked(indexed, asked, probing, sizes, k, kind), "found")
    few = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), F.col("id") == F.col("query_id"), "left_anti").select("id", "v")
    few = written(few, "few")
    if few.limit(1).count():
        every = few.select("id", F.size("v").alias("d")).join(sizes.where(F.shiftright("code", SHIFT) == 0).select("d", "code"), "d")
        rest = _ranked(indexed.withColumn("codes", F.slice("codes", 1, 1)), few, every, sizes, k, kind)
        found = found.join(few, F.col("query_id") == F.col("id"), "left_anti").unionByName(rest)
    return found


def _ranked(indexed: DataFrame, asked: DataFrame, probing: DataFrame, sizes: DataFrame, k: int, kind: str) -> DataFrame:
    """probing: id, d, code. Joins by (d, code) are by shuffle unless Spark finds the table of sizes small."""
    left = probing.join(sizes, ["d", "code"]).select("d", "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id")
    left = left.join(asked.select("id", F.col("v").cast(kind).alias("v")), "id").select("d", "code", "part", "id", "v")
    right = indexed.select("id", "v", "d", F.explode("codes").alias("code")).join(sizes, ["d", "code"])
    right = right.select("d", "code", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")
    keys = ("d", "code", "part")
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_in_cell(k), "query_id long, vec_id long, score double")
    best = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
