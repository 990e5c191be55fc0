"""Nearest neighbours: numerics, codes, the fitted plan and its share of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import ann

KIND = "vec_id long, embedding array<double>"


def nearest(x, q, k=10):
    with np.errstate(over="ignore"):
        big = np.abs(x).max()
        d = np.sqrt((((x - x[q]) / big) ** 2).sum(1)) * big
    order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]
    return [(i, d[i]) for i in order]


@pytest.mark.parametrize("scale, apart", [(1e8, 1.0), (1e200, 1e199), (1e-200, 1e-201), (1e12, 1e-3)])
def test_large_small_and_close_vectors(spark, scale, apart):
    r = np.random.default_rng(8)
    x = scale * np.ones(12) + apart * r.standard_normal((300, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    rows = ann.search(df, df.where("vec_id in (3, 17)"), plan=ann.Plan(1, 1, 2, 1.0, 1.0)).orderBy("query_id", "rank").collect()
    for q in (3, 17):
        assert [(g.vec_id, pytest.approx(g.score, rel=1e-9)) for g in rows if g.query_id == q] == nearest(x, q)


def test_lengths_far_apart_in_one_table(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((120, 5)) * 10.0 ** r.integers(-150, 150, (120, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    rows = ann.search(df, df.where("vec_id < 6")).orderBy("query_id", "rank").collect()
    for q in range(6):
        mine = [g for g in rows if g.query_id == q]
        assert [g.score for g in mine] == pytest.approx([d for _, d in nearest(x, q)], rel=1e-9) and len({g.vec_id for g in mine}) == 10


def test_codes_agree_with_their_own_first_probe():
    x = ann.unified(np.random.default_rng(1).standard_normal((50, 20)), None)
    for bits in (1, 3, 6, 8, 13):
        for table in (0, 3):
            one, many = ann.codes(x, table, bits), ann.codes(x, table, bits, 40)
            assert (one[:, 0] == many[:, 0]).all() and (one >> ann.SHIFT == table).all() and ((one & ((1 << ann.SHIFT) - 1)) < 1 << bits).all()
            for row in many:
                row = row[row >= 0]
                assert len(row) == min(40, 1 << bits) and len({*row.tolist()}) == len(row)


def clustered(n):
    r = np.random.default_rng(3)
    centres = r.standard_normal((n // 50, 32))
    return centres[r.integers(0, len(centres), n)] + 0.15 * r.standard_normal((n, 32))


def test_share_of_rows_falls_as_rows_grow(spark, monkeypatch):
    shares = []
    for n in (2_000, 16_000):
        plans, fit = [], ann.fit
        monkeypatch.setattr(ann, "fit", lambda *a, **k: plans.append(fit(*a, **k)) or plans[-1])
        x = clustered(n)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
        rows = ann.search(df, df.where(F.col("vec_id") % 100 == 0)).collect()
        monkeypatch.setattr(ann, "fit", fit)
        found = {}
        for g in rows:
            found.setdefault(g.query_id, set()).add(g.vec_id)
        assert np.mean([len(found[q] & {i for i, _ in nearest(x, q)}) / 10 for q in range(0, n, 100)]) >= 0.9
        shares.append(plans[0].share)
    assert shares[1] < 0.1 and shares[1] < 0.6 * shares[0]


def test_many_equal_vectors_are_split_and_found(spark):
    x = np.concatenate([np.tile([[1.0, 2.0, 3.0, 4.0]], (60, 1)), np.random.default_rng(5).standard_normal((120, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND)
    rows = ann.search(df, df.where("vec_id in (5, 100)"), cell=8).orderBy("query_id", "rank").collect()
    for q in (5, 100):
        assert [g.vec_id for g in rows if g.query_id == q] == [i for i, _ in nearest(x, q)]
