"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from termweave.queries import ORACLE, QUERIES

DATA = "/root/testdata"
#: Queries that are also run where the window holds documents, which it doesn't on the smallest tables.
LARGER = ("seed_yield", "phrase_match_by_gram", "confirm_vs_index", "round_summary", "terms_all", "releases_pool", "ai_pool", "topk_phrases_per_parent", "governor_replay", "keyword_yield", "expand_from_accepted", "candidates_worth_reading", "resume_queue")
TABLES = "documents pages events labels benchmark".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize(("name", "size"), [(n, "sf0.001") for n in sorted(QUERIES)] + [(n, "sf0.01") for n in LARGER])
def test_query(spark, name, size):
    con = connect(f"{DATA}/{size}")
    df = QUERIES[name](spark, f"{DATA}/{size}")
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLE:
        return
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
