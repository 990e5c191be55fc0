import pytest
from pyspark.sql import functions as F

from termweave.operators import publish, score
from termweave.plans.expand import Params, expand
from termweave.sources import sinks, tables


def docs(spark, texts):
    rows = [(i, "t", "", "m", f"202{4 + i % 2}-01-01", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "relid long, title string, heading string, ministry_raw string, release_date string, body_text string")


@pytest.fixture(scope="module")
def run(spark):
    texts = ["robo zeta vision x"] * 5 + ["zeta vision alone"] * 3 + ["vision only"] * 2 + ["plain words here"] * 30
    return expand(docs(spark, texts), Params(seeds=("robo", "absent"), rounds=3, max_df=0.5))


def test_rounds(run):
    terms = {r.term: r for r in run.terms.collect()}
    assert terms["zeta"].primary == "robo" and terms["zeta"].round == 1 and "plain" not in terms
    rows = publish.round_summary(run.terms, run.term_docs, run.window_n).orderBy("round").collect()
    assert rows[0].new_releases_found == 5 and [r.cumulative_releases for r in rows] == sorted(r.cumulative_releases for r in rows)
    assert all(r.docs_in_parent >= 3 for r in run.edges.collect())


def test_names_stand_near_any_parent(spark):
    """Also near one that few texts match, beyond the first thirty parents."""
    seeds = [f"seed{k}x" for k in range(36)]
    texts = [f"{t} here" for t in seeds[:35] for _ in range(4)] + [f"{seeds[35]} and Divya Sagar tool"] * 3 + ["Divya Sagar alone"] * 2 + ["plain"] * 90
    e = expand(docs(spark, texts), Params(seeds=tuple(seeds), rounds=1))
    assert ("Divya Sagar", "near-AI name", seeds[35]) in {(r.term, r.kind, r.primary) for r in e.terms.collect()}


def test_first_discovery(run):
    found = {r.relid: r.discovered_in_round for r in publish.discovered(run.term_docs).collect()}
    assert all(found[i] == 0 for i in range(5)) and found[5] == 1


def test_tree(run):
    n = run.term_docs.groupBy("term").agg(F.count("*").alias("n"))
    lines = [r.line for r in publish.provenance_tree(run.terms.join(n, "term", "left").fillna({"n": 0}), 2).orderBy("pos").collect()]
    assert lines[0] == "robo  [seed, r0, 5 releases]" and lines[1].startswith("    ") and lines[-1] == "absent  [seed, r0, 0 releases]"


def test_lift(spark):
    support = spark.createDataFrame([("p", "k", 5)], "parent string, key string, in_parent long")
    names = spark.createDataFrame([("k", "K", "1-gram")], "key string, surface string, kind string")
    reach = spark.createDataFrame([("K", 9, 4)], "term string, corpus long, new long")
    sizes = spark.createDataFrame([("p", 10)], "parent string, parent_docs long")
    assert score.scored(support, names, reach, sizes, 100, 20).first().lift == pytest.approx(10.0)


def test_boilerplate_is_strictly_above(spark):
    hits = spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(26)], "term string, relid long")
    none = spark.createDataFrame([], "relid long")
    assert [r.term for r in score.reach(hits, none, 100, 0.25).collect()] == ["a"]


def test_primary_parent_ties_go_to_the_first(spark):
    parents = spark.createDataFrame([("P1", 1), ("P2", 2), ("P3", 3)], "parent string, parent_pos int")
    rows = spark.createDataFrame([("P1", "t", 0.5, 1), ("P2", "t", 0.5, 1), ("P3", "t", 0.6, 1)], "parent string, term string, share double, rank int").withColumns({"kind": F.lit("1-gram"), "grp": F.lit(1)})
    assert score.new_terms(rows, parents).first().primary == "P3"
    assert score.new_terms(rows.where("parent <> 'P3'"), parents).first().primary == "P1"


def test_hits_by_year_counts_rows(spark):
    matches = spark.createDataFrame([("a", 1, 3), ("b", 1, 1), ("a", 2, 1)], "term string, relid long, match_count int")
    releases = spark.createDataFrame([(1, "2024-01-01"), (2, "2025-01-01")], "relid long, release_date string")
    assert [tuple(r) for r in publish.hits_by_year(matches, releases).collect()] == [("2024", 1, 2), ("2025", 1, 1), ("TOTAL", 2, 3)]


def test_yield_keeps_terms_without_matches(spark):
    terms = spark.createDataFrame([("x", 0, "seed", None, "accepted")], "term string, round int, channel string, parent_term string, status string")
    row = publish.keyword_yield(terms, spark.createDataFrame([], "term string, relid long, match_count int")).first()
    assert row.releases_matched == 0 and row.total_mentions is None


def test_routing(spark):
    log = spark.createDataFrame([(1, None, 5, "e"), (2, 302, 2000, None), (3, 302, 2001, None), (4, 404, 1, None), (5, 200, 1, None)], "relid long, http_status int, elapsed_ms int, err string")
    got = {r.relid: (r.parse_status, r.parse_warnings) for r in tables.routed(log).collect()}
    assert got == {1: ("failed", ["transport", "e"]), 2: ("absent", []), 4: ("failed", ["http_404"]), 5: ("page", [])}


def test_upsert_and_notes(spark):
    old = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, n int, v string")
    new = spark.createDataFrame([(1, 2)], "k int, n int")
    assert {(r.k, r.v) for r in sinks.upsert_latest(old, new, "k", "n").collect()} == {(1, None), (2, "y")}
    terms = spark.createDataFrame([("a", "c1"), ("b", "c2")], "term string, channel string")
    assert {r.term: r.note for r in sinks.keep_note(terms, spark.createDataFrame([("a", "mine")], "term string, note string")).collect()} == {"a": "mine", "b": "c2"}
