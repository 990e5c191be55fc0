"""Blocks of token numbers against rows of strings, on odd texts, and what an expansion writes."""

import random
import re

from pyspark.sql import functions as F

from termweave import session
from termweave.functions import text as T
from termweave.operators import blocks as B
from termweave.operators import match, mine, score
from termweave.plans.expand import Params, expand

POOL = "robo zeta zeta vision city of the smart d'or it’s café CAFÉ naïve x ab 5 9lives AI_x don't CrimeGPT crimegpt AI-driven Divya Drishti http://a.b/robo-zeta www.c.d ΣΑΣ éte ﬁn x İx . , \n".split(" ")
COLUMNS = "relid long, title string, heading string, ministry_raw string, release_date string, body_text string"


def releases(spark, n=160, seed=3):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(POOL) for _ in range(k))
    rows = [(i, text(4), text(2) if i % 3 else None, "m", "2024-01-01", text(25) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def test_hits_are_those_of_the_index(spark):
    docs = releases(spark)
    terms = ["robo", "zeta vision", "cafe", "naive", "d or", "it s", "AI", "smart city of the", "ete", "nothing", "é", "9lives robo zeta vision city", "Zeta-Vision", "σας"]
    got = {(r.term, r.relid) for r in B.hits(B.blocks(docs), terms).collect()}
    assert got == {(r.term, r.relid) for r in match.phrase_hits(match.indexed(docs), terms).collect()} and len({t for t, _ in got}) > 8


def test_index_form_is_that_of_the_text_function(spark):
    texts = [*POOL, " ".join(POOL), "ẞ ſ K ÀÉ àb ǅ ½ Ⅷ ٣ 中文 é’s Ά Ω"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalised("t").alias("n")).collect()
    for r in rows:
        assert [w.translate(B._FOLD) for w in B.index_tokens(r.t.lower())] == r.n.split()


def test_a_round_against_rows(spark):
    """Names, phrases with an apostrophe and plain ones, counted as rows of strings alone."""
    docs = releases(spark)
    seeds = ("robo", "smart", "naive")
    e = expand(docs, Params(seeds=seeds, rounds=1, near=False, min_lift=0.5, top_phrases=5, max_df=0.9), whole=True)
    parents = match.phrase_hits(match.indexed(docs), seeds)
    texts = docs.join(parents.select("relid").distinct(), "relid", "left_semi").select("relid", T.document("title", "body_text").alias("text"))
    known = spark.createDataFrame([(s,) for s in seeds], "key string")
    posts = mine.supported(mine.candidates(texts), known, ["intelligence"], 3)
    support = score.support(posts.select("key", "relid"), parents, 3)
    names = mine.dimension(posts.join(support.select("key").distinct(), "key", "left_semi"))
    hits = match.phrase_hits_by_gram(match.indexed(docs), names.select(F.col("surface").alias("term")))
    matched = parents.select("relid").distinct()
    sizes = parents.groupBy(F.col("term").alias("parent")).agg(F.count("*").alias("parent_docs"))
    scored = score.scored(support, names, score.reach(hits, matched, docs.count(), 0.9), sizes, docs.count(), matched.count())
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(e.support) == rows(support)
    assert rows(e.scored) == rows(scored)
    assert {"d'or", "crimegpt", "ai-driven"} <= {r.key for r in e.support.collect()}
    taken = score.taken(scored, 0.5, 5)
    assert rows(e.taken.select(*taken.columns)) == rows(taken)
    pruned = expand(docs, Params(seeds=seeds, rounds=1, near=False, min_lift=0.5, top_phrases=5, max_df=0.9))
    assert rows(pruned.taken.select(*taken.columns)) == rows(taken) and pruned.support is None


def test_small_blocks_and_parts_count_the_same(spark):
    docs = releases(spark).repartition(3)
    made = B.blocks(docs)
    one = sorted(map(tuple, B.counted(made, ["robo", "smart"], ["robo", "smart"], ["robo"], 3, None, 1).select("h", "parent", "in_parent", "corpus", "new").collect()))
    small = B.blocks(docs, 7)
    assert small.count() > 20
    got = sorted(map(tuple, B.counted(small, ["robo", "smart"], ["robo", "smart"], ["robo"], 3, None, 400_000_000).select("h", "parent", "in_parent", "corpus", "new").collect()))
    assert got == one and got


def test_plain_phrases_are_never_written_as_rows(spark):
    """What was written for each round: a row for each phrase of each text, and for each hit of each candidate."""
    texts = ["robo zeta vision x"] * 5 + ["zeta vision alone"] * 3 + ["vision only"] * 2 + ["plain words here"] * 30
    rows = [(i, "t", "", "m", "2024-01-01", t) for i, t in enumerate(texts)]
    before = set(session._WRITTEN.get(spark.sparkContext.applicationId, []))
    e = expand(spark.createDataFrame(rows, COLUMNS), Params(seeds=("robo",), rounds=2, max_df=0.5, near=False))
    made = {re.sub(r".*/([a-z_]+)-[0-9a-f]{32}$", r"\1", p) for p in set(session._WRITTEN[spark.sparkContext.applicationId]) - before}
    assert not made & {"postings", "hits", "index"} and {r.term for r in e.terms.collect()} >= {"robo", "zeta"}


def test_gram_counts_are_those_of_rows(spark):
    texts = releases(spark).select(F.col("body_text").alias("text"))
    want = texts.select(F.explode(T.grams(T.tokens("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    got = B.gram_counts(texts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("gram like '%d''or%'").count()
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
