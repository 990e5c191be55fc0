"""The reports of an expansion, written under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T  # noqa: N812
from termweave.operators import publish
from termweave.plans.expand import Expansion
from termweave.sources import sinks


def examples(e: Expansion, width: int = 60, most: int = 160) -> DataFrame:
    """term, example_context: the first occurrence in the first release, by relid, that has the term as a whole word."""
    texts = e.releases.select("relid", T.document("title", "body_text").alias("text"))
    rows = e.term_docs.select("term", "relid").join(texts, "relid").withColumn("rx", T.whole_word_of(F.col("term")))
    hits = rows.where("regexp_like(text, rx)").groupBy("term").agg(F.min_by(F.struct("text", "rx"), "relid").alias("x")).select("term", "x.text", "x.rx")
    hits = hits.withColumns({"at": T.offset_of(F.col("text"), F.col("rx")), "n": F.length(F.expr("regexp_extract(text, rx, 0)"))})
    start = F.greatest(F.col("at") - width, F.lit(0))
    around = F.substring("text", start + 1, F.col("at") + F.col("n") + width - start)
    return hits.select("term", F.substring(F.trim(F.regexp_replace(around, r"(?U)\s+", " ")), 1, most).alias("example_context"))


def write(e: Expansion, path: str, seeds: int, url: str = "") -> None:
    """Six reports: seeds, terms, matches, pool and rounds as CSV, the tree as text. url: template of a release's address, with {id}."""
    first = e.terms.where(F.col("pos") <= seeds).select(F.col("pos").alias("n"), "term")
    hits = e.term_docs.join(first.select("term"), "term", "left_semi").select("term", "relid")
    share = {"pct_of_window": sinks.percent(F.col("pct_of_window"))}
    sinks.write_csv(publish.seed_yield(hits, first, e.window_n).withColumns(share).orderBy("n"), f"{path}/01_seed_terms")
    terms = publish.terms_all(e.terms, e.term_docs, e.edges).join(examples(e), "term", "left")
    sinks.write_csv(terms.join(e.terms.select("term", "pos"), "term").orderBy("pos").drop("pos"), f"{path}/02_terms")
    sinks.write_csv(publish.release_matches(e.term_docs, e.terms, e.releases).orderBy("relid", "matched_term"), f"{path}/03_release_terms")
    pool = publish.releases_pool(e.term_docs, e.releases).withColumn("url", F.replace(F.lit(url), F.lit("{id}"), F.col("relid").cast("string")))
    sinks.write_csv(pool.orderBy("relid"), f"{path}/04_releases")
    sinks.write_csv(publish.round_summary(e.terms, e.term_docs, e.window_n).withColumns(share).orderBy("round"), f"{path}/05_rounds")
    n = e.term_docs.groupBy("term").agg(F.count("*").alias("n"))
    found = e.term_docs.agg(F.countDistinct("relid").alias("n"))
    line = F.format_string("window: %d releases    pool: %d releases (%.1f%%)", F.lit(e.window_n), F.col("n"), F.col("n") * 100.0 / F.lit(float(max(1, e.window_n))))
    sinks.write_text(found.select(F.lit("").alias("pos"), line.alias("line")).unionByName(publish.provenance_tree(e.terms.join(n, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))), seeds)), f"{path}/06_tree")
