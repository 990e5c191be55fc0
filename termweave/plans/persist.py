"""From an expansion to the durable catalogue: terms upserted, matches and edges rebuilt, and views over what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators import match, publish
from termweave.plans.expand import Expansion
from termweave.sources import sinks
from termweave.sources.store import Store


def persist(store: Store, e: Expansion) -> None:
    """terms: the run's rows replace those of the same name, keeping status and reviewer of what was accepted and notes;
    term_parents and term_matches: built anew; doc_freq: the confirmed count of an accepted term."""
    prior = store.read("terms")
    n = e.term_docs.groupBy("term").agg(F.count("*").cast("int").alias("n"))
    rows = publish.statuses(e.terms, prior).join(n, "term", "left").select(
        "term", "round", F.col("primary").alias("parent_term"), "status", "reviewed_by", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("reviewed_at"),
        F.lit(None).cast("double").alias("lift_score"), F.coalesce("n", F.lit(0)).alias("doc_freq"), F.lit(None).cast("int").alias("novel_docs"), "channel",
    )
    accepted = rows.where("status = 'accepted'").select("term")
    store.replace("term_matches", match.confirmed(e.releases, e.term_docs.join(accepted, "term", "left_semi").select("term", "relid")))
    store.replace("term_parents", e.edges.withColumn("docs_in_parent", F.col("docs_in_parent").cast("int")))
    store.upsert("terms", sinks.set_counts(sinks.keep_note(rows, prior), store.read("term_matches")), "term")


def views(store: Store, releases: DataFrame) -> dict[str, DataFrame]:
    """The five views by name, over the stored tables; also as temporary views of the session."""
    made = publish.views(store.read("terms"), store.read("term_matches"), releases)
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return made


def worth_reading(tree: DataFrame, least: int = 15) -> DataFrame:
    """Of the expansion tree the candidates of so many releases."""
    return tree.where((F.col("status") == "candidate") & (F.col("releases_matched") >= least)).select("seed", "extended_term", "channel", "releases_matched").orderBy("seed", F.desc("releases_matched"), "extended_term")


def printed(made: dict[str, DataFrame], rows: int = 1000) -> str:
    """The views as text, a heading above each: years, accepted terms, yield, and candidates for review."""
    shown = {
        "hits per year": made["v_hits_by_year"].select("year", F.col("ai_releases").alias("distinct_releases"), F.col("ai_mentions").alias("total_keyword_mentions")),
        "accepted terms": made["v_accepted_keywords"].select("term", "round", F.col("reviewed_by").alias("origin"), "channel", "releases_matched"),
        "releases per term": made["v_keyword_yield"].select("term", "releases_matched", "total_mentions", "round"),
        "candidates under their seed": worth_reading(made["v_expansion_tree"]),
    }
    return "\n".join(f"# {title}\n{df._jdf.showString(rows, 0, False)}" for title, df in shown.items())
