"""Scoring one round's candidates against their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def support(posts: DataFrame, parents: DataFrame, least: int) -> DataFrame:
    """parent, key, in_parent of at least ``least``. posts: key, relid without repeats; parents: term, relid."""
    pairs = posts.join(parents.select(F.col("term").alias("parent"), "relid"), "relid")
    return pairs.groupBy("parent", "key").agg(F.count("*").alias("in_parent")).where(F.col("in_parent") >= least)


def reach(hits: DataFrame, matched: DataFrame, window_n: int, most: float) -> DataFrame:
    """term, corpus (documents), new (those not matched yet); terms that add none or stand in over a share of the window go."""
    seen = matched.select("relid", F.lit(1).alias("seen"))
    counts = hits.join(seen, "relid", "left").groupBy("term").agg(F.count("*").alias("corpus"), F.count_if(F.col("seen").isNull()).alias("new"))
    return counts.where((F.col("new") >= 1) & (F.col("corpus") <= most * window_n))


def rated(rows: DataFrame, window_n: int, matched_n: int) -> DataFrame:
    """rows (in_parent, parent_docs, new) with lift and share."""
    rest = float(max(1, window_n - matched_n))
    share = F.col("in_parent") / F.col("parent_docs")
    return rows.withColumns({"lift": share / (F.col("new") / F.lit(rest)), "share": share})


SCORED = ("parent", "key", "term", "kind", "in_parent", "corpus", "new", "lift", "share")


def scored(support_: DataFrame, names: DataFrame, reach_: DataFrame, parent_sizes: DataFrame, window_n: int, matched_n: int) -> DataFrame:
    """parent, key, term, kind, in_parent, corpus, new, lift, share."""
    rows = support_.join(names, "key").withColumnRenamed("surface", "term").join(reach_, "term").join(parent_sizes, "parent")
    return rated(rows, window_n, matched_n).select(*SCORED)


def taken(rows: DataFrame, least_lift: float, top: int) -> DataFrame:
    """All name shapes and names, and each parent's ``top`` phrases of enough lift; grp 0 or 1, rank within both, ties by key."""
    phrase = F.col("kind").endswith("gram")
    rows = rows.withColumn("grp", phrase.cast("int")).where(~phrase | (F.col("lift") >= least_lift))
    order = Window.partitionBy("parent", "grp").orderBy(F.desc("lift"), F.desc("new"), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("grp") == 0) | (F.col("rank") <= top))


def new_terms(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """term, kind, primary (parent of the largest share, ties to the earliest), first (when it came in). parents: parent, parent_pos."""
    rows = rows.join(parents, "parent")
    best = F.min_by("parent", F.struct((-F.col("share")).alias("s"), F.col("parent_pos").alias("p")))
    return rows.groupBy("term").agg(F.first("kind").alias("kind"), best.alias("primary"), F.min(F.struct("parent_pos", "grp", "rank")).alias("first"))
