"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (summed before the shuffle) and a join of all edges with those minima, so a node with
very many edges is split by adaptive skew joins; nothing is gathered on the driver but whether to go on. Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.session import gathered, remove, written


def components(edges: DataFrame) -> DataFrame:
    """edges: src, dst (long). node, root of every node that has an edge to another: root is the component's smallest node."""
    now = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    rows = 2 * now.count()
    while not _stars(now, rows):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = written(gathered(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), rows), "least")
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large_ = written(gathered(large, rows), "large")
        small = written(gathered(large_.groupBy("src").agg(F.min("dst").alias("m")), rows), "small")
        joined = large_.join(small, "src")
        nxt = joined.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small.select("src", F.col("m").alias("dst")))
        new = written(gathered(nxt.distinct(), rows), "edges")
        for old in (now, least, large_, small):
            remove(old)
        now = new
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return gathered(now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots), rows)


def _stars(edges: DataFrame, rows: int) -> bool:
    """Whether each node has one edge to a smaller node that has none itself."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return gathered(bad, rows).limit(1).count() == 0
