"""Mining: candidates by name shape, by nearness to a term, and by phrase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T


def ranked(names: DataFrame, channel: int) -> DataFrame:
    """names: relid, x (a name in the form of ``shapes``). key, relid, surface, kind, rank of those of three characters or more."""
    rank = F.struct(F.lit(channel).alias("channel"), F.col("x.sub").alias("sub"), F.col("x.at").alias("at"))
    return names.where(F.length("x.surface") >= 3).select(F.lower("x.surface").alias("key"), "relid", "x.surface", "x.kind", rank.alias("rank"))


def phrases(rows: DataFrame) -> DataFrame:
    """rows with a key that is a phrase: with surface, kind and a rank after all names."""
    kind = F.concat((F.length("key") - F.length(F.replace("key", F.lit(" "), F.lit(""))) + 1).cast("string"), F.lit("-gram"))
    rank = F.struct(F.lit(3).alias("channel"), F.lit(0).alias("sub"), F.lit(0).alias("at"))
    return rows.select("*", F.col("key").alias("surface"), kind.alias("kind"), rank.alias("rank"))


def _firsts(names: Column) -> Column:
    """Of an array of names those whose key didn't come before; texts hold few names."""
    return F.filter(names, lambda x, i: F.array_position(names["key"], x["key"]) == i + 1)


def _names(anchors: Sequence[str]) -> Column:
    def channel(number: int, names: Column) -> Column:
        long = F.filter(names, lambda x: F.length(x["surface"]) >= 3)
        return F.transform(long, lambda x: F.struct(F.lower(x["surface"]).alias("key"), x["surface"].alias("surface"), x["kind"].alias("kind"), F.struct(F.lit(number).alias("channel"), x["sub"].alias("sub"), x["at"].alias("at")).alias("rank")))

    names = channel(1, T.shapes("text"))
    return F.concat(names, channel(2, T.near_names(anchors)("text"))) if anchors else names


def names(texts: DataFrame, anchors: Sequence[str] = ()) -> DataFrame:
    """texts: relid, text. key, relid, surface, kind, rank: each name's key of a text once, as it is first met by channel and place."""
    rows = texts.select("relid", _names(anchors).alias("names")).select("relid", F.explode(_firsts(F.col("names"))).alias("x"))
    return rows.select("x.key", "relid", "x.surface", "x.kind", "x.rank")


def candidates(texts: DataFrame, anchors: Sequence[str] = ()) -> DataFrame:
    """Names and phrases, in the form of ``names``."""
    rows = texts.select("relid", _names(anchors).alias("names"), T.grams(T.tokens("text")).alias("grams"))
    rows = rows.select("relid", _firsts(F.col("names")).alias("names"), "grams")
    # a phrase that is also a name's key gives way to it, so no key of a text comes twice
    grams = phrases(rows.select("relid", F.explode(F.array_except("grams", F.col("names")["key"])).alias("key")))
    return rows.select("relid", F.explode("names").alias("x")).select("x.key", "relid", "x.surface", "x.kind", "x.rank").unionByName(grams)


def supported(found: DataFrame, known: DataFrame, blocked: Sequence[str], least: int) -> DataFrame:
    """The candidates that are neither known (key) nor blocked and stand in ``least`` texts at least: no other can in any parent."""
    fresh = found.join(known, "key", "left_anti").where(~F.col("key").isin(*blocked))
    enough = fresh.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
    return fresh.join(enough, "key", "left_semi")


def dimension(found: DataFrame) -> DataFrame:
    """key, surface, kind: as the key is first met, by relid and then place."""
    first = F.struct("relid", "rank", "surface")
    return found.groupBy("key").agg(F.min_by("surface", first).alias("surface"), F.min_by("kind", first).alias("kind"))
