"""Sinks: keyed upserts, CSV and text artifacts, views."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Whole-row replacement: the row of the largest ``order`` stays for each key; columns that new lacks become null."""
    both = old.unionByName(new, allowMissingColumns=True)
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def keep_note(terms: DataFrame, prior: DataFrame) -> DataFrame:
    """terms with the note that a term had before, else its channel."""
    old = prior.select("term", F.col("note").alias("_note"))
    return terms.join(old, "term", "left").withColumn("note", F.coalesce("_note", "channel")).drop("_note")


def set_counts(terms: DataFrame, matches: DataFrame) -> DataFrame:
    """terms with doc_freq set to the confirmed count for accepted ones."""
    n = matches.groupBy("term").agg(F.count("*").cast("int").alias("_n"))
    freq = F.when(F.col("status") == "accepted", F.coalesce("_n", F.lit(0))).otherwise(F.col("doc_freq"))
    return terms.join(n, "term", "left").withColumn("doc_freq", freq).drop("_n")


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Schema evolution: the column, null, where it isn't there yet."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def json_text(values: Sequence[str]) -> str:
    return json.dumps(list(values))


def json_list(values: Column) -> Column:
    """An array of strings as JSON text, a space after each comma."""
    inner = F.transform(values, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))


def to_edge(df: DataFrame) -> DataFrame:
    """Arrays of strings as JSON text, for stores and readers that know no arrays."""
    return df.withColumns({c: json_list(F.col(c)) for c, t in df.dtypes if t == "array<string>"})


def from_edge(df: DataFrame, *columns: str) -> DataFrame:
    """The same back."""
    return df.withColumns({c: F.from_json(c, "array<string>") for c in columns})


def percent(value: Column) -> Column:
    """With two decimals, as reports have it."""
    return F.format_string("%.2f", value)


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header row; reports are small, as they have a row for each term or summed line."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(lines: DataFrame, path: str) -> None:
    """Lines (pos, line) as text in order of pos."""
    lines.orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(path)
