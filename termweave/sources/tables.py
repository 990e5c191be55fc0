"""Sources: releases and pages as the operators want them, the ministry dimension, id ranges and stored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.constants import MINISTRIES
from termweave.schemas import MINISTRIES as MINISTRY_SCHEMA
from termweave.session import read_table

WINDOW = ("2024-01-01", "2026-12-31")
#: Around a page's article, so that a plain page reads as a release page.
FORM_HEAD = '<form><div id="thd1">Press Information Bureau<br>Government of India<br>'


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as releases: title is the first line up to 80 characters, the date follows from the id."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("relid"), F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), F.lit(None).cast("string").alias("heading"),
        F.col("source").alias("ministry_raw"), F.date_format(F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") % 1200).cast("int")), "yyyy-MM-dd").alias("release_date"), F.col("text").alias("body_text"),
    )


def window(rows: DataFrame, low: str = WINDOW[0], high: str = WINDOW[1]) -> DataFrame:
    """Releases by date, as text and inclusive; nulls of text columns become empty."""
    full = {c: F.coalesce(c, F.lit("")) for c in ("title", "heading", "ministry_raw", "body_text")}
    return rows.where(F.col("release_date").between(low, high)).withColumns(full)


def ministries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MINISTRIES), MINISTRY_SCHEMA)


def id_queue(spark: SparkSession, low: int, high: int, ascending: bool = False, limit: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """relid from low to high, without those seen, in order, up to a limit."""
    ids = spark.range(low, high + 1).withColumnRenamed("id", "relid")
    ids = ids if seen is None else ids.join(seen.select("relid"), "relid", "left_anti")
    ids = ids.orderBy(F.col("relid").asc() if ascending else F.col("relid").desc())
    return ids if limit is None else ids.limit(limit)


def wrapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as release pages: each id lacks another part, so that every status and warning occurs."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("relid"), F.expr(WRAP).alias("page"))


#: The same text in Spark and DuckDB: ids modulo 11 lose the header or the form, modulo 7 the month, modulo 5 get a centred heading, modulo 13 lose the title.
WRAP = (
    "concat(CASE WHEN page_id % 13 = 6 THEN '' ELSE substring(html, instr(html, '<title>'), instr(html, '</title>') - instr(html, '<title>') + 8) END,"
    f" CASE WHEN page_id % 11 = 3 THEN '' ELSE concat('{FORM_HEAD}', CASE WHEN page_id % 17 = 4 THEN '' ELSE concat('Ministry ', cast(page_id % 9 AS string)) END,"
    " '<br><span>', cast(page_id % 31 + 1 AS string), CASE WHEN page_id % 7 = 2 THEN '-Foober-' ELSE '-March, ' END, cast(2000 + page_id % 27 AS string), ' ', cast(page_id % 24 AS string), ':', cast(page_id % 60 AS string), ' IST</span></div>') END,"
    " CASE WHEN page_id % 11 = 5 THEN '' ELSE concat('<div id=\"condiv\">', CASE WHEN page_id % 5 = 1 THEN concat('<div style=\"text-align:center\">Heading ', cast(page_id AS string), '</div>') ELSE '' END,"
    " CASE WHEN page_id % 19 = 8 THEN '' ELSE substring(html, instr(html, '<body>') + 6, 1000000000) END, '</form>') END)"
)


def routed(log: DataFrame, slow: float = 2.0) -> DataFrame:
    """Responses (relid, http_status, elapsed_ms, err) with parse_status and warnings; a slow redirect gives no row, a page is for the parser."""
    status, late = F.col("http_status"), F.col("elapsed_ms") > slow * 1000
    kind: Column = F.when(status.isNull(), "failed").when(status == 302, F.when(~late, "absent")).when(status != 200, "failed").otherwise("page")
    why = F.when(status.isNull(), F.array(F.lit("transport"), F.coalesce("err", F.lit("")))).when(kind == "failed", F.array(F.concat(F.lit("http_"), status.cast("string")))).otherwise(F.array().cast("array<string>"))
    return log.withColumns({"parse_status": kind, "parse_warnings": why}).where("parse_status is not null")


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of responses, in order of event_id."""
    e = read_table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 5 == 1, 302).when(F.col("event_id") % 23 == 2, 404).otherwise(200)
    return e.select(F.col("event_id").alias("relid"), status.cast("int").alias("http_status"), ((F.col("event_id") * 37) % 2400).cast("int").alias("elapsed_ms"), F.when(status.isNull(), "timeout").alias("err"), "ts", (F.col("event_id") % 8).alias("session"))
