"""From responses to the fetch log, releases and a session's record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import html as H  # noqa: N812
from termweave.session import written
from termweave.sources import sinks, tables


@dataclass
class Ingested:
    fetch_log: DataFrame
    releases: DataFrame


def ingest(responses: DataFrame) -> Ingested:
    """responses: relid, url, http_status, body, elapsed_ms, err. A log row for each id but slow redirects; releases of pages that parse.

    The responses are stored first, as a source may fetch anew whenever it is read. Without an answer time and size are 0.
    """
    routed = tables.routed(written(responses, "responses"))
    page = F.make_valid_utf8(F.col("body").cast("string"))
    parsed = written(H.parse_release(routed.where("parse_status = 'page'").select("relid", page.alias("page"))), "parsed")
    found = parsed.select("relid", F.col("parse_status").alias("_status"), F.col("parse_warnings").alias("_warnings"))
    answered = F.col("http_status").isNotNull()
    log = routed.join(found, "relid", "left").select(
        "relid", "url", "http_status", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("fetched_at"),
        F.when(answered, F.col("elapsed_ms")).otherwise(0).cast("int").alias("elapsed_ms"), F.when(answered, F.coalesce(F.octet_length("body"), F.lit(0))).otherwise(0).alias("byte_size"),
        F.when(F.col("parse_status") == "page", F.sha2("body", 256)).alias("content_sha256"), F.coalesce("_status", "parse_status").alias("parse_status"), F.coalesce("_warnings", "parse_warnings").alias("parse_warnings"),
    )
    return Ingested(log, parsed.where("parse_status <> 'failed'").drop("parse_status", "parse_warnings"))


def session_record(log: DataFrame, session_id: str, low: int, high: int, started_at: str | None = None, finished_at: str | None = None, notes: Sequence[str] | None = None) -> DataFrame:
    """One row: the range, how many ids were attempted, parsed, absent and failed, when, and the last events as JSON."""
    counts = log.agg(F.count("*").cast("int").alias("attempted"), *[F.count_if(F.col("parse_status").isin(*which)).cast("int").alias(name) for name, which in (("ok", ("ok", "partial")), ("absent", ("absent",)), ("failed", ("failed",)))])
    text = F.lit(None if notes is None else sinks.json_text(notes)).cast("string")
    return counts.select(
        F.lit(session_id).alias("session_id"), F.lit(started_at).cast("string").alias("started_at"), F.lit(finished_at).cast("string").alias("finished_at"),
        F.lit(low).cast("long").alias("range_lo"), F.lit(high).cast("long").alias("range_hi"), "attempted", "ok", "absent", "failed", text.alias("notes"),
    )


def merged(old: Ingested, new: Ingested) -> Ingested:
    """Rows of new ids and, for ids fetched again, the new rows in whole; what a new row doesn't have becomes null."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return sinks.upsert_latest(a.withColumn("_turn", F.lit(0)), b.withColumn("_turn", F.lit(1)), "relid", "_turn").drop("_turn")

    return Ingested(both(old.fetch_log, new.fetch_log), both(old.releases, new.releases))
