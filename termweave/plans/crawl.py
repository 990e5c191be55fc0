"""A crawl session: ids that the store lacks, fetched and ingested in batches until none is left, a stop is asked for, or the archive is sick."""

from __future__ import annotations

import signal
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.plans import ingest
from termweave.session import remove, written
from termweave.sources import sinks, tables
from termweave.sources.store import Store
from termweave.streaming import replay


class Stop:
    """Whether a stop was asked for; the batch under way is finished and stored first."""

    def __init__(self) -> None:
        self.asked = False

    def ask(self, *_: object) -> None:
        self.asked = True

    @contextmanager
    def on_signals(self, *which: int):
        """While this lasts the signals (SIGTERM and SIGINT) ask for a stop."""
        old = {s: signal.signal(s, self.ask) for s in which or (signal.SIGTERM, signal.SIGINT)}
        try:
            yield self
        finally:
            for s, handler in old.items():
                signal.signal(s, handler)


def stamp(now: datetime) -> str:
    """A session's id."""
    return now.astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")


def crawl(
    store: Store, fetch: Callable[[SparkSession, list[int]], DataFrame], low: int, high: int, ascending: bool = False, limit: int | None = None, batch: int = 200, stop: Stop | None = None, limits: replay.Limits | None = None
) -> dict:
    """The session's record, which is stored too. fetch: responses (relid, url, http_status, body, elapsed_ms, err) for ids; a batch is bounded by ``batch`` ids."""
    spark, stop, limits = store.spark, stop or Stop(), limits or replay.Limits()
    began = datetime.now(UTC)
    record = {"session_id": stamp(began), "started_at": began.isoformat(), "range_lo": low, "range_hi": high} | dict.fromkeys(("attempted", "ok", "absent", "failed"), 0)
    schema = store.tables["crawl_sessions"]

    def note(**more: object) -> None:
        record.update(more)
        names = [f.name for f in spark.createDataFrame([], schema).schema]
        store.upsert("crawl_sessions", spark.createDataFrame([tuple(record.get(c) for c in names)], schema), "session_id")

    note()
    log: DataFrame | None = None
    done, events = 0, []
    while not stop.asked and (limit is None or done < limit):
        size = batch if limit is None else min(batch, limit - done)
        # slow redirects leave no row in the log: what this session tried isn't tried again
        ids = tables.id_queue(spark, low, high, ascending, None, store.read("fetch_log"))
        if log is not None:
            ids = ids.join(log.select("relid"), "relid", "left_anti").orderBy(F.col("relid").asc() if ascending else F.col("relid").desc())
        some = [r["relid"] for r in ids.limit(size).collect()]
        if not some:
            break
        responses = written(fetch(spark, some), "responses")
        out = ingest.ingest(responses)
        counts = ingest.session_record(out.fetch_log, record["session_id"], low, high).first()
        old = ingest.Ingested(store.read("fetch_log"), store.read("releases"))
        new = ingest.merged(old, out)
        store.replace("fetch_log", new.fetch_log)
        store.replace("releases", new.releases)
        done += len(some)
        turn = F.col("relid") if ascending else -F.col("relid")
        tried = responses.select("relid", F.lit(0).alias("session"), turn.alias("turn"), "http_status", "elapsed_ms", F.current_timestamp().alias("ts"))
        log = written(tried if log is None else log.unionByName(tried), "tried")
        ran = replay.replay(log.select("session", F.col("turn").alias("relid"), "http_status", "elapsed_ms", "ts"), limits)
        events = replay.notes(ran)
        stop.asked = stop.asked or ran.where("stopped").limit(1).count() > 0
        remove(responses)
        note(attempted=done, **{c: record[c] + counts[c] for c in ("ok", "absent", "failed")})
    note(finished_at=datetime.now(UTC).isoformat(), notes=sinks.json_text(events))
    return record
