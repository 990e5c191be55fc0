"""A source of pages by number over HTTP: ``spark.read.format("numbered_pages")``.

Ids are dealt to tasks in ranges; each task keeps one connection, follows no redirects, and tries again after
min(30, 2^attempt) times ``backoff`` seconds. A page that can't be had gives a row with a null status and the error, so
a run always accounts for every id.

Options: host, path (with {id}), low, high or ids (joined by commas), parts (1), tries (4), timeout (30), backoff (1), scheme (https).
"""

from __future__ import annotations

import http.client
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESPONSES = "relid long, url string, http_status int, body binary, elapsed_ms int, err string"


@dataclass
class Ids(InputPartition):
    ids: Sequence[int]


class NumberedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_pages"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Ids]:
        low, high, n = (int(self.options.get(k, d)) for k, d in (("low", 1), ("high", 0), ("parts", 1)))
        ids = [int(x) for x in self.options["ids"].split(",")] if self.options.get("ids") else range(low, high + 1)
        step = max(1, -(-len(ids) // n))
        return [Ids(ids[a : a + step]) for a in range(0, len(ids), step)] or [Ids(())]

    def read(self, partition: Ids) -> Iterator[tuple]:
        o = self.options
        kind = http.client.HTTPConnection if o.get("scheme") == "http" else http.client.HTTPSConnection
        link = kind(o["host"], timeout=float(o.get("timeout", 30)))
        for relid in partition.ids:
            path = o.get("path", "/{id}").replace("{id}", str(relid))
            yield (relid, f"{o.get('scheme', 'https')}://{o['host']}{path}", *self._get(link, path))
        link.close()

    def _get(self, link: http.client.HTTPConnection, path: str) -> tuple[int | None, bytes | None, int, str | None]:
        error, began = "", time.monotonic()
        for attempt in range(int(self.options.get("tries", 4))):
            if attempt:
                time.sleep(min(30, 2**attempt) * float(self.options.get("backoff", 1)))
            began = time.monotonic()
            try:
                link.request("GET", path)
                answer = link.getresponse()
                return answer.status, answer.read(), int((time.monotonic() - began) * 1000), None
            except (OSError, http.client.HTTPException) as e:
                error = f"{type(e).__name__}: {e}"
                link.close()  # the next try opens it again
        return None, None, int((time.monotonic() - began) * 1000), error


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumberedPages)
