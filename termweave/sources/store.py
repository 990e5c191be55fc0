"""A durable store of named tables in one folder, each replaced as a whole, so that readers always see a complete version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave import schemas
from termweave.sources import sinks


class Store:
    """Tables under path/name/v<number>; the latest complete version counts. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] | None = None) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), schemas.TABLES if tables is None else tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, tables: dict[str, str] | None = None) -> Store:
        """The store there, with every table it lacks made empty."""
        store = cls(spark, path, tables)
        for name, schema in store.tables.items():
            if not store._versions(name):
                store.replace(name, spark.createDataFrame([], schema))
        return store

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        at, files = self._at(f"{self.path}/{name}")
        if not files.exists(at):
            return []
        found = [x.getPath().getName() for x in files.listStatus(at)]
        return sorted(int(v[1:]) for v in found if v[:1] == "v" and v[1:].isdigit() and files.exists(self._at(f"{self.path}/{name}/{v}/_SUCCESS")[0]))

    def read(self, name: str) -> DataFrame:
        """The table; columns that its schema has gained since it was written are null."""
        found = self.spark.read.parquet(f"{self.path}/{name}/v{self._versions(name)[-1]}")
        wanted = self.spark.createDataFrame([], self.tables[name]).schema
        for field in wanted:
            found = sinks.add_column(found, field.name, field.dataType.simpleString())
        return found.select(*[found[f.name].cast(f.dataType).alias(f.name) for f in wanted])

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a new version; the one before stays for readers under way, older ones go."""
        old = self._versions(name)
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{(old[-1] if old else 0) + 1}")
        for v in old[:-1]:
            at, files = self._at(f"{self.path}/{name}/v{v}")
            files.delete(at, True)

    def upsert(self, name: str, new: DataFrame, *key: str) -> None:
        """Whole rows of new take the place of those with the same key."""
        old = self.read(name)
        kept = old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns)
        self.replace(name, kept.unionByName(new.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True))
