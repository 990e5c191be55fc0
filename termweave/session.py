"""Session helpers: worker import path and the shared working folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A small session for tests, the bench and the console."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("termweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Let Python workers on hosts that hold this folder import the package.

    Elsewhere ship the package with ``--py-files``; the extra entry does no harm there.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        # rows hold whole documents: smaller batches keep workers and executors small; a setting of the user's own stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "").split(os.pathsep)
    if _HOME not in path:
        env["PYTHONPATH"] = os.pathsep.join([_HOME, *[p for p in path if p]])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, least: int = 8 << 20) -> DataFrame:
    """A table of some size whose few files would leave cores idle, dealt to all of them; larger tables, which split, as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    query = df._jdf.queryExecution()
    small = int(str(query.optimizedPlan().stats().sizeInBytes())) < least
    return df if small or query.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one, deleted at exit, where that is unset and all runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="termweave-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return _OWN[sc.applicationId]


def written(df: DataFrame, tag: str, rows: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    rows: for large rows, so many or about 16 MB at once, as a reader holds a row group. The table stays until ``remove(df)``,
    ``sweep(spark)`` or the folder's own retention.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    sized = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": rows, "parquet.page.size.row.check.max": rows} if rows else {}
    df.write.options(**sized).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def gathered(df: DataFrame, rows: int, each: int = 50_000, most: int = 8) -> DataFrame:
    """A result of about so many rows in as many partitions as these need, if it has more: small steps are mostly tasks' overhead.

    At most ``most`` partitions become one, as a task keeps the buffers of all that it goes through until it ends.
    """
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, -(-rows // each), -(-shuffled // most)))


def remove(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    _delete(spark, df._written_path)
    _WRITTEN[spark.sparkContext.applicationId].remove(df._written_path)


def sweep(spark: SparkSession) -> None:
    """Delete every table that this session wrote; call it once the results are stored."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
