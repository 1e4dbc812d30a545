"""Tables written on the way, in the folder that driver and executors share, and counts taken on the way."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that setting is absent, a local master gets a folder of its own, as in tests; any other master is an error, as
    executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="opinara-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/opinara-{uuid.uuid4().hex}"


#: Spark's setting for shuffle files to go as soon as their query has ended; else they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writes, _before = threading.Lock(), 0, None


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that begin within leave no shuffle files; for those whose result is written. Threads may do so at once."""
    global _writes, _before
    with _lock:
        if not _writes:
            _before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writes += 1
    try:
        yield
    finally:
        with _lock:
            _writes -= 1
            if not _writes:
                spark.conf.unset(CLEANUP) if _before is None else spark.conf.set(CLEANUP, _before)


def stored(df: DataFrame, within: str | None = None, compression: str | None = None) -> DataFrame:
    """df as a written table: later plans start from there, and lost executors cost no recomputation.

    within: a folder of shared_folder() that the caller discards when nothing reads the table any more. The write's shuffle
    files go with its end, so the disk holds one step's at a time.
    """
    path = f"{within}/{uuid.uuid4().hex}" if within else shared_folder(df.sparkSession)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder of shared_folder() and all tables within."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_all(spark: SparkSession) -> None:
    """Removes all that this library has written below the shared folder; for when no result is read any more."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/opinara-*")
        files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(pattern) or []:
            files.delete(found.getPath(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(df: DataFrame, reason: Column, reasons: list[str], seen: Observation) -> DataFrame:
    """The rows of df without a reason to be dropped.

    seen gets ``rows``, ``kept`` and the rows dropped for each of the reasons, from the very action that reads the result
    (a write, say); nothing is read twice. Ask ``seen.get`` after it.
    """
    own = df.withColumn("_reason", reason)
    return own.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_reason").isNull()).alias("kept"),
        *[F.count_if(F.col("_reason") == r).alias(r) for r in reasons]
    ).filter("_reason IS NULL").drop("_reason")
