"""Shared scratch space: tables and files that every executor can see."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/lapwise-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """df as a table written to the shared folder and read again: cuts lineage, survives lost executors.

    Inside temporary() the table goes at its end, unless it is lasting.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if not lasting and getattr(_OPEN, "paths", None) is not None:
        _OPEN.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread writes inside, when what is built from them has been written as lasting."""
    before, _OPEN.paths = getattr(_OPEN, "paths", None), []
    try:
        yield
    finally:
        for path in _OPEN.paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _OPEN.paths = before


def forget_shuffles(spark: SparkSession) -> None:
    """Has Spark's cleaner remove the shuffle files of frames that are no longer used, which it else does at leisure."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 32) -> Iterator[None]:
    """Arrow batches of few rows for the jobs that run inside, where a row is a block or a tile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
