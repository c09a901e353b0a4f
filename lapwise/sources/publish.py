"""Idempotent publishing of partitions: written aside first, made visible by one manifest row.

Layout under a root: data/attempt=<id>/<partition folders> holds what runs have written, commits/ a file a run. A commit is a
single JSON file of one row, which Spark moves into place as the last thing a run does, so a run that is killed before has
left nothing that readers see, and one that is killed after is complete. Readers take, of each partition, the entry of the
latest commit. One writer at a time is assumed; readers need no lock.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lapwise.sources.store import write_partitioned

ENTRY = "struct<key:string,path:string,rows:long,content:string>"
COMMIT = f"version long, attempt string, status string, at string, entries array<{ENTRY}>"


def partition_key(by: Sequence[str]) -> Column:
    """The partition's values as one string, nulls included."""
    return F.to_json(F.struct(*[F.col(b).cast("string").alias(b) for b in by]), {"ignoreNullFields": "false"})


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """A row per committed run."""
    if not _exists(spark, f"{root}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json(f"{root}/commits")


def visible(spark: SparkSession, root: str) -> DataFrame:
    """key, path, rows, content, version of every partition that readers see."""
    entries = commits(spark, root).select("version", F.explode("entries").alias("e"))
    latest = entries.groupBy(F.col("e.key").alias("key")).agg(F.max_by("e", "version").alias("e"), F.max("version").alias("version"))
    return latest.select("key", "e.path", "e.rows", "e.content", "version")


def stage_partitions(df: DataFrame, root: str, by: Sequence[str], attempt: str) -> DataFrame:
    """Writes df aside as an attempt; an entry per partition, from the files as they were written."""
    spark = df.sparkSession
    base = f"{root}/data/attempt={attempt}"
    write_partitioned(df, base, by)
    if not any(f for f in _children(spark, base) if "=" in f):
        return spark.createDataFrame([], ENTRY.removeprefix("struct<").removesuffix(">").replace(":", " "))
    back = spark.read.schema(df.schema).parquet(base)
    columns = sorted(df.columns)
    content = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    folder = F.url_decode(F.replace(F.regexp_extract(F.input_file_name(), r"^(.*)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))  # file names come as URIs
    return back.withColumn("_folder", folder).groupBy(partition_key(by).alias("key")).agg(F.first("_folder").alias("path"), F.count(F.lit(1)).alias("rows"), content.alias("content"))


def _children(spark: SparkSession, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def commit(entries: DataFrame, root: str, attempt: str, status: str = "success") -> int:
    """Makes an attempt's partitions visible; the commit's version."""
    spark = entries.sparkSession
    version = (commits(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    row = entries.agg(F.collect_list(F.struct("key", "path", "rows", "content")).alias("entries"))  # an entry per partition
    row.select(F.lit(version).cast("long").alias("version"), F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), F.current_timestamp().cast("string").alias("at"), "entries").coalesce(1).write.mode("append").json(f"{root}/commits")
    return version


def publish(df: DataFrame, root: str, by: Sequence[str], *, force: bool = False) -> int | None:
    """Publishes the partitions of df that readers do not see yet, or all of them if forced; the version, or None if none.

    Run again after a failure at any point it gives what one whole run gives; run again after success it writes nothing.
    """
    spark = df.sparkSession
    todo = df
    if not force:
        seen = visible(spark, root).select(F.col("key").alias("_seen"))
        todo = df.withColumn("_key", partition_key(by)).join(seen, F.col("_key") == F.col("_seen"), "left_anti").drop("_key")
    if todo.isEmpty():
        return None
    attempt = uuid.uuid4().hex
    return commit(stage_partitions(todo, root, by, attempt), root, attempt)


def read_published(spark: SparkSession, root: str, schema: T.StructType, *, keys: Sequence[str] | None = None) -> DataFrame:
    """The visible partitions (of those keys, if given), by the manifest; folders that no commit names are never listed."""
    entries = visible(spark, root)
    if keys is not None:
        entries = entries.where(F.col("key").isin(list(keys)))
    paths = [r["path"] for r in entries.select("path").collect()]  # a row per partition
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths).select(*[f.name for f in schema]) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Deletes attempts of which readers see no partition; their names."""
    used = {r[0] for r in visible(spark, root).select(F.regexp_extract("path", r"attempt=([0-9a-f]+)", 1)).distinct().collect()}
    gone = [a for a in _children(spark, f"{root}/data") if a.startswith("attempt=") and a.removeprefix("attempt=") not in used]
    for a in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/{a}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone
