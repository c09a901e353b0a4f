"""Sources and sinks: partitioned Parquet, lookups from CSV, manifests, incremental loads, drift checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapwise.sources.scratch import settled


def read_dataset(spark: SparkSession, root: str, name: str, schema: T.StructType, *, session: str | None = None) -> DataFrame:
    """A Hive-partitioned dataset under root; session picks a sub-partition, both pruned by the scan."""
    df = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return df if session is None else df.where(F.col("session") == session)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV lookup with a header and declared types."""
    return spark.read.schema(schema).option("header", True).csv(path)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


#: Rows and compressed bytes of one writing task, which sorts them.
TASK_ROWS, TASK_BYTES = 1_000_000, 32 << 20


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], *, codec: str = "zstd", mode: str = "overwrite") -> None:
    """Parquet partitioned by columns. Rows are first written aside and measured, then dealt to tasks by range of the
    columns and of their place, so that a partition of any size goes through as many tasks as it needs."""
    spark = df.sparkSession
    aside = settled(df, "aside")
    size = _bytes(spark, aside.inputFiles()[0].rpartition("/")[0]) if aside.inputFiles() else 0
    tasks = max(-(-aside.count() // TASK_ROWS), -(-size // TASK_BYTES), 1)
    placed = aside.withColumn("_lapwise_place", F.monotonically_increasing_id())
    spread = placed.repartitionByRange(tasks, *by, "_lapwise_place").drop("_lapwise_place") if tasks > 1 else aside.coalesce(1)
    spread.write.mode(mode).option("compression", codec).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _bytes(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def write_single(df: DataFrame, path: str, *, max_bytes: int = 5 << 20) -> int:
    """A small table as one file; its size, or an error where it is over the gate.

    The table is first written aside by all tasks and measured, so that only one that can pass the gate goes through one task.
    """
    spark = df.sparkSession
    aside = settled(df, "single")
    if (size := _bytes(spark, aside.inputFiles()[0].rpartition("/")[0]) if aside.inputFiles() else 0) > 2 * max_bytes:
        raise ValueError(f"{path} would have about {size} bytes, more than {max_bytes}")
    aside.coalesce(1).write.mode("overwrite").parquet(path)
    if (size := _bytes(spark, path)) > max_bytes:
        raise ValueError(f"{path} has {size} bytes, more than {max_bytes}")
    return size


def write_enriched(df: DataFrame, keyed: DataFrame, key: Sequence[str], path: str, by: Sequence[str]) -> None:
    """A table that lacks its partition columns, with those of keyed joined in."""
    write_partitioned(df.join(keyed.select(*key, *by).distinct(), list(key)), path, by)


def export_manifest(tables: Mapping[str, DataFrame], period: Mapping[str, str]) -> DataFrame:
    """A row per table: rows, first and last period, and an order-free fingerprint of its content."""
    rows = []
    for name, df in tables.items():
        p = F.col(period[name])
        content = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")
        rows.append(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.min(p).cast("string").alias("first"), F.max(p).cast("string").alias("last"), F.count_distinct(p).alias("periods"), content.alias("content")))
    return reduce(DataFrame.unionByName, rows)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest (a row a table) as JSON lines with a version: the first 12 hex digits of a SHA-256 of all its rows by name."""
    rows = F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*manifest.columns)))), "\n")
    version = manifest.agg(F.substring(F.sha2(rows, 256), 1, 12).alias("version"))
    manifest.crossJoin(F.broadcast(version)).coalesce(1).write.mode("overwrite").json(path)


def manifest_diff(current: DataFrame, new: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows in one manifest only, apart from the ignored columns."""
    a, b = current.drop(*ignore), new.drop(*ignore)
    return a.exceptAll(b).withColumn("side", F.lit("current")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def load_incremental(df: DataFrame, existing: DataFrame | None, by: Sequence[str], *, force: bool = False) -> DataFrame:
    """The rows of partitions that existing does not have yet, or all of them if forced."""
    return df if force or existing is None else df.join(existing.select(*by).distinct(), list(by), "left_anti")


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def schema_fingerprint(df: DataFrame) -> str:
    """First 12 hex digits of the SHA-1 of the sorted column names, joined by commas."""
    import hashlib

    return hashlib.sha1(",".join(sorted(df.columns)).encode()).hexdigest()[:12]


def extract_partitions(datasets: Mapping[str, DataFrame], parts: DataFrame, keys: Sequence[str], out: str) -> None:
    """The chosen partitions (parts: a row for each) of every dataset, written as partitioned Parquet below out."""
    for name, df in datasets.items():
        write_partitioned(df.join(F.broadcast(parts), list(keys), "left_semi"), f"{out}/{name}", keys)


def register_views(spark: SparkSession, paths: Mapping[str, str]) -> list[str]:
    """Temporary views over Parquet paths; running it again replaces them."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return list(paths)
