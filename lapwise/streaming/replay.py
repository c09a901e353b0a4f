"""Streams of step files, staged by the same functions as batch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapwise.functions.exprs import payload


def step_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_payloads(steps: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and value columns as message sinks take them: the value is a JSON object."""
    return steps.select(F.col(key).cast("string").alias("key"), payload(*fields).alias("value"))


def replay(stream: DataFrame, out: str, checkpoint: str, *, stage: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs the stream over all files there are, into Parquet, and stops; a second run adds only new files."""
    staged = stream if stage is None else stage(stream)
    staged.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
