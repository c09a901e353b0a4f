"""Registration of queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
#: Added before rounding on both sides, so that decimal ties do not fall apart by the last bit of a sum.
NUDGE = 1.3e-9


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> Callable:
    """Registers a query; doubles names its columns of floating sums, which both sides round to so many digits for comparison."""
    names = doubles.split()

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = build(spark, sf_dir)
            return found.withColumns({c: F.round(F.col(c).cast("double") + F.lit(NUDGE), digits) + F.lit(0.0) for c in names}) if names else found

        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round(CAST({c} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {c}" for c in names)
            ORACLES[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if names else sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
