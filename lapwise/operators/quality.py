"""Data quality, invariants and leakage guards. Checks return the rows or the counts that fail."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.operators.windows import over


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per required column and whether it is there."""
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in columns], "name string, present boolean")


def null_rates(df: DataFrame, threshold: float) -> DataFrame:
    """Null rate of every column and whether it is over the threshold, in one scan."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "name", "rate").withColumn("failed", F.col("rate") > threshold)


def min_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows per partition and whether they are fewer than n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn("failed", F.col("rows") < n)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once with their number of rows; all members count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def quality_report(df: DataFrame, by: Sequence[str], keys: Sequence[str], columns: Sequence[str], *, least: int, threshold: float) -> DataFrame:
    """Per partition: rows, rows in duplicate-key groups, the largest null rate, and whether all passes."""
    groups = df.groupBy(*dict.fromkeys([*by, *keys])).agg(F.count(F.lit(1)).alias("_k"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in columns])
    found = groups.groupBy(*by).agg(F.sum("_k").alias("rows"), F.sum(F.when(F.col("_k") > 1, F.col("_k")).otherwise(0)).alias("duplicates"), *[F.sum(f"_{c}").alias(f"_{c}") for c in columns])
    worst = F.greatest(*[F.col(f"_{c}") for c in columns], F.lit(0)) / F.col("rows")
    return found.select(*by, "rows", "duplicates", worst.alias("worst_null_rate"), ((F.col("rows") >= least) & (F.col("duplicates") == 0) & (worst <= threshold)).alias("passed"))


def completeness(datasets: Mapping[str, DataFrame], keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Rows of each dataset for every expected partition, and whether all are there."""
    counts = reduce(DataFrame.unionByName, [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(name)) for name, df in datasets.items()])
    wide = counts.groupBy(*keys).pivot("dataset", list(datasets)).agg(F.first("n"))
    filled = expected.join(wide, list(keys), "left").fillna(0, list(datasets))
    return filled.withColumn("complete", reduce(lambda a, b: a & b, [F.col(n) > 0 for n in datasets]))


def rowcount_profile(datasets: Mapping[str, DataFrame], period: str, part: str) -> DataFrame:
    """Number, mean, minimum and maximum of partition row counts per dataset and period."""
    each = [df.groupBy(period, part).agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, each).groupBy("dataset", period).agg(F.count("n").alias("parts"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def expect(df: DataFrame, rules: Mapping[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """Rule and number of rows that fail it (false or null), one scan; unique columns count surplus rows."""
    failing = [F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()]
    surplus = [(F.count(c) - F.countDistinct(c)).alias(f"unique_{c}") for c in unique]
    names = [*rules, *[f"unique_{c}" for c in unique]]
    return df.agg(*failing, *surplus).unpivot([], names, "rule", "failing")


def assert_additive(df: DataFrame, total: str, components: Sequence[str], residual: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose total is not the sum of components and residual."""
    rest = reduce(lambda a, c: a - F.coalesce(F.col(c), F.lit(0.0)), [*components, residual], F.col(total))
    return df.withColumn("gap", rest).where(F.abs("gap") > tolerance)


def assert_between(df: DataFrame, value: str, a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose value lies outside the span of a and b."""
    return df.where((F.col(value) < F.least(a, b) - tolerance) | (F.col(value) > F.greatest(a, b) + tolerance))


def assert_centred(df: DataFrame, by: Sequence[str], dev: str, se: str, tolerance: float = 1e-6) -> DataFrame:
    """Groups whose precision-weighted deviations do not add up to zero."""
    w = 1 / (F.col(se) * F.col(se))
    return df.groupBy(*by).agg(F.try_divide(F.sum(w * F.col(dev)), F.sum(w)).alias("centre")).where(F.abs("centre") > tolerance)


def assert_variance_ratio(base: DataFrame, current: DataFrame, value_a: str, value_b: str, lo: float, hi: float) -> DataFrame:
    """One row: the ratio of variances and whether it lies in the band."""
    both = base.agg(F.var_pop(value_a).alias("a")).crossJoin(current.agg(F.var_pop(value_b).alias("b")))
    return both.select(F.try_divide("b", "a").alias("ratio")).withColumn("passed", F.coalesce(F.col("ratio").between(lo, hi), F.lit(False)))


def assert_causal(build: Callable[[DataFrame], DataFrame], df: DataFrame, key: str, order: str, cuts: Sequence[int], features: Sequence[str]) -> DataFrame:
    """Rows whose features change when history after a cut is taken away: the features that look ahead.

    build is run on the whole and on each truncated input; rows at or before the cut must agree.
    """
    whole = build(df).select(key, order, *[F.col(f).alias(f"_w_{f}") for f in features])
    found = []
    for cut in cuts:
        part = build(df.where(F.col(order) <= cut)).select(key, *features).join(whole, key)
        leaks = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_w_{f}")), F.lit(f)) for f in features]))
        found.append(part.select(F.lit(cut).alias("cut"), key, F.explode(leaks).alias("feature")))
    return reduce(DataFrame.unionByName, found)


def freshness(df: DataFrame, column: str, today: Column, max_days: int) -> DataFrame:
    """age in days and state of each row: fresh, stale or missing."""
    age = F.datediff(today, F.col(column))
    return df.withColumn("age", age).withColumn("state", F.when(age.isNull(), "missing").when(age > max_days, "stale").otherwise("fresh"))


def gaps(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose step is not one after the previous row's."""
    return df.withColumn("_p", F.lag(order).over(over(keys, [order]))).where(F.col("_p").isNotNull() & (F.col(order) != F.col("_p") + 1)).drop("_p")


def recomputed(df: DataFrame, unit: Sequence[str], order: str, source: str, weights: Mapping[int, float], *, floor: float | None = None, mean: bool = False) -> DataFrame:
    """unit, order and expected: a weighted sum (or mean) of the source at fixed offsets of the same unit, without a window.

    Every row sends its value to the steps it counts for (offset 1: the row one step before), and what arrives at a step is
    summed; so it shares no code with the window it is held against. Values below floor count as floor, null ones not at all.
    """
    value = F.col(source).cast("double") if floor is None else F.greatest(F.col(source).cast("double"), F.lit(floor))
    sent = df.where(F.col(source).isNotNull()).select(*unit, F.explode(F.array(*[F.struct((F.col(order) + k).alias("to"), (value * w).alias("part"), F.lit(w).alias("w")) for k, w in weights.items()])).alias("s"))
    arrived = sent.groupBy(*unit, F.col("s.to").alias(order)).agg(F.sum("s.part").alias("_sum"), F.sum("s.w").alias("_w"))
    expected = F.try_divide(F.col("_sum"), F.col("_w")) if mean else F.coalesce(F.col("_sum"), F.lit(0.0))
    return df.select(*unit, order).join(arrived, [*unit, order], "left").select(*unit, order, expected.alias("expected"))


def assert_windows(df: DataFrame, unit: Sequence[str], order: str, checks: Mapping[str, tuple[str, DataFrame]], *, tolerance: float = 1e-4) -> DataFrame:
    """check, unit, order, actual, expected of the rows whose column is not what recomputed gives: {check: (column, expected)}."""
    found = []
    for name, (column, expected) in checks.items():
        both = df.select(*unit, order, F.col(column).cast("double").alias("actual")).join(expected, [*unit, order])
        off = F.col("actual").isNull() != F.col("expected").isNull()
        found.append(both.where(off | (F.abs(F.col("actual") - F.col("expected")) > tolerance)).select(F.lit(name).alias("check"), *unit, order, "actual", "expected"))
    return reduce(DataFrame.unionByName, found)
