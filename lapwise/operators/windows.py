"""Window operators over ordered sub-sequences. Every window is partitioned; ascending order puts nulls last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def over(keys: Sequence[str], order: Sequence[str] = ()) -> WindowSpec:
    spec = Window.partitionBy(*keys)
    return spec.orderBy(*[F.col(c).asc_nulls_last() for c in order]) if order else spec


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(over(keys, order)))


def group_size(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.count(F.lit(1)).over(over(keys)))


def adjacent(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """after_flag and before_flag: the flag of the previous and of the next row, false at the ends."""
    w = over(keys, order)
    return df.withColumns({f"after_{flag}": F.coalesce(F.lag(flag).over(w), F.lit(False)), f"before_{flag}": F.coalesce(F.lead(flag).over(w), F.lit(False))})


def ew_load(value: Column, keys: Sequence[str], order: Sequence[str], weights: Sequence[float], *, positive: bool = False) -> Column:
    """Weighted sum of the value's lags 1, 2, ...; missing lags count as zero."""
    w = over(keys, order)
    part = lambda x: F.greatest(x, F.lit(0.0)) if positive else x
    return sum((weight * part(F.coalesce(F.lag(value, k).over(w), F.lit(0.0))) for k, weight in enumerate(weights, 1)), F.lit(0.0))


def early_baseline(df: DataFrame, unit: Sequence[str], pos: str, value: str, *, share: float = 0.6, least: int = 3) -> DataFrame:
    """baseline: median of the first share (least rows at least) of each unit; deviation from it."""
    n = F.count(F.lit(1)).over(over(unit))
    marked = df.withColumn("_early", F.col(pos) <= F.greatest(F.ceil(n * share), F.lit(least)))
    base = marked.where("_early").groupBy(*unit).agg(F.median(value).alias("baseline"))
    return marked.drop("_early").join(base, list(unit), "left").withColumn("deviation", F.col(value) - F.col("baseline"))


def rolling(fn, value: str, keys: Sequence[str], order: Sequence[str], lo: int, hi: int) -> Column:
    """fn of the value over rows lo to hi around each row."""
    return fn(value).over(over(keys, order).rowsBetween(lo, hi))


def cumulative(value: Column | str, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.sum(value).over(over(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark limits each partition's group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order])
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def demean(df: DataFrame, unit: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """d_<column>: the column less its unit's mean."""
    return df.withColumns({f"d_{c}": F.col(c) - F.avg(c).over(over(unit)) for c in columns})


def forward_targets(df: DataFrame, unit: Sequence[str], order: Sequence[str], value: str, *, cap: float = 30.0, floor: float = 0.0) -> DataFrame:
    """next_jump (clipped), sum_3 and sum_5 of the next values less the current one (floored); null without the horizon."""
    w = over(unit, order)
    lead = lambda k: F.lead(value, k).over(w)
    total = lambda k: F.when(lead(k).isNotNull(), F.greatest(sum((lead(i) for i in range(2, k + 1)), lead(1)) - F.col(value), F.lit(floor)))
    jump = F.when(lead(1).isNotNull(), F.greatest(F.lit(floor), F.least(lead(1) - F.col(value), F.lit(cap))))
    return df.withColumns({"next_jump": jump, "sum_3": total(3), "sum_5": total(5)})


def event_bucket(df: DataFrame, unit: Sequence[str], order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """bucket: how soon the value rises by threshold, by the leads 1-2, 3 and 5, and 6; none else, null at the last row."""
    w = over(unit, order)
    rise = lambda k: F.coalesce(F.lead(value, k).over(w) - F.col(value) > threshold, F.lit(False))
    label = F.when(F.lead(value).over(w).isNull(), F.lit(None)).when(rise(1) | rise(2), "soon").when(rise(3) | rise(5), "later").when(rise(6), "distant").otherwise("none")
    return df.withColumn("bucket", label)


def recovery_flag(df: DataFrame, unit: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """recovered: the mean of the next two values (of one, if only one is left) is below the current one; null at the end."""
    w = over(unit, order)
    one, two = F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    return df.withColumn("recovered", F.when(one.isNull(), F.lit(None).cast("boolean")).otherwise((one + F.coalesce(two, one)) / 2 < F.col(value)))


def spans(df: DataFrame, keys: Sequence[str], end: str, total: Column | str) -> DataFrame:
    """start and finish of contiguous spans that end at each event row; a null end sorts last and ends at total."""
    w = over(keys, [end])
    start = F.coalesce(F.lag(end).over(w) + 1, F.lit(1))
    return df.withColumns({"span": F.row_number().over(w), "start": start, "finish": F.coalesce(F.col(end), F.col(total) if isinstance(total, str) else total)})


def is_monotone(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """One row per group: whether the value never falls along the order."""
    falls = df.withColumn("_fall", (F.col(value) < F.lag(value).over(over(keys, order))).cast("int"))
    return falls.groupBy(*keys).agg((F.coalesce(F.sum("_fall"), F.lit(0)) == 0).alias("monotone"))
