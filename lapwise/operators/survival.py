"""Survival and fitting operators: change points, Kaplan-Meier curves, trimmed means, fits with fallback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapwise.operators.estimators import ols, r_squared, ratio
from lapwise.operators.quantiles import grouped_median, grouped_quantiles
from lapwise.operators.windows import over


def km_curve(df: DataFrame, by: Sequence[str], duration: str, event: str) -> DataFrame:
    """survival after each duration: products over durations of 1 - events / at risk, by sums of logarithms."""
    times = df.groupBy(*by, F.col(duration).alias("t")).agg(F.count_if(event).alias("events"), F.count(F.lit(1)).alias("n"))
    w = over(by, ["t"])
    earlier = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    risk = times.withColumn("at_risk", F.sum("n").over(over(by)) - earlier)
    log = F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)
    dead = F.max((F.col("events") >= F.col("at_risk")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return risk.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(log).over(w.rowsBetween(Window.unboundedPreceding, 0)))))


def km_median(df: DataFrame, by: Sequence[str], duration: str, event: str) -> DataFrame:
    """median: the first duration at which half or fewer survive, else the 75th percentile of observed events."""
    curve = km_curve(df, by, duration, event).groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-9, F.col("t"))).alias("_half"))
    late = grouped_quantiles(df.where(F.col(event)), by, duration, {"_p75": 0.75})
    return curve.join(late, list(by), "left").select(*by, F.coalesce(F.col("_half").cast("double"), "_p75").alias("median"), F.col("_half").isNull().alias("fallback"))


def detect_cliff(df: DataFrame, unit: Sequence[str], order: str, value: str, *, rise: float = 0.5, window: int = 5, least: int = 3, streak: int = 2) -> DataFrame:
    """cliff: the step that begins the first streak of rows over the median of the window rows before, by rise."""
    w = over(unit, [order])
    before = w.rowsBetween(-window, -1)
    spike = F.coalesce((F.count(value).over(before) >= least) & (F.col(value) > F.percentile(value, 0.5).over(before) + rise), F.lit(False))
    marked = df.withColumn("_spike", spike).withColumn("_place", F.row_number().over(w))
    run = F.col("_place") - F.max(F.when(~F.col("_spike"), F.col("_place")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("_run", F.when(F.col("_spike"), run).otherwise(0))
    return runs.groupBy(*unit).agg(F.min(F.when(F.col("_run") == streak, F.col(order) - (streak - 1))).alias("cliff"))


def survival_table(df: DataFrame, unit: Sequence[str], keep: Sequence[str], order: str, value: str, covariate: str, forced: Column, *, min_rows: int = 3, **options) -> DataFrame:
    """duration (to the cliff, else the last step), observed, mean covariate and forced, per unit of min_rows or more."""
    units = df.groupBy(*unit).agg(*[F.first(c).alias(c) for c in keep], F.max(order).alias("_last"), F.avg(covariate).alias("covariate"), F.bool_or(forced).alias("forced"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    found = units.join(detect_cliff(df, unit, order, value, **options), list(unit), "left")
    return found.select(*unit, *keep, F.coalesce("cliff", "_last").alias("duration"), F.col("cliff").isNotNull().alias("observed"), "covariate", "forced")


def trimmed_mean(df: DataFrame, by: Sequence[str], value: str, lo: float = 0.1, hi: float = 0.9, out: str = "trimmed") -> DataFrame:
    """Mean of the values between the group's lo and hi percentiles."""
    bounds = grouped_quantiles(df, by, value, {"_lo": lo, "_hi": hi})
    inside = df.join(bounds, list(by)).where(F.col(value).between(F.col("_lo") - 1e-9, F.col("_hi") + 1e-9))  # the bounds carry rounding
    return inside.groupBy(*by).agg(F.avg(value).alias(out), F.count(value).alias("n"))


def cliff_severity(df: DataFrame, cliffs: DataFrame, unit: Sequence[str], by: Sequence[str], order: str, value: str, *, reach: int = 5, least: int = 2) -> DataFrame:
    """Trimmed mean over units of the step at the cliff: the mean of reach rows from it less that of reach rows before."""
    rows = df.join(cliffs.where("cliff IS NOT NULL"), list(unit))
    gap = F.col(order) - F.col("cliff")
    after, before = F.when(gap.between(0, reach), F.col(value)), F.when(gap.between(-reach, -1), F.col(value))
    steps = rows.groupBy(*dict.fromkeys([*unit, *by])).agg((F.avg(after) - F.avg(before)).alias("_step"), F.count(after).alias("_a"), F.count(before).alias("_b")).where((F.col("_a") >= least) & (F.col("_b") >= least))
    return trimmed_mean(steps, by, "_step", out="severity")


def wear_gradient(df: DataFrame, unit: Sequence[str], by: Sequence[str], order: str, value: str, *, lo: int, hi: int, min_r2: float = 0.1) -> DataFrame:
    """Trimmed mean over units of positive slopes on a range of steps that explain min_r2 of the spread."""
    rows = df.where(F.col(order).between(lo, hi))
    fits = rows.groupBy(*dict.fromkeys([*unit, *by])).agg(ols(order, value).alias("_slope"), r_squared(order, value).alias("_r2")).where((F.col("_slope") > 0) & (F.col("_r2") > min_r2))
    return trimmed_mean(fits, by, "_slope", out="gradient")


def fit_cells(df: DataFrame, cell: Sequence[str], pool: Sequence[str], kind: str, value: str, *, min_n: int, defaults: Mapping[str, float], bounds: tuple[float, float]) -> DataFrame:
    """fitted: the cell's median, else the pool's, else the kind's default, within bounds; and where it came from."""
    grain = list(dict.fromkeys([*cell, *pool, kind]))
    cells = df.groupBy(*grain).agg(F.count(value).alias("n")).join(grouped_median(df, grain, value, "_c"), grain, "left")
    pools = df.groupBy(*pool).agg(F.count(value).alias("_pn")).join(grouped_median(df, pool, value, "_p"), list(pool), "left")
    known = F.create_map(*[F.lit(x) for item in defaults.items() for x in item])
    own, pooled = F.when(F.col("n") >= min_n, F.col("_c")), F.when(F.col("_pn") >= min_n, F.col("_p"))
    fitted = F.coalesce(own, pooled, F.try_element_at(known, F.col(kind)))
    source = F.when(own.isNotNull(), "cell").when(pooled.isNotNull(), "pool").otherwise("default")
    return cells.join(pools, list(pool)).select(*cell, "n", F.greatest(F.lit(bounds[0]), F.least(fitted, F.lit(bounds[1]))).alias("fitted"), source.alias("source"))


def calibrate(df: DataFrame, by: Sequence[str], x: str, y: str, prior: float, *, tolerance: float = 0.5, min_n: int = 10) -> DataFrame:
    """Slope of y on x over rows within the 5th to 95th percentile of y; used where it is near enough to the prior."""
    bounds = grouped_quantiles(df, by, y, {"_lo": 0.05, "_hi": 0.95})
    inside = df.join(bounds, list(by)).where(F.col(y).between(F.col("_lo"), F.col("_hi")))
    fits = inside.groupBy(*by).agg(ols(x, y).alias("measured"), F.count(y).alias("n"))
    near = (F.col("n") >= min_n) & (F.abs(ratio(F.col("measured") - prior, F.lit(float(prior)))) <= tolerance)
    return fits.withColumns({"used": F.when(near, F.col("measured")).otherwise(F.lit(float(prior))), "adopted": F.coalesce(near, F.lit(False))})
