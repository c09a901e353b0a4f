"""Estimators in closed form: sums per group, then arithmetic. Partial sums combine before each shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapwise.functions import exprs as X
from lapwise.operators.quantiles import grouped_median
from lapwise.operators.windows import demean, over
from lapwise.sources.scratch import settled


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def wmean(x: Column, w: Column) -> Column:
    """Weighted mean over rows that have both."""
    both = x.isNotNull() & w.isNotNull()
    return ratio(F.sum(F.when(both, w * x)), F.sum(F.when(both, w)))


def wstd(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    """w_mean and w_std (about the weighted mean, in two passes) of each group."""
    means = df.groupBy(*keys).agg(wmean(F.col(x), F.col(w)).alias("w_mean"))
    squares = df.join(means, list(keys)).withColumn("_s", (F.col(x) - F.col("w_mean")) ** 2)
    return squares.groupBy(*keys).agg(F.first("w_mean").alias("w_mean"), F.sqrt(wmean(F.col("_s"), F.col(w))).alias("w_std"))


def field_curve(df: DataFrame, by: Sequence[str], order: str, value: str, *, lo: float = 0.1, hi: float = 0.9, half: int = 2) -> DataFrame:
    """Trimmed mean of each step by percent rank, raw and smoothed over half steps each way."""
    ranked = df.withColumn("_r", F.percent_rank().over(over([*by, order], [value])))
    curve = ranked.groupBy(*by, order).agg(F.avg(F.when(F.col("_r").between(lo, hi), F.col(value))).alias("field_raw"), F.count(value).alias("n"))
    return curve.withColumn("field_pace", F.avg("field_raw").over(over(by, [order]).rowsBetween(-half, half)))


def ols(x: str, y: str) -> Column:
    """Slope of y on x over rows that have both; null without spread in x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return ratio(F.covar_pop(xs, ys), F.var_pop(xs))


def r_squared(x: str, y: str) -> Column:
    """The squared correlation over rows that have both; null without spread in either, where corr divides by zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    shared = F.covar_pop(xs, ys)
    return ratio(shared * shared, F.var_pop(xs) * F.var_pop(ys))


def ols_slope(df: DataFrame, keys: Sequence[str], x: str, y: str, *, cap: float | None = None, out: str = "slope") -> DataFrame:
    """Slope of each group; cap bounds it from above."""
    slope = ols(x, y)
    return df.groupBy(*keys).agg((slope if cap is None else F.when(slope.isNotNull(), F.least(slope, F.lit(cap)))).alias(out), F.count(y).alias("n"))


def trend_components(df: DataFrame, keys: Sequence[str], t: str, y: str, covariate: str) -> DataFrame:
    """trend, covariate_part and remainder of each row: a slope on t, then one of what is left on the covariate."""
    slopes = df.groupBy(*keys).agg(F.least(F.coalesce(ols(t, y), F.lit(0.0)), F.lit(0.0)).alias("_b"), F.avg(t).alias("_t"), F.avg(covariate).alias("_c"), F.avg(y).alias("_y"))
    first = df.join(slopes, list(keys)).withColumn("trend", F.col("_b") * (F.col(t) - F.col("_t"))).withColumn("_left", F.col(y) - F.col("_y") - F.col("trend"))
    second = first.groupBy(*keys).agg(F.coalesce(ols(covariate, "_left"), F.lit(0.0)).alias("_g"))
    both = first.join(second, list(keys)).withColumn("covariate_part", F.col("_g") * (F.col(covariate) - F.col("_c")))
    return both.withColumn("remainder", F.col("_left") - F.col("covariate_part")).drop("_b", "_t", "_c", "_y", "_left", "_g")


def global_slope(df: DataFrame, y: str, x: str, default: float) -> DataFrame:
    """One row: slope of y on x, or default where x has no spread."""
    return df.agg(F.coalesce(ratio(F.covar_pop(F.col(y).cast("double"), F.col(x).cast("double")), F.var_pop(F.col(x).cast("double"))), F.lit(default)).alias("slope"), F.count(y).alias("n"))


def fe_slope(df: DataFrame, unit: Sequence[str], cell: Sequence[str], x: str, y: str, *, min_rows: int = 20, min_units: int = 2, se_floor: float = 0.001) -> DataFrame:
    """Slope of each cell after taking unit means away, its standard error (n - units - 1 degrees, floored), qualified."""
    d = demean(df.select(*{*unit, *cell}, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), unit, ["x", "y"])
    unit_key = X.key(*unit)
    sums = d.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(unit_key).alias("units"), F.sum(F.col("d_x") * F.col("d_x")).alias("sxx"), F.sum(F.col("d_x") * F.col("d_y")).alias("sxy"), F.sum(F.col("d_y") * F.col("d_y")).alias("syy"))
    slope = ratio(F.col("sxy"), F.col("sxx"))
    sse = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    dof = F.col("n") - F.col("units") - 1
    se = F.greatest(F.sqrt(ratio(F.when(dof > 0, sse / dof), F.col("sxx"))), F.lit(se_floor))
    return sums.select(*cell, "n", "units", slope.alias("slope"), se.alias("se"), ((F.col("n") >= min_rows) & (F.col("units") >= min_units) & slope.isNotNull() & se.isNotNull()).alias("qualified"))


def fe_slope2(df: DataFrame, unit: Sequence[str], cell: Sequence[str], x: str, z: str, y: str, *, se_floor: float = 0.001) -> DataFrame:
    """Slopes on x and z of each cell, after unit means, by the 2 x 2 normal equations, with standard errors."""
    cols = {"x": x, "z": z, "y": y}
    d = demean(df.select(*{*unit, *cell}, *[F.col(c).cast("double").alias(a) for a, c in cols.items()]), unit, list(cols))
    s = {a + b: F.sum(F.col(f"d_{a}") * F.col(f"d_{b}")).alias(a + b) for a, b in ("xx", "zz", "xz", "xy", "zy", "yy")}
    sums = d.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(X.key(*unit)).alias("units"), *s.values())
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    det = F.when(F.abs(det) > 1e-9, det)
    bx = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det
    bz = (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    dof = F.col("n") - F.col("units") - 2
    s2 = F.when(dof > 0, F.greatest(F.col("yy") - bx * F.col("xy") - bz * F.col("zy"), F.lit(0.0)) / dof)
    return sums.select(*cell, "n", "units", bx.alias("slope_x"), bz.alias("slope_z"), F.greatest(F.sqrt(s2 * F.col("zz") / det), F.lit(se_floor)).alias("se_x"), F.greatest(F.sqrt(s2 * F.col("xx") / det), F.lit(se_floor)).alias("se_z"))


def precision_center(df: DataFrame, by: Sequence[str], est: str, se: str) -> DataFrame:
    """field (precision-weighted mean of the group) and dev from it."""
    w = 1 / (F.col(se) * F.col(se))
    return df.withColumn("field", ratio(F.sum(w * F.col(est)).over(over(by)), F.sum(F.when(F.col(est).isNotNull(), w)).over(over(by)))).withColumn("dev", F.col(est) - F.col("field"))


def dl_tau2(df: DataFrame, by: Sequence[str], dev: str, se: str) -> DataFrame:
    """tau2: the DerSimonian-Laird variance between the members of each group, zero at least."""
    w = 1 / (F.col(se) * F.col(se))
    sums = df.groupBy(*by).agg(F.count(dev).alias("_k"), F.sum(w * F.col(dev) * F.col(dev)).alias("_q"), F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"))
    scale = F.col("_w") - ratio(F.col("_w2"), F.col("_w"))
    return sums.select(*by, F.greatest(F.coalesce(ratio(F.col("_q") - (F.col("_k") - 1), scale), F.lit(0.0)), F.lit(0.0)).alias("tau2"))


def eb_shrink(dev: Column, se: Column, tau2: Column, ok: Column) -> tuple[Column, Column]:
    """Deviation shrunk towards zero by tau2 / (tau2 + se squared), and its posterior deviation; zero where not ok."""
    b = F.coalesce(ratio(tau2, tau2 + se * se), F.lit(0.0))
    usable = F.coalesce(ok, F.lit(False))
    return F.when(usable, b * dev).otherwise(0.0), F.when(usable, F.sqrt(b) * se).otherwise(F.sqrt(tau2))


def onset_shift(df: DataFrame, by: Sequence[str], slope_dev: str, se: str, severity: str, depth: str, limit: float = 3.0) -> DataFrame:
    """shift: a slope deviation as an equivalent shift of onset by the group's median severity and mean depth, clipped."""
    group = df.groupBy(*by).agg(F.median(severity).alias("_sev"), F.avg(depth).alias("_depth"))
    scale = ratio(F.col("_depth"), F.col("_sev"))
    return df.join(group, list(by)).withColumns({"shift": X.clamp(-F.col(slope_dev) * scale, -limit, limit), "shift_se": F.abs(scale) * F.col(se)}).drop("_sev", "_depth")


def variance_components(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row: the pooled variance within groups and the variance between their means."""
    cells = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    return cells.agg(ratio(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.when(F.col("v").isNotNull(), F.col("n") - 1))).alias("within"), F.var_samp("m").alias("between"))


def group_effect(df: DataFrame, period: Sequence[str], group: str, value: str, *, min_n: int = 5) -> DataFrame:
    """effect: median of each group in a period, re-centred on the period's mean; se and a 95 % interval."""
    stats = df.groupBy(*period, group).agg(F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).where(F.col("n") >= min_n)
    medians = stats.join(grouped_median(df, [*period, group], value, "mid"), [*period, group])
    centred = medians.withColumn("effect", F.col("mid") - F.avg("mid").over(over(period))).withColumn("se", F.col("sd") / F.sqrt("n"))
    lo, hi = X.interval(F.col("effect"), F.col("se"))
    return centred.select(*period, group, "n", "effect", "se", lo.alias("lo"), hi.alias("hi"))


def interaction(df: DataFrame, group: str, context: str, period: str, value: str, *, weight: float = 5.0) -> DataFrame:
    """Mean of each group in a context less its mean over the period, shrunk towards zero."""
    cells = df.groupBy(period, group, context).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    whole = df.groupBy(period, group).agg(F.avg(value).alias("_all"))
    return cells.join(whole, [period, group]).select(period, group, context, "n", X.bayes_shrink(F.col("n"), F.col("m") - F.col("_all"), 0.0, weight).alias("interaction"))


def era_adjust(df: DataFrame, entity: str, period: str, value: str, se: str, *, boundary: int, min_n: int) -> DataFrame:
    """adjusted: ratings of the later era moved by the mean change of entities with min_n periods in both eras."""
    late = F.col(period) >= boundary
    anchors = df.groupBy(entity).agg(F.count_if(~late).alias("_a"), F.count_if(late).alias("_b"), (F.avg(F.when(late, F.col(value))) - F.avg(F.when(~late, F.col(value)))).alias("_d")).where((F.col("_a") >= min_n) & (F.col("_b") >= min_n))
    offset = anchors.agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("offset"), F.coalesce(ratio(F.stddev_samp("_d"), F.sqrt(F.count("_d"))), F.lit(0.0)).alias("offset_se"), F.count("_d").alias("anchors"))
    return df.crossJoin(F.broadcast(offset)).withColumns({"adjusted": F.when(late, F.col(value) - F.col("offset")).otherwise(F.col(value)), "adjusted_se": F.when(late, F.sqrt(F.col(se) ** 2 + F.col("offset_se") ** 2)).otherwise(F.col(se))})


def first_breach(df: DataFrame, keys: Sequence[str], step: str, test: Column, cost: str) -> DataFrame:
    """breach: the first step where test holds, and overrun: the positive cost at and after it."""
    first = df.withColumn("_b", F.min(F.when(test, F.col(step))).over(over(keys)))
    return first.groupBy(*keys).agg(F.min("_b").alias("breach"), F.coalesce(F.sum(F.when(F.col(step) >= F.col("_b"), F.greatest(F.col(cost), F.lit(0.0)))), F.lit(0.0)).alias("overrun"))


def loo_mean(df: DataFrame, keys: Sequence[str], value: str, out: str = "loo") -> DataFrame:
    """Mean of the group's other rows; null for a lone row."""
    w = over(keys)
    return df.withColumn(out, ratio(F.sum(value).over(w) - F.col(value), (F.count(value).over(w) - 1).cast("double")))


def order_uncertainty(pair_probs: DataFrame, scenario: Sequence[str], entity: str, rank: str, other_rank: str, p: str) -> DataFrame:
    """sd of the finishing rank from pairwise probabilities, and the probability of beating the next rank."""
    return pair_probs.groupBy(*scenario, entity).agg(F.sqrt(F.sum(F.col(p) * (1 - F.col(p)))).alias("rank_sd"), F.max(F.when(F.col(other_rank) == F.col(rank) + 1, F.col(p))).alias("p_beats_next"))


def confusion(df: DataFrame, predicted: str, actual: str, classes: Sequence[str]) -> DataFrame:
    """n and share of the actual class for every pair of classes, zeros included."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], "c string")
    grid = names.select(F.col("c").alias(actual)).crossJoin(names.select(F.col("c").alias(predicted)))  # a row per pair of classes
    counts = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("_n"))
    filled = grid.join(counts, [actual, predicted], "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")
    return filled.withColumn("share", ratio(F.col("n").cast("double"), F.sum("n").over(over([actual])).cast("double")))


def coverage(df: DataFrame, y: str, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose y lies within lo and hi; rows without any of them do not count."""
    inside = F.col(y).between(F.col(lo), F.col(hi)).cast("double")
    return df.groupBy(*keys).agg(F.avg(inside).alias("coverage"), F.count(inside).alias("n"))


def exact_quantile(df: DataFrame, value: str, p: float, *, accuracy: int = 10_000) -> float | None:
    """The interpolated quantile of all rows, exactly; None without values.

    An approximate quantile, whose rank is off by one in accuracy at most, brackets it; only the values inside the bracket,
    about two in a thousand, meet in one task. Nothing but counts and bounds comes to the driver. The values are written once:
    sums made anew for each pass add up in another order and differ in the last digits, so that a bound would miss its own value.
    """
    rows = settled(df.select(value).where(F.col(value).isNotNull()), "quantile")
    margin = 10 / accuracy
    n, lo, hi, least, most = rows.agg(F.count(F.lit(1)), F.percentile_approx(value, max(0.0, p - margin), accuracy), F.percentile_approx(value, min(1.0, p + margin), accuracy), F.min(value), F.max(value)).first()
    if not n:
        return None
    lo, hi = (least if p <= margin or n <= accuracy else lo), (most if p >= 1 - margin or n <= accuracy else hi)
    place = p * (n - 1)
    below = rows.where(F.col(value) < lo).count()
    inside = rows.where(F.col(value).between(lo, hi)).groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_end", F.sum("_n").over(over([], [value])) + below)
    at = lambda k: F.min(F.when(F.col("_end") > k, F.col(value)))
    first, second = inside.agg(at(math.floor(place)), at(math.ceil(place))).first()
    return float(first) + (place - math.floor(place)) * (float(second) - float(first))


def kendall_tau(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """tau: Kendall's tau-b of two scores per group of two rows or more, by counting inversions, not pairs.

    Rows are ranked by a; two rows of different ranks part at one binary digit of them. So for each digit, rows are grouped
    by the digits above it, and going up by b, those with a one meet the number of those with a zero so far. That is a row
    per row and digit: n log n, where pairs would be n squared. Ties in either score count for neither side.
    """
    dense = lambda c: (F.dense_rank().over(over(by, [c])) - 1).cast("long")
    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, dense(a).alias("_ra"), dense(b).alias("_rb"))
    digits = F.length(F.bin(F.max("_ra").over(over(by))))
    apart = ranked.withColumn("_digits", digits).withColumn("_digit", F.explode(F.sequence(F.lit(0), F.col("_digits") - 1))).withColumns({"_above": F.expr("shiftright(_ra, _digit + 1)"), "_one": F.expr("shiftright(_ra, _digit) & 1")})
    counted = apart.groupBy(*by, "_digit", "_above", "_rb").agg(F.sum("_one").alias("_ones"), F.sum(1 - F.col("_one")).alias("_zeros"))
    before = F.coalesce(F.sum("_zeros").over(over([*by, "_digit", "_above"], ["_rb"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alike = counted.withColumn("_met", F.col("_ones") * before).groupBy(*by).agg(F.sum("_met").alias("_alike"))
    pairs_of = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = ranked.groupBy(*by, "_ra", "_rb").agg(F.count(F.lit(1)).alias("_n"))
    ties = both.groupBy(*by).agg(pairs_of("_n").alias("_both"), F.sum("_n").alias("_rows"))
    for name, rank in (("_in_a", "_ra"), ("_in_b", "_rb")):
        ties = ties.join(both.groupBy(*by, rank).agg(F.sum("_n").alias("_n")).groupBy(*by).agg(pairs_of("_n").alias(name)), list(by))
    total = F.col("_rows") * (F.col("_rows") - 1) / 2
    score = 2 * F.col("_alike") - (total - F.col("_in_a") - F.col("_in_b") + F.col("_both"))
    return ties.join(alike, list(by)).where("_rows > 1").select(*by, ratio(score, F.sqrt((total - F.col("_in_a")) * (total - F.col("_in_b")))).alias("tau"))
