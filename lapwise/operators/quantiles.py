"""Exact quantiles of many keys at once, where a key may hold any number of values.

percentile keeps every distinct value of a key in one buffer. Here an approximate summary of fixed size brackets each wanted
rank first; only the values inside a bracket, a few in a thousand of a key's, are counted by value (combined before the
shuffle) and put in order, and those below it are a count. The summary decides the work only: a rank outside its bracket,
which its guarantee rules out, would raise an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 2000


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float], *, accuracy: int = ACCURACY) -> DataFrame:
    """by and the interpolated quantiles of each group (name: share), exactly as percentile gives them.

    Null values do not count; groups without values have no row; null keys are a group.
    """
    names, shares = list(quantiles), list(quantiles.values())
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    margin = 2.5 / accuracy  # the summary's ranks are off by one in accuracy at most
    low, high = ([F.lit(min(1.0, max(0.0, p + way * margin))) for p in shares] for way in (-1, 1))
    about = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", F.array(*low, *high), accuracy).alias("_b"))
    few = F.col("_n") <= accuracy
    bounds = [F.struct(F.lit(i).alias("i"), F.when(few | F.lit(p - margin <= 0), F.col("_least")).otherwise(F.get("_b", F.lit(i))).alias("lo"), F.when(few | F.lit(p + margin >= 1), F.col("_most")).otherwise(F.get("_b", F.lit(len(shares) + i))).alias("hi")) for i, p in enumerate(shares)]
    about = about.select(*[F.col(b).alias(f"_k{j}") for j, b in enumerate(by)], "_n", F.array(*bounds).alias("_bounds"))
    match = F.lit(True)
    for j, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"_k{j}"))
    near = (rows.join(about, match) if by else rows.crossJoin(F.broadcast(about))).select(*by, "_n", "_v", F.explode(F.filter("_bounds", lambda b: F.col("_v") <= b["hi"])).alias("_at"))
    counted = near.groupBy(*by, F.col("_at.i").alias("_i"), F.when(F.col("_v") >= F.col("_at.lo"), F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    ends = counted.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    place = F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("_i") + 1) * (F.col("_n") - 1)
    placed = ends.withColumn("_place", place)
    inside = F.col("_x").isNotNull()
    at = lambda k: F.min(F.when(inside & (F.col("_end") > k), F.col("_x")))
    found = placed.groupBy(*by, "_i").agg(F.first("_place").alias("_place"), at(F.floor("_place")).alias("_a"), at(F.ceil("_place")).alias("_z"), F.min(F.when(inside, F.col("_end") - F.col("_c"))).alias("_below"))
    sure = F.col("_z").isNotNull() & (F.col("_below") <= F.floor("_place"))
    share = F.col("_place") - F.floor("_place")
    exact = F.when(~sure, F.raise_error(F.lit("a quantile lies outside its bracket"))).when(share == 0, F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_z"))
    return found.withColumn("_q", exact).groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)])


def grouped_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return grouped_quantiles(df, by, value, {out: 0.5})
