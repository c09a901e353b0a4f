"""Projections, set operations, reshaping, top-k and de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.operators.estimators import exact_quantile
from lapwise.operators.windows import top_per_group
from lapwise.sources.scratch import settled


def stage(df: DataFrame, mapping: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Columns renamed and cast: {new: (old, type)}. Stateless, so a stream can be staged alike."""
    return df.select(*[F.col(old).cast(kind).alias(new) for new, (old, kind) in mapping.items()])


def in_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.where((F.col(column) > lo) & (F.col(column) < hi))


def outlier_bands(df: DataFrame, keys: Sequence[str], value: str, *, hard: float, soft: float) -> DataFrame:
    """ratio to the group's best, and whether it is over the hard bound or between soft and hard."""
    best = df.groupBy(*keys).agg(F.min(value).alias("best"))
    rated = df.join(best, list(keys)).withColumn("ratio", F.col(value) / F.nullif(F.col("best"), F.lit(0.0)))
    return rated.withColumns({"hard_outlier": F.coalesce(F.col("ratio") > hard, F.lit(False)), "soft_outlier": F.coalesce((F.col("ratio") > soft) & (F.col("ratio") <= hard), F.lit(False))})


def fuel_state(df: DataFrame, keys: Sequence[str], step: str, value: str, *, start_kg: float, cost: float, flat: bool = False) -> DataFrame:
    """Remaining mass after each step (constant if flat), its penalty, and the corrected value."""
    if flat:
        done = df.withColumn("fuel_kg", F.lit(start_kg))
    else:
        last = df.groupBy(*keys).agg(F.max(step).alias("_steps"))
        done = df.join(last, list(keys)).withColumn("fuel_kg", F.greatest(F.lit(start_kg) * (1 - F.col(step) / F.col("_steps")), F.lit(0.0))).drop("_steps")
    done = done.withColumn("fuel_penalty", F.col("fuel_kg") * cost)
    return done.withColumn("fuel_corrected", F.col(value) - F.col("fuel_penalty"))


def allocate(children: DataFrame, parent: DataFrame, keys: Sequence[str], child: str, total: str, component: str, out: str) -> DataFrame:
    """A parent's component shared among its children by their share of the total."""
    joined = children.join(parent.select(*keys, total, component), list(keys))
    return joined.withColumn(out, F.col(component) * F.col(child) / F.nullif(F.col(total), F.lit(0.0)))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per id and non-null column, in one scan."""
    return df.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def waterfall(df: DataFrame, keys: Sequence[str], components: Sequence[str]) -> DataFrame:
    """component, place, start and finish of running bars in the listed order; null components count as zero."""
    values = [F.coalesce(F.col(c), F.lit(0.0)) for c in components]
    bars, before = [], F.lit(0.0)
    for i, (c, v) in enumerate(zip(components, values, strict=True)):
        bars.append(F.struct(F.lit(c).alias("component"), F.lit(i + 1).alias("place"), before.alias("start"), (before + v).alias("finish")))
        before = before + v
    return df.select(*keys, F.explode(F.array(*bars)).alias("bar")).select(*keys, "bar.*")


def scenario_grid(df: DataFrame, n: int, out: str = "step") -> DataFrame:
    """Every row once for each step from 1 to n."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key; order must name a tiebreak."""
    return top_per_group(df, keys, order, 1)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def topk_overlap(df: DataFrame, by: Sequence[str], item: str, a: str, b: str, k: int) -> DataFrame:
    """overlap: share of the top k by a that are also in the top k by b, per group."""
    top = lambda v: top_per_group(df, by, [F.desc(v), item], k).select(*by, item)
    first, second = top(a), top(b).withColumn("_hit", F.lit(1))
    return first.join(second, [*by, item], "left").groupBy(*by).agg((F.coalesce(F.sum("_hit"), F.lit(0)) / k).alias("overlap"))


def symmetric_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in one only, with the side they are in."""
    return a.join(b, list(keys), "left_anti").select(*keys, F.lit("left").alias("side")).unionByName(b.join(a, list(keys), "left_anti").select(*keys, F.lit("right").alias("side")))


def quadrant(df: DataFrame, x: str, y: str) -> DataFrame:
    """quadrant by the population medians of x and y; a value that is a median is compared with itself as written."""
    df = settled(df, "quadrant")
    mx, my = (F.lit(exact_quantile(df, c, 0.5)).cast("double") for c in (x, y))
    return df.withColumn("quadrant", F.concat(F.when(F.col(y) >= my, "high").otherwise("low"), F.lit("_"), F.when(F.col(x) >= mx, "right").otherwise("left")))


def span_cohort(df: DataFrame, entity: str, period: str) -> DataFrame:
    """cohort of each entity by its first and last period against the whole range."""
    whole = df.agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))  # one row
    own = df.groupBy(entity).agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"))
    label = F.when((F.col("first_period") == F.col("_lo")) & (F.col("last_period") == F.col("_hi")), "throughout").when(F.col("first_period") == F.col("_lo"), "left").when(F.col("last_period") == F.col("_hi"), "joined").otherwise("passing")
    return own.crossJoin(F.broadcast(whole)).withColumn("cohort", label).drop("_lo", "_hi")
