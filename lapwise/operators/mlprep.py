"""Preparation, evaluation and scoring helpers for models over panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lapwise.operators.estimators import exact_quantile, ratio
from lapwise.operators.windows import over


@dataclass(frozen=True)
class FeatureSpec:
    """Features by group, columns that must never be features, and per-target exclusions."""

    groups: Mapping[str, Sequence[str]]
    leaky: frozenset[str] = frozenset()
    masks: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def features(self, df: DataFrame, target: str) -> list[str]:
        """Registered features that df has, without those masked for the target; an error if one leaks."""
        wanted = [f for g in self.groups.values() for f in g if f in df.columns and f not in self.masks.get(target, ())]
        if bad := sorted(self.leaky.intersection(wanted)):
            raise ValueError(f"features that leak: {bad}")
        return wanted


def period_split(df: DataFrame, period: str) -> DataFrame:
    """split: holdout for the last period, train for those before."""
    last = df.agg(F.max(period).alias("_last"))
    return df.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col(period) == F.col("_last"), "holdout").otherwise("train")).drop("_last")


def period_folds(df: DataFrame, period: str, n: int) -> DataFrame:
    """fold and role of the rows of each of the last n expanding folds: valid in one period, train before it."""
    ranked = df.select(period).distinct().withColumn("_r", F.row_number().over(Window.orderBy(period)))  # a row per period
    last = ranked.agg(F.max("_r").alias("_m"))
    folds = ranked.crossJoin(F.broadcast(last)).where(F.col("_r") > F.col("_m") - n).select(F.col(period).alias("_p"), (F.col("_r") - F.col("_m") + n).alias("fold"))
    return df.join(F.broadcast(folds), F.col(period) <= F.col("_p")).withColumn("role", F.when(F.col(period) == F.col("_p"), "valid").otherwise("train")).drop("_p")


def remaining_life(df: DataFrame, unit: Sequence[str], pos: str) -> DataFrame:
    """remaining: rows of the unit after this one."""
    sizes = df.groupBy(*unit).agg(F.max(pos).alias("_n"))
    return df.join(sizes, list(unit), "left").withColumn("remaining", F.greatest(F.col("_n") - F.col(pos), F.lit(0))).drop("_n")


def fit_encoder(train: DataFrame, column: str) -> DataFrame:
    """value and code of each category of the training rows, by sorted order."""
    values = train.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)  # a row per category


def encode(df: DataFrame, encoder: DataFrame, column: str, out: str) -> DataFrame:
    """The code of the category; -1 for unknown ones and null."""
    return df.join(encoder.select(F.col("value").alias(column), F.col("code").alias("_code")), column, "left").withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_code")


def encode_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Booleans and numbers as floats; nulls stay null."""
    return df.withColumns({c: F.col(c).cast("int").cast("float") if df.schema[c].dataType == T.BooleanType() else F.col(c).cast("float") for c in columns})


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("content"))


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """weight of each class: n / (classes x count)."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(y, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def regression_metrics(df: DataFrame, y: str, p: str, alpha: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """rmse, mae and pinball loss."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.greatest(alpha * e, (alpha - 1) * e)).alias("pinball"), F.count(e).alias("n"))


def macro_f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: the mean over actual or predicted classes of 2 tp / (2 tp + fp + fn)."""
    tp = df.where(F.col(y) == F.col(p)).groupBy(F.col(y).alias("c")).agg(F.count(F.lit(1)).alias("tp"))
    own = df.groupBy(F.col(y).alias("c")).agg(F.count(F.lit(1)).alias("a"))
    guessed = df.groupBy(F.col(p).alias("c")).agg(F.count(F.lit(1)).alias("b"))
    joined = own.join(guessed, "c", "full").join(tp, "c", "left")
    return joined.agg(F.avg(2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)))).alias("macro_f1"))


def cell_baseline(train: DataFrame, rows: DataFrame, keys: Sequence[str], fallback: str, value: str, agg=F.avg) -> DataFrame:
    """baseline: the cell's aggregate of the training rows, else the category's, else the whole's."""
    cell = train.groupBy(*keys).agg(agg(value).alias("_c"))
    category = train.groupBy(fallback).agg(agg(value).alias("_k"))
    whole = train.agg(agg(value).alias("_w"))
    joined = rows.join(cell, list(keys), "left").join(category, fallback, "left").crossJoin(F.broadcast(whole))
    return joined.withColumn("baseline", F.coalesce("_c", "_k", "_w")).drop("_c", "_k", "_w")


def cohort_metrics(df: DataFrame, cohort: str, y: str, p: str, *, least: int = 30) -> DataFrame:
    """Metrics per cohort, small ones folded to _other; under: worse than all rows together."""
    sized = df.withColumn("_n", F.count(F.lit(1)).over(over([cohort]))).withColumn("cohort", F.when(F.col("_n") >= least, F.col(cohort).cast("string")).otherwise("_other"))
    found = regression_metrics(sized, y, p, keys=["cohort"])
    whole = regression_metrics(df, y, p).select(F.col("rmse").alias("_all"))
    return found.crossJoin(F.broadcast(whole)).withColumn("under", F.col("rmse") > F.col("_all")).drop("_all")


def permuted(df: DataFrame, column: str, key: str, *, seed: int = 5, bin_rows: int = 5000) -> DataFrame:
    """df with the values of the column dealt anew among its rows, by hash inside bins of about bin_rows rows."""
    bins = max(1, df.count() // bin_rows)
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(bins)))
    left = binned.drop(column).withColumn("_k", F.row_number().over(over(["_bin"], [key])))
    right = binned.select("_bin", F.col(column), F.row_number().over(Window.partitionBy("_bin").orderBy(F.xxhash64(key, F.lit(seed)), key)).alias("_k"))
    return left.join(right, ["_bin", "_k"]).drop("_bin", "_k")


def envelope(df: DataFrame, train: DataFrame, features: Sequence[str], out: str = "in_envelope") -> DataFrame:
    """out: whether every feature lies within its range in the training rows (a null feature does not)."""
    ranges = train.agg(*[agg(f).alias(f"_{name}_{f}") for f in features for name, agg in (("lo", F.min), ("hi", F.max))])  # one row
    inside = F.lit(True)
    for f in features:
        inside &= F.coalesce(F.col(f).between(F.col(f"_lo_{f}"), F.col(f"_hi_{f}")), F.lit(False))
    return df.crossJoin(F.broadcast(ranges)).withColumn(out, inside).drop(*[f"_{name}_{f}" for f in features for name in ("lo", "hi")])


def half(*keys: str) -> Column:
    """True for about half of the rows, by hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(2)) == 0


def conformal(df: DataFrame, y: str, lo: str, hi: str, key: str, level: float = 0.8) -> DataFrame:
    """Coverage on the test half before and after widening by the calibration half's order statistic of scores."""
    marked = df.withColumns({"_cal": half(key), "_s": F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))})
    calibration = marked.where("_cal")
    n = calibration.agg(F.count("_s")).first()[0]
    place = min(-(-(n + 1) * level // 1), n)
    widen = exact_quantile(calibration, "_s", (place - 1) / (n - 1) if n > 1 else 0.0)  # the order statistic at place
    test = marked.where(~F.col("_cal")).withColumn("widen", F.lit(widen).cast("double"))
    return test.agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("raw"), F.avg(F.col(y).between(F.col(lo) - F.col("widen"), F.col(hi) + F.col("widen")).cast("double")).alias("calibrated"), F.first("widen").alias("widen"), F.count(F.lit(1)).alias("n"))


def ordered_quantiles(df: DataFrame, columns: Sequence[str], floor: float | None = None) -> DataFrame:
    """The quantile columns put in ascending order within each row, floored; crossed: whether they were not."""
    ranked = F.array_sort(F.array(*columns))
    crossed = ~F.forall(F.sequence(F.lit(0), F.lit(len(columns) - 2)), lambda i: F.get(F.array(*columns), i) <= F.get(F.array(*columns), i + 1))
    out = df.withColumns({"_r": ranked, "crossed": crossed})
    value = lambda i: F.get("_r", F.lit(i)) if floor is None else F.greatest(F.get("_r", F.lit(i)), F.lit(floor))
    return out.withColumns({c: value(i) for i, c in enumerate(columns)}).drop("_r")


PREDICTION = T.StructType([T.StructField(n, t) for n, t in (
    ("row_id", T.LongType()), ("unit_id", T.StringType()), ("entity", T.LongType()), ("grp", T.LongType()), ("context", T.LongType()), ("period", T.LongType()), ("step", T.LongType()), ("pos", T.LongType()), ("compound", T.StringType()),
    ("p10", T.DoubleType()), ("p50", T.DoubleType()), ("p90", T.DoubleType()), ("remaining", T.DoubleType()), ("bucket", T.StringType()), ("is_holdout", T.BooleanType()), ("in_envelope", T.BooleanType()), ("model", T.StringType()))])


def enforce_schema(df: DataFrame, schema: T.StructType = PREDICTION) -> DataFrame:
    """df with exactly the columns and types of the schema, in its order; an error if one is missing or does not fit."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return df.to(schema)


def shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n and share of all rows of each key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).withColumn("share", ratio(F.col("n").cast("double"), F.col("_t").cast("double"))).drop("_t")
