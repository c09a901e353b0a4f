"""Join operators. Lookups are joined plainly, so that Spark broadcasts them only below its size threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapwise.operators.windows import over


def enrich(fact: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """fact left-joined with each lookup on its keys."""
    for lookup, keys in lookups:
        fact = fact.join(lookup, list(keys), "left")
    return fact


SLICES, SLICE_ROWS = 128, 1_000_000


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Equality of keys and prefixed keys, where null equals null."""
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return match


def time_slices(rows: DataFrame, by: Sequence[str], t: str, *, slice_rows: int, slices: int = SLICES) -> DataFrame:
    """rows with _slice: 0, or for keys of over slice_rows rows the number of the key's cut times before t.

    The cuts are approximate quantiles of the key's times, so that its slices are about alike; rows of equal time share one.
    Only keys of so many rows get cuts; there are few of them.
    """
    named = [F.col(k).alias(f"_k_{k}") for k in by]
    large = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows).drop("_n")
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = rows.join(large, same_keys(by, "_k_"), "left_semi").groupBy(*named).agg(F.array_distinct(F.percentile_approx(t, shares, 1000)).alias("_cuts"))
    cut = rows.join(cuts, same_keys(by, "_k_"), "left").drop(*[f"_k_{k}" for k in by])
    before = F.size(F.filter("_cuts", lambda c: c < F.col(t)))
    return cut.withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(before)).drop("_cuts")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, columns: Sequence[str], *, tie: str | None = None, fallback: str | None = "first", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """left with the columns of the last right row at or before left_on, or of the first one where none precedes.

    Both sides go through one shuffle by key and time slice; at equal times the right side sorts first. Of right rows at one
    time the largest tie counts as last. A key of over slice_rows rows is cut into slices, so that it is many tasks; the last
    sample of the slices before is carried into each by a prefix over the key's slices, a row each. Null keys match each other.
    """
    picked = F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in columns])
    keyed = [F.col(b) for b in by]
    rows = left.select(*keyed, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"))
    samples = right.select(*keyed, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"), picked.alias("_right"))
    both = time_slices(rows.unionByName(samples, allowMissingColumns=True), by, "_t", slice_rows=slice_rows)
    order = F.when(F.col("_side") == 0, F.struct("_t", "_tie"))
    ends = both.groupBy(*by, "_slice").agg(F.max_by("_right", order).alias("_last"), F.min_by("_right", order).alias("_first"))
    slices = Window.partitionBy(*by).orderBy("_slice")
    carried = F.last("_last", ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, -1))
    earliest = F.first("_first", ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    outside = ends.select(*[F.col(k).alias(f"_s_{k}") for k in [*by, "_slice"]], F.coalesce(carried, earliest).alias("_outside") if fallback == "first" else carried.alias("_outside"))
    inside = F.last("_right", ignorenulls=True).over(Window.partitionBy(*by, "_slice").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_inside", inside).where("_side = 1").join(outside, same_keys([*by, "_slice"], "_s_"), "left")
    hit = F.coalesce("_inside", "_outside")
    return found.select("_left", hit.alias("_hit")).select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in columns])


def anti_before(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str) -> DataFrame:
    """left rows that no right row of the key precedes: one minimum per key instead of an unequal join."""
    first = right.groupBy(*by).agg(F.min(right_on).alias("_first"))
    return left.join(first, list(by), "left").where(F.col("_first").isNull() | (F.col("_first") > F.col(left_on))).drop("_first")


SPREAD, TOP = 4, 30


def span_candidates(points: DataFrame, spans: DataFrame, by: Sequence[str], point: str, start: str, end: str, *, width: float | None = None) -> DataFrame:
    """points with the spans of their key in whose bins they lie: the pairs that span_join tests.

    A span lies in the bins it touches at the first level whose bins are as wide as it is long, two at most; bins of a level
    are SPREAD times as wide as those of the level below. A point looks into one bin of each level that holds spans. So a
    point meets the spans near it that are about as long as a bin, not all spans of its key, and a key is dealt by its bins.
    width: of the narrowest bins, by default the median length of the spans. Spans that end before they start hold nothing;
    null keys match nothing.
    """
    real = lambda c: F.col(c).cast("double")
    length = real(end) - real(start)
    whole = spans.where(F.col(end) >= F.col(start))
    width = width or whole.agg(F.percentile_approx(length, 0.5)).first()[0] or 1.0
    level = F.when(length <= width, 0).otherwise(F.least(F.lit(TOP), F.ceil(F.log(float(SPREAD), length / width)).cast("int")))
    leveled = whole.withColumn("_level", level)
    used = [r[0] for r in leveled.select("_level").distinct().collect()]  # TOP + 1 numbers at most
    if not used:
        return points.limit(0).join(spans, list(by))
    bin_of = lambda x, level: F.floor(x / (F.lit(float(width)) * F.pow(F.lit(float(SPREAD)), level)))
    placed = leveled.withColumn("_bin", F.explode(F.sequence(bin_of(real(start), F.col("_level")), bin_of(real(end), F.col("_level")))))
    probes = points.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(used))))).withColumn("_bin", bin_of(real(point), F.col("_level")))
    return probes.join(placed, [*by, "_level", "_bin"]).drop("_level", "_bin")


def span_join(points: DataFrame, spans: DataFrame, by: Sequence[str], point: str, start: str, end: str, *, width: float | None = None) -> DataFrame:
    """points with the spans of their key that hold them, ends included, by an index of bins (span_candidates)."""
    return span_candidates(points, spans, by, point, start, end, width=width).where(F.col(point).between(F.col(start), F.col(end)))


def segment_join(points: DataFrame, segments: DataFrame, by: Sequence[str], point: str, start: str, end: str, *, lookup: bool = False) -> DataFrame:
    """Points with the segments of their key that hold them, ends included; lookup: segments are a table of a few rows a key."""
    if lookup:
        return points.join(segments, list(by)).where(F.col(point).between(F.col(start), F.col(end)))
    return span_join(points, segments, by, point, start, end)


def band_median(df: DataFrame, by: Sequence[str], order: str, value: str, k: int, out: str = "band_median") -> DataFrame:
    """Median of the value over the steps within k of each step, by step value rather than row count."""
    return df.withColumn(out, F.percentile(value, 0.5).over(Window.partitionBy(*by).orderBy(order).rangeBetween(-k, k)))


def median_of(values: Column) -> Column:
    """Median of an array, nulls left out; null of an empty one."""
    ranked = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(ranked)
    return F.when(n > 0, (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2)


def rolling_mad(df: DataFrame, by: Sequence[str], order: str, value: str, width: int, floor: float = 0.0) -> DataFrame:
    """roll_median and roll_mad over the trailing width steps, the row's own included; the frame bounds the arrays."""
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(-(width - 1), 0)
    framed = df.withColumn("_frame", F.collect_list(value).over(w))
    middle = framed.withColumn("roll_median", median_of(F.col("_frame")))
    return middle.withColumn("roll_mad", F.greatest(median_of(F.transform("_frame", lambda x: F.abs(x - F.col("roll_median")))), F.lit(floor))).drop("_frame")


def pairs(df: DataFrame, context: Sequence[str], entity: str, columns: Sequence[str], *, ordered: bool = True) -> DataFrame:
    """Pairs of different entities in the same context: a_<column> and b_<column>; one of each two if not ordered."""
    side = lambda s: df.select(*context, F.col(entity).alias(f"{s}_{entity}"), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    a, b = F.col(f"a_{entity}"), F.col(f"b_{entity}")
    return side("a").join(side("b"), list(context)).where(a != b if ordered else a < b)


def pair_delta(pair_rows: DataFrame, metrics: DataFrame, keys: Sequence[str], entity: str, value: str, digits: int = 3) -> DataFrame:
    """delta of the value of a less that of b at each sub-key of a; a partner's missing value counts as zero."""
    sub = [c for c in metrics.columns if c not in (entity, value)]
    a = metrics.select(*sub, F.col(entity).alias(f"a_{entity}"), F.col(value).alias("_a"))
    b = metrics.select(*sub, F.col(entity).alias(f"b_{entity}"), F.col(value).alias("_b"))
    joined = pair_rows.select(*keys, f"a_{entity}", f"b_{entity}").distinct().join(a, [*keys, f"a_{entity}"]).join(b, [*sub, f"b_{entity}"], "left")
    return joined.withColumn("delta", F.round(F.col("_a") - F.coalesce("_b", F.lit(0.0)), digits)).drop("_a", "_b")


def with_scalar(df: DataFrame, *aggregates: Column, source: DataFrame | None = None) -> DataFrame:
    """df with a one-row aggregate of source (itself by default) on every row."""
    return df.crossJoin(F.broadcast((df if source is None else source).agg(*aggregates)))


def expand(df: DataFrame, alternatives: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row with every alternative of its key."""
    return df.join(alternatives, list(by))


def join_roles(df: DataFrame, lookup: DataFrame, key: str, roles: dict[str, str]) -> DataFrame:
    """The same lookup joined once per role: {role: column of df}; its columns get the role as prefix."""
    for role, column in roles.items():
        named = lookup.select(*[F.col(c).alias(f"{role}_{c}") for c in lookup.columns])
        df = df.join(named, F.col(column) == F.col(f"{role}_{key}"), "left").drop(f"{role}_{key}")
    return df


def override(df: DataFrame, overrides: DataFrame, keys: Sequence[str], wildcard: str, value: str) -> DataFrame:
    """The value of the override for exactly this wildcard column, else of the one whose wildcard column is null."""
    exact = overrides.where(F.col(wildcard).isNotNull()).select(*keys, wildcard, F.col(value).alias("_exact"))
    general = overrides.where(F.col(wildcard).isNull()).select(*keys, F.col(value).alias("_general"))
    return df.join(exact, [*keys, wildcard], "left").join(general, list(keys), "left").withColumn(value, F.coalesce("_exact", "_general")).drop("_exact", "_general")


def exclude(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left_anti")


def exists_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Whether other has a row of the same keys."""
    return df.join(other.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left").withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


def interval_join(spans: DataFrame, events: DataFrame, keys: Sequence[str], step: str, start: str, finish: str, slack: int = 1) -> DataFrame:
    """Events within a span of their keys, or at most slack after it."""
    wide = spans.withColumn("_to", F.col(finish) + slack)
    return span_join(events, wide, keys, step, start, "_to").drop("_to")


def next_period(df: DataFrame, entity: Sequence[str], period: str, value: str) -> DataFrame:
    """Each entity's row with its value one period later (inner)."""
    later = df.select(*entity, (F.col(period) - 1).alias(period), F.col(value).alias(f"next_{value}"))
    return df.join(later, [*entity, period])


def next_rank(df: DataFrame, scenario: Sequence[str], rank: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the columns of the row one rank below."""
    later = df.select(*scenario, (F.col(rank) - 1).alias(rank), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.join(later, [*scenario, rank])


def attach_group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group aggregates on every member row."""
    return df.withColumns({name: value.over(over(keys)) for name, value in aggregates.items()})
