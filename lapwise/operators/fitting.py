"""Fitted wear parameters of cells with fallback to wider pools, and how groups deviate from them.

Units (a run of rows) are reduced once; what is then grouped at several grains are units, not rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions import exprs as X
from lapwise.operators.estimators import ols, r_squared, ratio
from lapwise.operators.survival import detect_cliff, km_median, trimmed_mean
from lapwise.operators.windows import demean, over
from lapwise.sources.scratch import settled

LEVELS = ("cell", "pool")


def _key(level: str, columns: Sequence[str]) -> Column:
    """One string for the values of a level's columns, nulls included."""
    return F.to_json(F.struct(F.lit(level).alias("_level"), *[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def _units(rows: DataFrame, unit: Sequence[str], keys: Sequence[str], order: str, value: str, *, reach: int, detect_rows: int, min_rows: int, **options) -> DataFrame:
    """One row a unit: duration to the cliff or the last step, whether it was observed, and the step of the value at it."""
    cliffs = detect_cliff(rows, unit, order, value, **options)
    gap = F.col(order) - F.col("cliff")
    after, before = F.when(gap.between(0, reach), F.col(value)), F.when(gap.between(-reach, -1), F.col(value))
    sums = rows.join(cliffs, list(unit)).groupBy(*dict.fromkeys([*unit, *keys])).agg(F.count(F.lit(1)).alias("_rows"), F.max(order).alias("_last"), F.first("cliff").alias("_cliff"), (F.avg(after) - F.avg(before)).alias("_step"), F.count(after).alias("_after"), F.count(before).alias("_before"))
    seen = sums.where(F.col("_rows") >= min_rows).withColumn("_cliff", F.when(F.col("_rows") >= detect_rows, F.col("_cliff")))
    step = F.when(F.col("_cliff").isNotNull() & (F.col("_after") >= 2) & (F.col("_before") >= 2), F.col("_step"))
    return seen.select(*unit, *[c for c in keys if c not in unit], F.coalesce("_cliff", "_last").alias("duration"), F.col("_cliff").isNotNull().alias("observed"), step.alias("step_size"))


def _spread(units: DataFrame, levels: Mapping[str, Sequence[str]], *columns: Column | str) -> DataFrame:
    """Every unit once a level, under that level's key."""
    return units.select("*", F.explode(F.array(*[_key(name, keys) for name, keys in levels.items()])).alias("_key")).select("_key", *columns)


def fit_hierarchy(
    rows: DataFrame, unit: Sequence[str], cell: Sequence[str], pool: Sequence[str], kind: str, order: str, value: str, *, defaults: Mapping[str, tuple[float, float, float]], min_units: int = 8, min_pool_rows: int = 8, min_curve_units: int = 10, min_events: int = 4,
    onset_range: tuple[float, float] = (5.0, 100.0), severity_range: tuple[float, float] = (0.1, 8.0), gradient_range: tuple[float, float] = (0.005, 0.3), first_step: int = 3, min_r2: float = 0.1, reach: int = 5, detect_rows: int = 7, min_rows: int = 3, **options,
) -> DataFrame:
    """onset, severity and gradient of every cell, where they came from (source), and from how many units.

    A cell of min_units or more is fitted by itself; else its pool (of min_pool_rows rows or more, all cells that share the
    pool's columns); else its kind's defaults. Onset: the Kaplan-Meier median of durations to the cliff, from
    min_curve_units units; where half never reach it, the 75th percentile of min_events or more observed cliffs. Severity: a
    trimmed mean over units of the step at the cliff. Gradient: a trimmed mean over units of positive slopes from
    first_step to two steps before the onset of that level. What is missing is the kind's default; an onset beyond its range
    is moved to it; a severity or gradient beyond its range is the default.
    """
    levels = dict(zip(LEVELS, (cell, pool), strict=True))
    keys = list(dict.fromkeys([*cell, *pool, kind]))
    units = settled(_units(rows, unit, keys, order, value, reach=reach, detect_rows=detect_rows, min_rows=min_rows, **options), "units")
    default = lambda k: F.try_element_at(F.create_map(*[x for name, v in defaults.items() for x in (F.lit(name), F.lit(float(v[k])))]), F.col(kind))
    spread = _spread(units, levels, "duration", "observed", "step_size")
    counts = spread.groupBy("_key").agg(F.count(F.lit(1)).alias("units"), F.count_if("observed").alias("events"))
    medians = km_median(spread, ["_key"], "duration", "observed").withColumnRenamed("_key", "_k").join(counts, F.col("_k") == F.col("_key"))
    onsets = medians.where((F.col("units") >= min_curve_units) & (~F.col("fallback") | (F.col("events") >= min_events))).select("_key", F.col("median").alias("onset"))
    onsets = settled(onsets, "onsets")
    severities = trimmed_mean(spread.where("step_size IS NOT NULL"), ["_key"], "step_size", out="severity").drop("n")
    bounds = units.select(*unit, *[c for c in keys if c not in unit])
    for name, columns in levels.items():
        bounds = bounds.withColumn("_key", _key(name, columns)).join(onsets.withColumnRenamed("onset", f"_onset_{name}"), "_key", "left").drop("_key")
        bounds = bounds.withColumn(f"_to_{name}", F.greatest(F.lit(first_step), F.floor(F.coalesce(f"_onset_{name}", default(0))) - 2)).drop(f"_onset_{name}")
    inner = rows.select(*unit, F.col(order).cast("double").alias("_x"), F.col(value).cast("double").alias("_y")).join(bounds, list(unit)).where(F.col("_x") >= first_step)
    fits = []
    for name in levels:
        x, y = (F.when(F.col("_x") <= F.col(f"_to_{name}"), F.col(c)) for c in ("_x", "_y"))
        inner = inner.withColumns({f"_x_{name}": x, f"_y_{name}": y})
        fits += [ols(f"_x_{name}", f"_y_{name}").alias(f"_slope_{name}"), r_squared(f"_x_{name}", f"_y_{name}").alias(f"_r2_{name}"), F.count(f"_y_{name}").alias(f"_n_{name}")]
    slopes = inner.groupBy(*dict.fromkeys([*unit, *keys])).agg(*fits)
    sloped = F.explode(F.array(*[F.struct(_key(name, columns).alias("key"), F.when((F.col(f"_n_{name}") >= 3) & (F.col(f"_slope_{name}") > 0) & (F.col(f"_r2_{name}") > min_r2), F.col(f"_slope_{name}")).alias("slope")) for name, columns in levels.items()]))
    gradients = trimmed_mean(slopes.select(sloped.alias("s")).select(F.col("s.key").alias("_key"), F.col("s.slope").alias("slope")).where("slope IS NOT NULL"), ["_key"], "slope", out="gradient").drop("n")
    known = counts.drop("events")
    for one in (onsets, severities, gradients):
        known = known.join(one, "_key", "left")
    known = settled(known, "fits")
    sizes = rows.groupBy(*pool).agg(F.count(F.lit(1)).alias("_pool_rows"))
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(sizes, list(pool))
    for name, columns in levels.items():
        named = known.select("_key", *[F.col(c).alias(f"_{name}_{c}") for c in ("units", "onset", "severity", "gradient")])
        cells = cells.withColumn("_key", _key(name, columns)).join(named, "_key", "left").drop("_key")
    own, wide = F.coalesce("_cell_units", F.lit(0)) >= min_units, F.col("_pool_rows") >= min_pool_rows
    pick = lambda c: F.when(own, F.col(f"_cell_{c}")).when(wide, F.col(f"_pool_{c}"))
    within = lambda x, limits, k: F.when(x.between(*limits), x).otherwise(default(k))
    n, source = F.coalesce("_cell_units", F.lit(0)), F.when(own, "cell").when(wide, "pool").otherwise("default")
    notes = F.when(own, F.concat(F.lit("fitted from "), n.cast("string"), F.lit(" units")))
    notes = notes.when(wide, F.concat(F.lit("only "), n.cast("string"), F.lit(" units; used "), F.coalesce("_pool_units", F.lit(0)).cast("string"), F.lit(" of the pool"))).otherwise(F.concat(F.lit("only "), n.cast("string"), F.lit(" units; used defaults")))
    return cells.select(
        *keys, X.clamp(F.coalesce(pick("onset"), default(0)), *onset_range).alias("onset"), within(F.coalesce(pick("severity"), default(1)), severity_range, 1).alias("severity"), within(F.coalesce(pick("gradient"), default(2)), gradient_range, 2).alias("gradient"), source.alias("source"), n.cast("long").alias("n_units"), notes.alias("notes")
    )


def centred_shrunk(cells: DataFrame, by: Sequence[str], est: str, se: str, ok: str) -> DataFrame:
    """field, dev, tau2, shrunk and post_sd of each cell: deviations from the precision-weighted mean, shrunk to zero.

    Only cells that are ok make the mean and the variance between cells; the others are shrunk to zero, and their posterior
    deviation is the one between cells.
    """
    w = F.when(F.col(ok), 1 / (F.col(se) * F.col(se)))
    parts = cells.withColumn("_w", w).withColumn("field", ratio(F.sum(F.col("_w") * F.col(est)).over(over(by)), F.sum("_w").over(over(by)))).withColumn("dev", F.col(est) - F.col("field"))
    q, total, squares = (F.sum(x).over(over(by)) for x in (F.col("_w") * F.col("dev") * F.col("dev"), F.col("_w"), F.col("_w") * F.col("_w")))
    tau2 = F.greatest(F.coalesce(ratio(q - (F.count("_w").over(over(by)) - 1), total - ratio(squares, total)), F.lit(0.0)), F.lit(0.0))
    found = parts.withColumn("tau2", tau2).withColumn("_se2", F.col(se) * F.col(se))
    shrunk = F.when(F.col(ok), ratio(F.col("dev") * F.col("tau2"), F.col("tau2") + F.col("_se2"))).otherwise(0.0)
    post = F.when(~F.col(ok), F.sqrt("tau2")).when(F.col("tau2") <= 0, 0.0).otherwise(F.sqrt(1 / (1 / F.col("_se2") + 1 / F.col("tau2"))))
    return found.withColumns({"shrunk": shrunk, "post_sd": post}).drop("_w", "_se2")


def slope_sensitivity(rows: DataFrame, unit: Sequence[str], cell: Sequence[str], by: Sequence[str], age: str, value: str, *, min_rows: int = 20, min_units: int = 2, se_floor: float = 0.001) -> DataFrame:
    """How much faster than the field each cell's value rises with age: fixed-effects slopes, centred and shrunk."""
    from lapwise.operators.estimators import fe_slope

    fits = fe_slope(rows.where(F.col(age).isNotNull() & F.col(value).isNotNull()), unit, cell, age, value, min_rows=min_rows, min_units=min_units, se_floor=se_floor)
    return centred_shrunk(fits.withColumn("qualified", F.coalesce("qualified", F.lit(False))), by, "slope", "se", "qualified")


def hinge_sensitivity(
    rows: DataFrame, severities: DataFrame, unit: Sequence[str], cell: Sequence[str], by: Sequence[str], age: str, value: str, onset: str, *, deep: float = 2.0, min_post: int = 30, min_deep: int = 15, min_units: int = 5, se_floor: float = 1e-4, severity_floor: float = 0.3, limit: float = 3.0,
) -> DataFrame:
    """How each cell's onset lies beside the fitted one, as a shift in steps: positive is later.

    A second slope begins at the fitted onset (a hinge); with unit means taken away, the two slopes solve 2 x 2 normal
    equations. Hinge slopes are centred by precision and shrunk by the variance between cells; a deviation becomes a shift by
    the mean depth past the onset over the median severity of its field (severities: by, severity), and its error by the same
    factor. Cells without min_post rows past the onset, min_deep of them by deep steps, and min_units units, have shift zero.
    """
    x, z, y = F.col(age).cast("double"), F.greatest(F.col(age).cast("double") - F.coalesce(onset, F.lit(999.0)), F.lit(0.0)), F.col(value).cast("double")
    clean = rows.select(*dict.fromkeys([*unit, *cell]), x.alias("x"), z.alias("z"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    d = demean(clean, unit, ["x", "z", "y"])
    products = [F.sum(F.col(f"d_{a}") * F.col(f"d_{b}")).alias(a + b) for a, b in ("xx", "zz", "xz", "xy", "zy", "yy")]
    sums = d.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(X.key(*unit)).alias("units"), F.count_if(F.col("z") > 0).alias("n_post"), F.count_if(F.col("z") >= deep).alias("n_deep"), *products)
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    solved = sums.withColumn("det", F.when(det > 1e-9, det))
    solved = solved.withColumns({"hinge": (F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy")) / F.col("det"), "slope": (F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy")) / F.col("det")})
    left = F.greatest(F.col("yy") - F.col("slope") * F.col("xy") - F.col("hinge") * F.col("zy"), F.lit(0.0)) / F.greatest(F.col("n") - F.col("units") - 2, F.lit(1))
    enough = (F.col("n_post") >= min_post) & (F.col("n_deep") >= min_deep) & (F.col("units") >= min_units) & F.col("det").isNotNull()
    fits = solved.withColumns({"se": F.greatest(F.sqrt(left * F.col("xx") / F.col("det")), F.lit(se_floor)), "qualified": enough})
    centred = centred_shrunk(fits, by, "hinge", "se", "qualified")
    depth = clean.where("z > 0").groupBy(*by).agg(F.avg("z").alias("depth"))
    field = severities.groupBy(*by).agg(F.greatest(F.median("severity"), F.lit(severity_floor)).alias("severity"))
    joined = centred.join(depth, list(by), "left").join(field, list(by), "left").withColumn("_scale", ratio(F.col("depth"), F.col("severity")))
    free = -F.col("shrunk") * F.col("_scale")
    return joined.withColumns({"shift": F.coalesce(X.clamp(free, -limit, limit), F.lit(0.0)), "clipped": F.coalesce(F.abs(free) > limit, F.lit(False)), "shift_se": F.when(F.col("qualified"), F.col("se") * F.col("_scale"))}).drop("_scale", "xx", "zz", "xz", "xy", "zy", "yy", "det")
