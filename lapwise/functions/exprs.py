"""Column functions: no UDF, so every expression stays inside Catalyst. Null inputs give null unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ns_to_s(x: Column | str) -> Column:
    """Nanoseconds to seconds."""
    return col(x).cast("double") / 1e9


def null_tokens(x: Column | str, tokens: Sequence[str] = ("NONE", "NAN", "UNKNOWN", "NULL", "")) -> Column:
    """Upper case, with tokens that mean nothing as null."""
    return F.when(~F.upper(col(x)).isin(*tokens), F.upper(col(x)))


def status_flag(x: Column | str, digits: str) -> Column:
    """True where any of the digits occurs in a status string; null counts as none."""
    return F.coalesce(col(x).rlike(f"[{digits}]"), F.lit(False))


def valid_row(accurate: Column, deleted: Column, *present: Column) -> Column:
    """Accurate, not deleted, all present; three-valued."""
    return reduce(lambda a, b: a & b.isNotNull(), present, accurate & ~deleted)


def clean_row(valid: Column, label: Column, normal: str = "normal", *, null_is_normal: bool = True) -> Column:
    """Valid rows of the normal class; a null class is normal or not by the variant."""
    return valid & (F.coalesce(label, F.lit(normal)) == normal if null_is_normal else label == normal)


def classify(rules: Sequence[tuple[Column, str, float]], default: tuple[str, float]) -> tuple[Column, Column]:
    """Label and weight of the first rule that holds."""
    label, weight = F.lit(default[0]), F.lit(default[1])
    for test, name, w in reversed(rules):
        label, weight = F.when(test, F.lit(name)).otherwise(label), F.when(test, F.lit(w)).otherwise(weight)
    return label, weight


def argmax_label(values: Mapping[str, Column]) -> Column:
    """Label of the component of largest absolute value; ties by listed order, null components never win."""
    sizes = {k: F.abs(F.coalesce(v, F.lit(0.0))) for k, v in values.items()}
    top = F.greatest(*sizes.values())
    return reduce(lambda found, item: F.when(item[1] == top, F.lit(item[0])).otherwise(found), reversed(list(sizes.items())), F.lit(None).cast("string"))


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    """x within lo and hi; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(lo), F.least(col(x), F.lit(hi))))


def confidence(n: Column, k: float) -> Column:
    """n / (n + k)."""
    return n / (n + F.lit(k))


def capped_confidence(n: Column, full: float) -> Column:
    return F.least(n / F.lit(full), F.lit(1.0))


def step_confidence(n: Column, steps: Sequence[tuple[int, float]], default: float) -> Column:
    """The value of the first step (minimum, value) that n reaches."""
    return reduce(lambda found, s: F.when(n >= s[0], F.lit(s[1])).otherwise(found), sorted(steps), F.lit(default))


def recovery_probability(ratio: Column, n: Column, *, steepness: float = 4.0, centre: float = 0.5, decay: float = 0.05) -> Column:
    """A sigmoid of ratio that fades with n, within 0 and 1."""
    return clamp(1 / (1 + F.exp(-steepness * (ratio - centre))) * F.exp(-decay * n), 0.0, 1.0)


def band(x: Column, lo: float, hi: float, labels: tuple[str, str, str] = ("surface", "mixed", "bulk")) -> Column:
    return F.when(x > hi, labels[0]).when(x < lo, labels[2]).when(x.isNotNull(), labels[1])


def gap_seconds(metres: Column, kph: Column) -> Column:
    """Seconds for a gap in metres at a speed in km/h; null at no speed."""
    return F.when(kph > 0, metres / (kph / 3.6))


def thirds(relative: Column) -> Column:
    """1, 2 or 3 by a position from 0 to 1."""
    return F.when(relative < 1 / 3, 1).when(relative < 2 / 3, 2).when(relative.isNotNull(), 3)


def hockey_stick(age: Column, *, base: float, gradient: float, onset: Column | float, severity: float, curve: float = 0.0, temp: Column | None = None, window: tuple[float, float] = (90.0, 110.0), temp_cost: float = 0.02) -> tuple[Column, Column]:
    """Loss by age (linear, quadratic, ramp after the onset, clipped temperature term) and its derivative by age."""
    onset = onset if isinstance(onset, Column) else F.lit(float(onset))
    over = F.greatest(age - onset, F.lit(0.0))
    heat = F.lit(0.0) if temp is None else clamp(F.greatest(F.lit(window[0]) - temp, temp - F.lit(window[1]), F.lit(0.0)) * temp_cost, 0.0, 1.0)
    return base + gradient * age + curve * age * age + severity * over + F.coalesce(heat, F.lit(0.0)), gradient + 2 * curve * age + F.when(age > onset, severity).otherwise(0.0)


def residual_of(total: Column, components: Sequence[Column]) -> Column:
    """What the components leave of the total; null components count as zero."""
    return reduce(lambda left, c: left - F.coalesce(c, F.lit(0.0)), components, total)


def slope_interaction(slope_delta: Column, exposure: Column) -> Column:
    return F.coalesce(slope_delta, F.lit(0.0)) * F.coalesce(exposure, F.lit(0.0))


def hinge_interaction(age: Column, onset_a: Column, onset_b: Column, severity: float, limit: float) -> Column:
    """Difference of two hinge ramps of shifted onsets, clipped."""
    ramp = lambda onset: F.greatest(age - onset, F.lit(0.0)) * severity
    return clamp(ramp(onset_b) - ramp(onset_a), -limit, limit)


def normal_cdf(x: Column | str) -> Column:
    """Standard normal distribution function by the Abramowitz-Stegun approximation 26.2.17, reflected for x < 0."""
    x = col(x)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    # Fixed values of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 1 - 0.3989422804014327 * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, upper).otherwise(1 - upper)


def bayes_shrink(n: Column, observed: Column, prior: Column | float, weight: float) -> Column:
    """Conjugate-normal mean: (n observed + weight prior) / (n + weight); no observation gives the prior."""
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (n * F.coalesce(observed, prior) + weight * prior) / (n + F.lit(weight))


def posterior_var(n: Column, within: Column, between: Column) -> Column:
    """1 / (n / within + 1 / between); null where a variance is zero."""
    return F.try_divide(F.lit(1.0), F.try_divide(n, within) + F.try_divide(F.lit(1.0), between))


def interval(x: Column, se: Column, z: float = 1.96) -> tuple[Column, Column]:
    return x - z * se, x + z * se


def key(*parts: Column | str, sep: str = "_") -> Column:
    """Parts joined by sep; null parts are left out."""
    return F.concat_ws(sep, *[col(p).cast("string") for p in parts])


def surrogate_key(*parts: Column | str) -> Column:
    """MD5 of the parts as text joined by hyphens, null parts as a fixed word."""
    return F.md5(F.concat_ws("-", *[F.coalesce(col(p).cast("string"), F.lit("_null_")) for p in parts]))


def slug(x: Column | str) -> Column:
    return F.lower(F.replace(F.replace(col(x), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))


def rx_int(x: Column | str, pattern: str, group: int = 1) -> Column:
    """The integer in a group of the pattern's first match; null without one."""
    return F.regexp_extract(col(x), pattern, group).try_cast("int")


def normalise(x: Column | str, mapping: Mapping[str, str]) -> Column:
    """Legacy categories by their names of today; others as they are."""
    return reduce(lambda found, item: F.when(F.upper(col(x)) == item[0], F.lit(item[1])).otherwise(found), mapping.items(), F.upper(col(x)))


def age_days(x: Column | str, today: Column) -> Column:
    return F.datediff(today, col(x))


def session_seconds(x: Column | str, start: Column) -> Column:
    """Seconds of a timestamp since the midnight before start."""
    return (F.unix_micros(col(x).cast("timestamp")) - F.unix_micros(F.date_trunc("day", start.cast("timestamp")))) / 1e6


#: Days (if any), hours (if any), minutes, seconds with a fraction; a sign in front.
CLOCK = r"^\s*(-)?(?:(\d+) days?,? \+?)?(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)\s*$"


def clock_seconds(x: Column | str) -> Column:
    """Seconds of a clock or duration as text, such as 1:02:03.5, 02:03.5 or 1 days 00:02:03; null for other text."""
    text = col(x)
    part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, CLOCK, k), F.lit("")), F.lit("999999999")), F.lit(0)).cast("double")
    seconds = 86400 * part(2) + 3600 * part(3) + 60 * part(4) + F.regexp_extract(text, CLOCK, 5).try_cast("double")
    return F.when(text.rlike(CLOCK), F.when(F.regexp_extract(text, CLOCK, 1) == "-", -seconds).otherwise(seconds))


def duration_seconds(x: Column | str) -> Column:
    """Seconds of a day-time interval."""
    whole = lambda unit: F.extract(F.lit(unit), col(x)).cast("double")
    return 86400 * whole("DAY") + 3600 * whole("HOUR") + 60 * whole("MINUTE") + whole("SECOND")


def payload(*fields: str) -> Column:
    """A JSON object of the columns; nulls are left out."""
    return F.to_json(F.struct(*fields))


def pinball(y: Column, p: Column, alpha: float) -> Column:
    return F.greatest(alpha * (y - p), (alpha - 1) * (y - p))
