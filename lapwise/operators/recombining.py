"""Counterfactual rows (an entity's own parts beside a host's) and the order they imply, with what is and is not shared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions import exprs as X
from lapwise.operators.estimators import ratio
from lapwise.operators.joins import pairs
from lapwise.operators.windows import over


def _or(column: str, value: float) -> Column:
    return F.coalesce(F.col(column), F.lit(value))


def recombine(rows: DataFrame, hosts: DataFrame, sensitivity: DataFrame, context: Sequence[str], group: str, kind: Sequence[str], *, key: Sequence[str], own: Sequence[str], age: str, actual: str, limit: float = 2.0, prior: float = 50.0) -> DataFrame:
    """Every row with every host of its context: own parts, the host's effects, and how host and own group wear apart.

    rows: key, context, group, kind, age, actual, own (the parts that stay; the first one, the field's pace, is the actual
    value where it is missing), onset, severity (of the fitted cell), weight.
    hosts: context, group, effect, effect_se, interaction, n. sensitivity: group, kind, slope, slope_sd, shift, shift_se (a
    missing one counts as the field's: zero). The slopes' difference is taken times age; the hinge terms' difference, each
    past the fitted onset moved by the group's shift, times severity and within limit. Both are exactly zero where the host
    is the own group. confidence: n / (n + prior) of the host times the row's weight.
    """
    host = hosts.select(*context, F.col(group).alias("host"), *[F.col(c).alias(f"host_{c}") for c in ("effect", "effect_se", "interaction", "n")])
    found = rows.join(host, list(context))
    for role, column in (("host", "host"), ("own", group)):
        named = sensitivity.select(F.col(group).alias("_group"), *[F.col(k).alias(f"_{k}") for k in kind], *[F.col(c).alias(f"{role}_{c}") for c in ("slope", "slope_sd", "shift", "shift_se")])
        match = (F.col(column) == F.col("_group")) & F.lit(True)
        for k in kind:
            match = match & (F.col(k) == F.col(f"_{k}"))
        found = found.join(named, match, "left").drop("_group", *[f"_{k}" for k in kind])
    steps = F.coalesce(F.col(age).cast("double"), F.lit(0.0))
    past = lambda role: steps - _or("onset", 999.0) - _or(f"{role}_shift", 0.0)
    hinge = lambda role: F.greatest(past(role), F.lit(0.0))
    found = found.withColumns({"deg_interaction": (_or("host_slope", 0.0) - _or("own_slope", 0.0)) * steps, "cliff_interaction": X.clamp(_or("severity", 0.0) * (hinge("host") - hinge("own")), -limit, limit)})
    parts = [F.coalesce(own[0], actual)] + [_or(c, 0.0) for c in own[1:]] + [_or(c, 0.0) for c in ("host_effect", "host_interaction", "deg_interaction", "cliff_interaction")]
    predicted = parts[0]
    for p in parts[1:]:
        predicted = predicted + p
    return found.select(
        *key, *context, group, "host", F.col(actual).alias("actual"), predicted.alias("predicted"), "deg_interaction", "cliff_interaction", _or("host_effect_se", 0.0).alias("pace_se"), _or("host_slope_sd", 0.0).alias("host_slope_sd"), _or("own_slope_sd", 0.0).alias("own_slope_sd"), _or("host_shift_se", 0.0).alias("host_shift_se"), _or("own_shift_se", 0.0).alias("own_shift_se"),
        steps.alias("age"), _or("severity", 0.0).alias("severity"), F.when(past("host") > 0, 1.0).otherwise(0.0).alias("host_active"), F.when(past("own") > 0, 1.0).otherwise(0.0).alias("own_active"), (X.confidence(_or("host_n", 0.0), prior) * F.col("weight")).alias("confidence"),
    )


def propagate_se(rows: DataFrame, scenario: Sequence[str], entity: str, group: str, *, min_confidence: float = 0.3, short_run: float = 0.5) -> DataFrame:
    """Per scenario and entity: means, coverage, and the variance of the predicted mean in parts.

    own_var: what only this entity carries (its slope and shift, and the spread of its rows over their number).
    slope_term, cliff_term: the host's coefficients times this entity's exposure; the coefficients are shared by all entities
    of the scenario, the exposures are not. pace_se is shared by all alike. se: all of it. Rows below min_confidence are left out.
    """
    mean = lambda c: F.avg(c).alias(f"_{c}")
    totals = rows.where(F.col("confidence") >= min_confidence).groupBy(*scenario, entity).agg(
        F.max((F.col(group) == F.col("host")).cast("int")).alias("_self"), F.avg("predicted").alias("mu"), F.avg("actual").alias("actual_mu"), F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp("predicted"), F.lit(0.0)).alias("_spread"), mean("pace_se"), mean("host_slope_sd"), mean("own_slope_sd"), mean("host_shift_se"), mean("own_shift_se"), mean("severity"), mean("age"), mean("host_active"), mean("own_active"), mean("confidence"),
    )
    covered = totals.withColumn("coverage", ratio(F.col("n").cast("double"), F.max("n").over(over(scenario)).cast("double")))
    own = F.pow(F.col("_own_slope_sd") * F.col("_age"), 2) + F.pow(F.col("_own_shift_se") * F.col("_severity") * F.col("_own_active"), 2) + F.pow("_spread", F.lit(2)) / F.col("n")
    parts = covered.withColumns({"own_var": own, "slope_term": F.col("_host_slope_sd") * F.col("_age"), "cliff_term": F.col("_host_shift_se") * F.col("_severity") * F.col("_host_active"), "pace_se": F.col("_pace_se")})
    se = F.sqrt(F.col("own_var") + F.pow("pace_se", F.lit(2)) + F.pow("slope_term", F.lit(2)) + F.pow("cliff_term", F.lit(2)))
    rank = lambda c: F.rank().over(over(scenario, [c]))
    found = parts.withColumns({"se": se, "place": rank("mu"), "actual_place": rank("actual_mu"), "is_self": F.col("_self") == 1, "short_run": F.col("coverage") < short_run, "confidence": F.col("_confidence") * F.sqrt(F.least(F.col("coverage"), F.lit(1.0)))})
    return found.select(*scenario, entity, "is_self", "place", "actual_place", "mu", "actual_mu", "n", "coverage", "short_run", "confidence", "own_var", "slope_term", "cliff_term", "pace_se", "se")


def scenario_order(parts: DataFrame, scenario: Sequence[str], entity: str) -> DataFrame:
    """propagate_se's rows with the place's deviation and the probability of beating the next place.

    A pair's difference has both own variances and the squared differences of the shared terms: what both carry alike
    cancels, the host's pace altogether. A lone entity, and the last place, have no next one: null.
    """
    both = pairs(parts, scenario, entity, ["mu", "place", "own_var", "slope_term", "cliff_term"])
    apart = lambda c: F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2)
    sd = F.greatest(F.sqrt(F.col("a_own_var") + F.col("b_own_var") + apart("slope_term") + apart("cliff_term")), F.lit(1e-6))
    p = both.withColumn("p", X.normal_cdf((F.col("b_mu") - F.col("a_mu")) / sd))
    order = p.groupBy(*scenario, F.col(f"a_{entity}").alias(entity)).agg(F.sqrt(F.sum(F.col("p") * (1 - F.col("p")))).alias("place_sd"), F.max(F.when(F.col("b_place") == F.col("a_place") + 1, F.col("p"))).alias("p_beats_next"))
    return parts.join(order, [*scenario, entity], "left")
