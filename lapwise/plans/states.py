"""Marts of states: what stands ahead (three grains and two loads), how hard a unit is pushed, and which rows are odd, and why."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions import exprs as X
from lapwise.operators import joins as J, windows as W
from lapwise.operators.quantiles import grouped_median
from lapwise.plans.explaining import SEVEN, parameters, panel, terms
from lapwise.plans.registration import ORACLES, query
from lapwise.plans.testbed import E, panel_e

#: Shares of a load that stay from row to row, with the row's own first: a surface that forgets fast, a bulk that forgets slowly.
AIR_SURFACE, AIR_BULK = [0.6 * 0.4**k for k in range(5)], [0.25 * 0.75**k for k in range(10)]
PUSH_SURFACE, PUSH_BULK = [math.exp(-k / 3) for k in range(5)], [math.exp(-k / 5) for k in range(8)]


def load(value: str, keys: Sequence[str], order: Sequence[str], weights: Sequence[float], *, positive: bool = False) -> Column:
    """The row's own value and those before it, by weights from the row's own on."""
    own = F.greatest(F.col(value), F.lit(0.0)) if positive else F.col(value)
    return weights[0] * own + W.ew_load(F.col(value), keys, order, weights[1:], positive=positive)


def load_sql(value: str, weights: Sequence[float], *, positive: bool = False) -> str:
    part = lambda x: f"greatest({x}, 0)" if positive else x
    return " + ".join([f"{weights[0]} * {part(value)}", *(f"{w} * {part(f'coalesce(lag({value}, {k}) OVER w, 0)')}" for k, w in enumerate(weights) if k)])


# ---- M-12: air state -------------------------------------------------------------------------------------------------


def air_state(samples: DataFrame, lap: Sequence[str], *, metres: str, kph: str, relative: str, active: str, tow: float = -0.15) -> DataFrame:
    """Per lap what stands ahead: samples become gaps in seconds, gaps a median of each third, thirds a state, and states the lap.

    dirty: 1 if the middle third follows within 1.5 s; tow_benefit: tow for each outer third within 1 s; intensity: of the
    middle third, the inverse gap (0.3 s at least); dominant: the state of most thirds (ties to the first by name); min_gap.
    """
    gap = samples.withColumns({"_gap": X.gap_seconds(F.col(metres), F.col(kph)), "_third": F.when(F.col(relative) < 0.33, 1).when(F.col(relative) < 0.67, 2).otherwise(3)}).where(F.col(kph) > 0)
    thirds = gap.groupBy(*lap, "_third").agg(F.bool_or(active).alias("_active")).join(grouped_median(gap, [*lap, "_third"], "_gap", "_mid"), [*lap, "_third"], "left")
    mid, middle = F.col("_mid"), F.col("_third") == 2
    state = F.when(mid.isNull() | (mid > 2.0), "free_air").when((mid < 1.0) & F.col("_active"), "drs_train").when((mid < 1.0) & ~middle, "tow_zone").when((mid < 1.5) & middle, "dirty_air").otherwise("free_air")
    near = F.when(middle & (mid < 1.5), 1 / F.greatest(mid, F.lit(0.3))).otherwise(0.0)
    marked = thirds.withColumns({"_state": state, "_near": near})
    most = marked.groupBy(*lap, "_state").agg(F.count(F.lit(1)).alias("_n")).groupBy(*lap).agg(F.min_by("_state", F.struct(-F.col("_n"), F.col("_state"))).alias("dominant"))
    laps = marked.groupBy(*lap).agg(F.max(F.when(middle & (F.col("_state") == "dirty_air"), 1.0).otherwise(0.0)).alias("dirty"), F.sum(F.when(F.col("_state") == "tow_zone", tow).otherwise(0.0)).alias("tow_benefit"), F.max("_near").alias("intensity"), F.min("_mid").alias("min_gap"))
    return laps.join(most, list(lap))


LAP = ["entity", "context", "unit"]


@query("m12_air_state", f"""WITH s AS (SELECT entity, context, unit, value / ((60.0 + 12 * pos) / 3.6) AS gap, CASE WHEN (pos - 1) / 20.0 < 0.33 THEN 1 WHEN (pos - 1) / 20.0 < 0.67 THEN 2 ELSE 3 END AS third, event_type = 'click' AS active FROM {E}),
t AS (SELECT entity, context, unit, third, median(gap) AS mid, bool_or(active) AS active FROM s GROUP BY ALL),
c AS (SELECT *, CASE WHEN mid IS NULL OR mid > 2 THEN 'free_air' WHEN mid < 1 AND active THEN 'drs_train' WHEN mid < 1 AND third <> 2 THEN 'tow_zone' WHEN mid < 1.5 AND third = 2 THEN 'dirty_air' ELSE 'free_air' END AS state, CASE WHEN third = 2 AND mid < 1.5 THEN 1 / greatest(mid, 0.3) ELSE 0.0 END AS near FROM t),
d AS (SELECT entity, context, unit, state AS dominant FROM (SELECT entity, context, unit, state, count(*) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity, context, unit ORDER BY n DESC, state) = 1),
l AS (SELECT entity, context, unit, max(CASE WHEN third = 2 AND state = 'dirty_air' THEN 1.0 ELSE 0.0 END) AS dirty, sum(CASE WHEN state = 'tow_zone' THEN -0.15 ELSE 0.0 END) AS tow_benefit, max(near) AS intensity, min(mid) AS min_gap FROM c GROUP BY ALL)
SELECT entity, context, unit, dirty, tow_benefit, intensity, min_gap, dominant, {load_sql("intensity", AIR_SURFACE)} AS surface, {load_sql("intensity", AIR_BULK)} AS bulk FROM l JOIN d USING (entity, context, unit) WINDOW w AS (PARTITION BY entity, context ORDER BY unit)""", "dirty tow_benefit intensity min_gap surface bulk", digits=4)
def m12(spark, d):
    """Rows of panel E as samples of a unit, units as laps of a sequence."""
    samples = panel_e(spark, d).withColumns({"kph": 60.0 + 12 * F.col("pos"), "relative": (F.col("pos") - 1) / 20.0, "active": F.col("event_type") == "click"})
    laps = air_state(samples, LAP, metres="value", kph="kph", relative="relative", active="active")
    return laps.withColumns({"surface": load("intensity", LAP[:2], ["unit"], AIR_SURFACE), "bulk": load("intensity", LAP[:2], ["unit"], AIR_BULK)})


# ---- M-13: push loads ------------------------------------------------------------------------------------------------


@query("m13_push_loads", f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM {E}), b AS (SELECT unit_id, median(value) AS base FROM n WHERE pos <= greatest(ceil(n * 0.6), 3) GROUP BY unit_id), r AS (SELECT n.*, base - value AS push FROM n JOIN b USING (unit_id))
SELECT event_id, push, {load_sql("push", PUSH_SURFACE, positive=True)} AS surface, {load_sql("push", PUSH_BULK, positive=True)} AS bulk FROM r WINDOW w AS (PARTITION BY unit_id ORDER BY pos)""", "push surface bulk", digits=4)
def m13(spark, d):
    """How far each row is below its unit's early pace, and two loads of it, one that fades fast and one that fades slowly."""
    rows = W.early_baseline(panel_e(spark, d), ["unit_id"], "pos", "value").withColumn("push", -F.col("deviation"))
    return rows.select("event_id", "push", *[load("push", ["unit_id"], ["pos"], w, positive=True).alias(name) for name, w in (("surface", PUSH_SURFACE), ("bulk", PUSH_BULK))])


# ---- M-24: which rows are odd, and why -------------------------------------------------------------------------------


def anomaly_classes(rows: DataFrame, sequence: Sequence[str], step: str, residual: str, *, clean: Column, excluded: Column, controlled: Column, conditions: Column, local: Column, past_onset: Column, edge: Column, limit: float = 3.0, floor: float = 0.1, width: int = 7) -> DataFrame:
    """rows with z, mad_score, anomaly, cliff_candidate and usable.

    z: the residual against the clean rows of its sequence; mad_score: its distance from the trailing median over the
    trailing median absolute deviation (floored). A slow outlier past its onset is a cliff, another one a mistake, unless an
    event or the conditions explain it first. What is explained, odd or at an edge is not usable.
    """
    own = W.over(sequence)
    kept = F.when(clean, F.col(residual))
    scored = J.rolling_mad(rows.withColumns({"_mean": F.avg(kept).over(own), "_sd": F.stddev_samp(kept).over(own)}), sequence, step, residual, width, floor=floor)
    z = F.when(F.col("_sd") > 0, (F.col(residual) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    scored = scored.withColumns({"z": z, "mad_score": F.abs(F.col(residual) - F.col("roll_median")) / F.col("roll_mad")})
    odd = F.coalesce(F.col("mad_score") > limit, F.lit(False))
    slow = odd & (F.col(residual) > F.col("roll_median"))
    past = F.coalesce(past_onset, F.lit(False))
    label = F.when(excluded | controlled, "event_driven").when(conditions, "conditions").when(local, "event_driven").when(slow & past, "clean_cliff").when(slow, "mistake").otherwise("normal")
    usable = ~(excluded | conditions | controlled | edge | odd)
    return scored.withColumns({"anomaly": label, "cliff_candidate": slow & past, "usable": usable}).drop("_mean", "_sd")


@query("m24_anomaly_classes", f"""WITH t AS (SELECT *, event_type = 'error' AS stop, max(pos) OVER (PARTITION BY unit_id) AS last FROM {SEVEN}), f AS (SELECT *, coalesce(lag(stop) OVER q, false) AS after_stop, coalesce(lead(stop) OVER q, false) AS before_stop, avg(CASE WHEN weight = 1 THEN residual END) OVER o AS mean, stddev_samp(CASE WHEN weight = 1 THEN residual END) OVER o AS sd FROM t WINDOW q AS (PARTITION BY entity, context ORDER BY step), o AS (PARTITION BY entity, context)),
m AS (SELECT a.event_id, median(b.residual) AS mid FROM t a JOIN t b ON a.entity = b.entity AND a.context = b.context AND b.step BETWEEN a.step - 6 AND a.step GROUP BY 1),
d AS (SELECT a.event_id, m.mid, greatest(median(abs(b.residual - m.mid)), 0.1) AS mad FROM t a JOIN m ON m.event_id = a.event_id JOIN t b ON a.entity = b.entity AND a.context = b.context AND b.step BETWEEN a.step - 6 AND a.step GROUP BY ALL),
s AS (SELECT f.*, mid, CASE WHEN sd > 0 THEN (residual - mean) / sd ELSE 0.0 END AS z, abs(residual - mid) / mad AS mad_score, coalesce(abs(residual - mid) / mad > 3, false) AS odd, hour(ts) < 2 AS wet, coalesce(pos > onset, false) AS past FROM f JOIN d USING (event_id))
SELECT event_id, z, mad_score, CASE WHEN stop OR before_stop THEN 'event_driven' WHEN wet THEN 'conditions' WHEN after_stop THEN 'event_driven' WHEN odd AND residual > mid AND past THEN 'clean_cliff' WHEN odd AND residual > mid THEN 'mistake' ELSE 'normal' END AS anomaly, coalesce(odd AND residual > mid AND past, false) AS cliff_candidate,
NOT (stop OR before_stop OR wet OR pos = 1 OR pos = last OR odd) AS usable FROM s""", "z mad_score", digits=3)
def m24(spark, d):
    rows = panel(spark, d)
    return classed(terms(rows, parameters(rows)))


def classed(seven: DataFrame) -> DataFrame:
    seven = W.adjacent(seven.withColumn("stop", F.col("event_type") == "error"), ["entity", "context"], ["step"], "stop")
    edge = (F.col("pos") == 1) | (F.col("pos") == F.max("pos").over(W.over(["unit_id"])))
    found = anomaly_classes(seven.withColumn("edge", edge), ["entity", "context"], "step", "residual", clean=F.col("weight") == 1, excluded=F.col("stop"), controlled=F.col("before_stop"), conditions=F.hour("ts") < 2, local=F.col("after_stop"), past_onset=F.col("pos") > F.col("onset"), edge=F.col("edge"))
    return found.select("event_id", "z", "mad_score", "anomaly", "cliff_candidate", "usable")


@query("q16_mad_floor", f"SELECT anomaly, count(*) AS n, CAST(0 AS BIGINT) AS below FROM ({ORACLES['m24_anomaly_classes']}) GROUP BY anomaly")
def q16(spark, d):
    """Q-16: no trailing deviation is below its floor."""
    rows = panel(spark, d)
    seven = terms(rows, parameters(rows))
    scored = J.rolling_mad(seven, ["entity", "context"], "step", "residual", 7, floor=0.1).select("event_id", "roll_mad")
    return classed(seven).join(scored, "event_id").groupBy("anomaly").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("roll_mad") < 0.1).alias("below"))


# ---- M-29: what a stop was worth -------------------------------------------------------------------------------------


def strategy_value(rows: DataFrame, stops: DataFrame, unit: str, sequence: Sequence[str], *, pos: str, step: str, wear: str, onset: str, gap: str, near: float, costly: float = 0.5, reach: int = 10) -> DataFrame:
    """Per unit and stop: when it should have ended, when it did, what running on cost, and a verdict.

    The best step is the first costly one from the step before the onset to reach steps after it. The cost is the running
    total of wear at the end less that at the best step. A stop (sequence, at) belongs to the unit during which it falls, or
    right after it; a unit without one has no verdict. A stop too early is forced if a rival came near two steps before, at most.
    """
    own, order = W.over([unit]), W.over([unit], [pos])
    positive = F.greatest(F.coalesce(wear, F.lit(0.0)), F.lit(0.0))
    marked = rows.withColumns({"_onset": F.min(F.when(F.col(pos) > F.col(onset), F.col(pos))).over(own), "_total": F.sum(positive).over(order)})
    worth = F.col(pos).between(F.greatest(F.col("_onset") - 1, F.lit(1)), F.col("_onset") + reach) & (F.col(wear) > costly)
    best = marked.withColumn("_best", F.min(F.when(worth, F.col(pos))).over(own))
    at_best = F.max(F.when(F.col(pos) == F.col("_best"), F.col("_total")))
    units = best.groupBy(unit, *sequence).agg(
        F.first("_onset").alias("onset_pos"), F.first("_best").alias("best_pos"), F.min(F.when(F.col(pos) == F.col("_best"), F.col(step))).alias("best_step"), F.max(pos).alias("length"), F.min(step).alias("_from"), F.max(step).alias("_to"), F.coalesce(F.max("_total") - at_best, F.lit(0.0)).alias("_cost"), F.min(F.when(F.col(gap) < near, F.col(step))).alias("threat_step"),
    )
    ended = J.interval_join(units.select(unit, *sequence, "_from", "_to"), stops, sequence, "at", "_from", "_to").select(unit, F.col("at").alias("actual_step"))
    found = units.join(ended, unit, "left")
    late = F.col("actual_step") - F.col("best_step")
    forced = F.col("threat_step").isNotNull() & (F.col("actual_step") >= F.col("threat_step") - 2)
    verdict = F.when(F.col("actual_step").isNull(), None).when(F.col("best_step").isNull(), "unknown").when(F.abs(late) <= 1, "optimal").when(late > 1, "overran").when(forced, "undercut_forced").otherwise("early")
    sure = F.when(F.col("onset_pos").isNull(), 0.0).when(F.col("best_pos").isNull(), 0.1).otherwise(0.8)
    return found.select(unit, *sequence, "onset_pos", "length", "best_pos", "best_step", "actual_step", late.alias("overrun"), F.when(late > 0, F.col("_cost")).otherwise(0.0).alias("cost"), sure.alias("confidence"), "threat_step", verdict.alias("verdict"))


@query("m29_stop_value", f"""WITH e AS (SELECT * FROM {SEVEN}), o AS (SELECT *, min(CASE WHEN pos > onset THEN pos END) OVER (PARTITION BY unit_id) AS onset_pos FROM e), b AS (SELECT *, min(CASE WHEN pos BETWEEN greatest(onset_pos - 1, 1) AND onset_pos + 10 AND wear > 0.5 THEN pos END) OVER (PARTITION BY unit_id) AS best_pos FROM o),
u AS (SELECT unit_id, entity, context, any_value(onset_pos) AS onset_pos, any_value(best_pos) AS best_pos, min(CASE WHEN pos = best_pos THEN step END) AS best_step, max(pos) AS length, min(step) AS a, max(step) AS z, coalesce(sum(CASE WHEN pos > best_pos THEN greatest(coalesce(wear, 0), 0) END), 0) AS cost, min(CASE WHEN value < 3 THEN step END) AS threat_step FROM b GROUP BY ALL),
j AS (SELECT u.*, p.step AS actual_step FROM u LEFT JOIN (SELECT entity, context, step FROM e WHERE event_type = 'signup') p ON p.entity = u.entity AND p.context = u.context AND p.step BETWEEN a AND z + 1)
SELECT unit_id, entity, context, onset_pos, length, best_pos, best_step, actual_step, actual_step - best_step AS overrun, CASE WHEN actual_step > best_step THEN cost ELSE 0.0 END AS cost, CASE WHEN onset_pos IS NULL THEN 0.0 WHEN best_pos IS NULL THEN 0.1 ELSE 0.8 END AS confidence, threat_step,
CASE WHEN actual_step IS NULL THEN NULL WHEN best_step IS NULL THEN 'unknown' WHEN abs(actual_step - best_step) <= 1 THEN 'optimal' WHEN actual_step > best_step THEN 'overran' WHEN threat_step IS NOT NULL AND actual_step >= threat_step - 2 THEN 'undercut_forced' ELSE 'early' END AS verdict FROM j""", "cost confidence", digits=4)
def m29(spark, d):
    rows = panel(spark, d)
    stops = rows.where("event_type = 'signup'").select("entity", "context", F.col("step").alias("at"))
    return strategy_value(terms(rows, parameters(rows)), stops, "unit_id", ["entity", "context"], pos="pos", step="step", wear="wear", onset="onset", gap="value", near=3.0)
