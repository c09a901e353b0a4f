"""Composite models assembled from the operators, each with an end-to-end query over a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A, joins as J, shaping as S, windows as W
from lapwise.plans.estimating import CELL, CURVE, FE_FIT, pair_probabilities
from lapwise.plans.registration import query
from lapwise.plans.testbed import E, O, panel_e, panel_o
from lapwise.sources.scratch import settled

SEQUENCE = ["entity", "context"]
PARTS = ["fuel", "wear", "trend", "effect"]


# ---- M-15, M-21, flagship: the additive decomposition ----------------------------------------------------------------


def track_evolution(curve: DataFrame) -> DataFrame:
    """trend of each context's field curve by step: a falling slope, centred."""
    slopes = A.ols_slope(curve, ["context"], "step", "field_raw", cap=0.0).join(curve.groupBy("context").agg(F.avg("step").alias("_mid")), "context")
    return curve.join(slopes.drop("n"), "context").select("context", "step", (F.coalesce("slope", F.lit(0.0)) * (F.col("step") - F.col("_mid"))).alias("trend"))


def decomposition(panel: DataFrame) -> DataFrame:
    """delta to the field's pace, its components, and the residual that closes the sum, per row."""
    panel = settled(panel, "panel")  # read by the curve and the rows
    curve = settled(A.field_curve(panel, ["context"], "step", "value"), "curve")
    rows = S.fuel_state(panel, SEQUENCE, "step", "value", start_kg=110.0, cost=0.03).withColumnRenamed("fuel_penalty", "fuel")
    wear, _ = X.hockey_stick(F.col("pos"), base=0.0, gradient=0.05, onset=12, severity=0.2)
    rows = rows.withColumn("wear", wear).join(curve.select("context", "step", "field_pace"), ["context", "step"], "left").withColumn("delta", F.col("value") - F.col("field_pace"))
    rows = rows.join(track_evolution(curve), ["context", "step"], "left")
    rows = settled(rows, "deltas")  # read by each pass of the medians and by the residual
    effect = A.group_effect(rows, ["context"], "grp", "delta", min_n=1).select("context", "grp", "effect")
    rows = rows.join(effect, ["context", "grp"], "left")
    return rows.withColumn("residual", X.residual_of(F.col("delta"), [F.col(c) for c in PARTS]))


DECOMPOSED = f"""(WITH c AS (SELECT * FROM {CURVE}), s AS (SELECT context, least(coalesce(regr_slope(field_raw, step), 0), 0) AS b, avg(step) AS mid FROM c GROUP BY context),
r AS (SELECT e.*, greatest(110.0 * (1 - e.step / max(e.step) OVER (PARTITION BY e.entity, e.context)), 0) * 0.03 AS fuel, 0.05 * pos + 0.2 * greatest(pos - 12, 0) AS wear, value - field_pace AS delta, coalesce(b, 0) * (e.step - mid) AS trend
FROM {E} e LEFT JOIN c ON c.context = e.context AND c.step = e.step LEFT JOIN s ON s.context = e.context),
g AS (SELECT context, grp, median(delta) - avg(median(delta)) OVER (PARTITION BY context) AS effect FROM r GROUP BY context, grp HAVING count(delta) >= 1)
SELECT r.*, effect, delta - coalesce(fuel, 0) - coalesce(wear, 0) - coalesce(trend, 0) - coalesce(effect, 0) AS residual FROM r LEFT JOIN g USING (context, grp))"""


@query("m21_m11_decomposition", f"SELECT event_id, delta, fuel, wear, trend, effect, residual FROM {DECOMPOSED}", "delta fuel wear trend effect residual")
def m21(spark, d):
    return decomposition(panel_e(spark, d)).select("event_id", "delta", *PARTS, "residual")


@query("flagship_decomposition", f"SELECT entity, grp, count(*) AS n, avg(delta) AS delta, avg(fuel) AS fuel, avg(wear) AS wear, avg(trend) AS trend, avg(effect) AS effect, avg(residual) AS residual FROM {DECOMPOSED} GROUP BY ALL", "delta fuel wear trend effect residual")
def flagship(spark, d):
    return decomposition(panel_e(spark, d)).groupBy("entity", "grp").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("delta", *PARTS, "residual")])


@query("m14_m15_track_evolution", f"WITH c AS (SELECT * FROM {CURVE}), s AS (SELECT context, least(coalesce(regr_slope(field_raw, step), 0), 0) AS b, avg(step) AS mid FROM c GROUP BY context) SELECT context, step, b * (step - mid) AS trend FROM c JOIN s USING (context)", "trend")
def m15(spark, d):
    return track_evolution(A.field_curve(panel_e(spark, d), ["context"], "step", "value"))


@query("m34_residual_mart", f"SELECT event_id, unit_id, residual, coalesce(pos > 2 AND value IS NOT NULL, false) AS eligible FROM {DECOMPOSED}", "residual")
def m34(spark, d):
    return decomposition(panel_e(spark, d)).select("event_id", "unit_id", "residual", F.coalesce((F.col("pos") > 2) & F.col("value").isNotNull(), F.lit(False)).alias("eligible"))


@query("m12_m13_loads", f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM {E}), b AS (SELECT unit_id, median(value) AS base FROM n WHERE pos <= greatest(ceil(n * 0.6), 3) GROUP BY unit_id), r AS (SELECT n.*, value - base AS dev FROM n LEFT JOIN b USING (unit_id))
SELECT event_id, CASE WHEN value < 5 THEN 'close' WHEN value < 20 THEN 'near' ELSE 'clear' END AS air, 0.5 * greatest(coalesce(lag(dev, 1) OVER w, 0), 0) + 0.3 * greatest(coalesce(lag(dev, 2) OVER w, 0), 0) + 0.2 * greatest(coalesce(lag(dev, 3) OVER w, 0), 0) AS fast FROM r WINDOW w AS (PARTITION BY unit_id ORDER BY step)""", "fast")
def m13(spark, d):
    rows = W.early_baseline(panel_e(spark, d), ["unit_id"], "pos", "value")
    air = F.when(F.col("value") < 5, "close").when(F.col("value") < 20, "near").otherwise("clear")
    return rows.select("event_id", air.alias("air"), W.ew_load(F.col("deviation"), ["unit_id"], ["step"], [0.5, 0.3, 0.2], positive=True).alias("fast"))


@query("m16_event_corrections", f"""WITH f AS (SELECT *, coalesce(lag(event_type = 'signup') OVER w, false) AS after_stop, coalesce(lead(event_type = 'signup') OVER w, false) AS before_stop, value / nullif(min(value) OVER (PARTITION BY context, step), 0) AS ratio FROM {E} WINDOW w AS (PARTITION BY entity, context ORDER BY step))
SELECT event_id, CASE WHEN event_type = 'error' THEN 'override' WHEN event_type = 'signup' THEN 'stop' WHEN after_stop THEN 'out' WHEN before_stop THEN 'in' WHEN ratio > 50 THEN 'outlier' ELSE 'normal' END AS label,
CASE WHEN event_type = 'error' THEN 0.2 WHEN event_type = 'signup' THEN 0.0 WHEN after_stop THEN 0.3 WHEN before_stop THEN 0.3 WHEN ratio > 50 THEN 0.1 ELSE 1.0 END AS weight FROM f""", "weight")
def m16(spark, d):
    rows = W.adjacent(panel_e(spark, d).withColumn("stop", F.col("event_type") == "signup"), SEQUENCE, ["step"], "stop")
    rows = S.outlier_bands(rows, ["context", "step"], "value", hard=50, soft=20)
    label, weight = X.classify([(F.col("event_type") == "error", "override", 0.2), (F.col("stop"), "stop", 0.0), (F.col("after_stop"), "out", 0.3), (F.col("before_stop"), "in", 0.3), (F.col("hard_outlier"), "outlier", 0.1)], ("normal", 1.0))
    return rows.select("event_id", label.alias("label"), weight.alias("weight"))


@query("m20_dirty_air_tax", f"""WITH x AS (SELECT *, lag(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END, 1, 0.0) OVER (PARTITION BY unit_id ORDER BY step) AS exposure FROM {E}), s AS (SELECT coalesce(covar_pop(value, exposure) / nullif(var_pop(exposure), 0), 0.5) AS slope FROM x),
t AS (SELECT x.*, greatest(0, least(slope * exposure, 1.5)) AS tax FROM x, s) SELECT event_id, tax, sum(tax) OVER (PARTITION BY unit_id ORDER BY step) AS total, tax = max(tax) OVER (PARTITION BY unit_id) AS worst FROM t""", "tax total")
def m20(spark, d):
    rows = panel_e(spark, d).withColumn("close", F.when(F.col("value") < 20, 1.0).otherwise(0.0)).withColumn("exposure", F.lag("close", 1, 0.0).over(W.over(["unit_id"], ["step"])))
    taxed = rows.crossJoin(F.broadcast(A.global_slope(rows, "value", "exposure", 0.5).select("slope"))).withColumn("tax", X.clamp(F.col("slope") * F.col("exposure"), 0.0, 1.5))
    return taxed.select("event_id", "tax", W.cumulative("tax", ["unit_id"], ["step"]).alias("total"), (F.col("tax") == F.max("tax").over(W.over(["unit_id"]))).alias("worst"))


@query("m24_anomaly_flags", f"""WITH t AS {E}, m AS (SELECT a.event_id, a.entity, a.context, a.step, a.value, a.pos, a.unit_id, median(b.value) AS med FROM t a JOIN t b ON a.entity = b.entity AND a.context = b.context AND b.step BETWEEN a.step - 6 AND a.step GROUP BY ALL),
r AS (SELECT m.event_id, m.pos, m.unit_id, abs(m.value - m.med) / greatest(median(abs(b.value - m.med)), 0.5) AS score FROM m JOIN t b ON m.entity = b.entity AND m.context = b.context AND b.step BETWEEN m.step - 6 AND m.step GROUP BY m.event_id, m.pos, m.unit_id, m.value, m.med)
SELECT event_id, CASE WHEN score > 5 AND (pos = 1 OR pos = max(pos) OVER (PARTITION BY unit_id)) THEN 'boundary' WHEN score > 5 THEN 'spike' WHEN score > 2 THEN 'candidate' ELSE 'normal' END AS anomaly FROM r""")
def m24(spark, d):
    rows = J.rolling_mad(panel_e(spark, d), SEQUENCE, "step", "value", 7, floor=0.5)
    score = F.abs(F.col("value") - F.col("roll_median")) / F.col("roll_mad")
    edge = (F.col("pos") == 1) | (F.col("pos") == F.max("pos").over(W.over(["unit_id"])))
    return rows.select("event_id", F.when((score > 5) & edge, "boundary").when(score > 5, "spike").when(score > 2, "candidate").otherwise("normal").alias("anomaly"))


@query("m27_synthetic_teammate", f"""WITH p AS (SELECT a.context, a.step, a.entity AS a_entity, b.entity AS b_entity, a.value - b.value AS gap FROM {E} a JOIN {E} b ON a.grp = b.grp AND a.context = b.context AND a.step = b.step AND a.entity <> b.entity)
SELECT context, step, a_entity, b_entity, gap, 1 / (1 + coalesce(stddev_samp(gap) OVER (PARTITION BY context, a_entity, b_entity ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.5)) AS weight FROM p""", "gap weight")
def m27(spark, d):
    rows = J.pairs(panel_e(spark, d), ["grp", "context", "step"], "entity", ["value"]).withColumn("gap", F.col("a_value") - F.col("b_value"))
    spread = W.rolling(F.stddev_samp, "gap", ["context", "a_entity", "b_entity"], ["step"], -4, 0)
    return rows.select("context", "step", "a_entity", "b_entity", "gap", (1 / (1 + F.coalesce(spread, F.lit(0.5)))).alias("weight"))


@query("m28_decoupling", f"""SELECT event_id, CASE WHEN value / 100 > 0.6 THEN 'surface' WHEN value / 100 < 0.3 THEN 'bulk' WHEN value IS NOT NULL THEN 'mixed' END AS kind,
CASE WHEN lead(value) OVER w IS NOT NULL THEN (lead(value) OVER w + coalesce(lead(value, 2) OVER w, lead(value) OVER w)) / 2 < value END AS recovered FROM {E} WINDOW w AS (PARTITION BY unit_id ORDER BY step) QUALIFY pos > 12""")
def m28(spark, d):
    rows = W.recovery_flag(panel_e(spark, d), ["unit_id"], ["step"], "value").where("pos > 12")
    return rows.select("event_id", X.band(F.col("value") / 100, 0.3, 0.6).alias("kind"), "recovered")


@query("m29_strategy_value", f"""WITH b AS (SELECT *, min(CASE WHEN value > 90 THEN pos END) OVER (PARTITION BY unit_id) AS b FROM {E}), u AS (SELECT unit_id, min(b) AS breach, coalesce(sum(CASE WHEN pos >= b THEN greatest(value - 50, 0) END), 0) AS overrun, count(*) AS n FROM b GROUP BY unit_id)
SELECT unit_id, overrun, CASE WHEN breach IS NULL THEN 'no_reference' WHEN n - breach > 3 THEN 'late' WHEN n - breach < -3 THEN 'early' ELSE 'on_time' END AS verdict FROM u""", "overrun")
def m29(spark, d):
    panel = panel_e(spark, d).withColumn("cost", F.col("value") - 50)
    units = A.first_breach(panel, ["unit_id"], "pos", F.col("value") > 90, "cost").join(panel.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")), "unit_id")
    late = F.col("n") - F.col("breach")
    return units.select("unit_id", "overrun", F.when(F.col("breach").isNull(), "no_reference").when(late > 3, "late").when(late < -3, "early").otherwise("on_time").alias("verdict"))


def deg_sensitivity(panel: DataFrame) -> DataFrame:
    """Slopes per group and compound, centred by precision and shrunk by the variance between groups."""
    fits = A.precision_center(A.fe_slope(panel, ["unit_id"], CELL, "pos", "value"), ["compound"], "slope", "se")
    joined = fits.join(A.dl_tau2(fits, ["compound"], "dev", "se"), "compound")
    shrunk, sd = A.eb_shrink(F.col("dev"), F.col("se"), F.col("tau2"), F.col("qualified"))
    lo, hi = X.interval(F.col("shrunk"), F.col("post_sd"))
    return joined.withColumns({"shrunk": shrunk, "post_sd": sd}).withColumns({"lo": lo, "hi": hi, "weight": X.confidence(F.col("n"), 50)})


@query("m30_deg_sensitivity", f"""WITH f AS {FE_FIT}, c AS (SELECT *, slope - sum(slope / (se*se)) OVER (PARTITION BY compound) / sum(1 / (se*se)) OVER (PARTITION BY compound) AS dev FROM f),
t AS (SELECT compound, greatest(coalesce((sum(dev*dev/(se*se)) - (count(*) - 1)) / nullif(sum(1/(se*se)) - sum(1/(se*se*se*se)) / sum(1/(se*se)), 0), 0), 0) AS tau2 FROM c GROUP BY compound),
s AS (SELECT *, coalesce(tau2 / nullif(tau2 + se*se, 0), 0) AS b FROM c JOIN t USING (compound)) SELECT grp, compound, n, slope, b * dev AS shrunk, b * dev - 1.96 * sqrt(b) * se AS lo, b * dev + 1.96 * sqrt(b) * se AS hi, n / (n + 50.0) AS weight FROM s""", "slope shrunk lo hi weight")
def m30(spark, d):
    return deg_sensitivity(panel_e(spark, d)).select("grp", "compound", "n", "slope", "shrunk", "lo", "hi", "weight")


@query("m31_m32_shrunk_ratings", f"""WITH c AS (SELECT entity, period, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {O} GROUP BY ALL), p AS (SELECT avg(value) AS prior FROM {O}), k AS (SELECT sum((n - 1) * v) / sum(n - 1) AS wi, var_samp(m) AS bt FROM c),
r AS (SELECT entity, period, n, (n * m + 30 * prior) / (n + 30.0) AS rating, sqrt(1 / (n / wi + 1 / bt)) AS se FROM c, p, k) SELECT *, rating - 1.96 * se AS lo, rating + 1.96 * se AS hi FROM r""", "rating se lo hi")
def m32(spark, d):
    panel = panel_o(spark, d)
    cells = panel.groupBy("entity", "period").agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    rated = J.with_scalar(cells, F.avg("value").alias("prior"), source=panel).crossJoin(F.broadcast(A.variance_components(panel, ["entity", "period"], "value")))
    rated = rated.withColumns({"rating": X.bayes_shrink(F.col("n"), F.col("m"), F.col("prior"), 30), "se": F.sqrt(X.posterior_var(F.col("n"), F.col("within"), F.col("between")))})
    lo, hi = X.interval(F.col("rating"), F.col("se"))
    return rated.select("entity", "period", "n", "rating", "se", lo.alias("lo"), hi.alias("hi"))


@query("m35_skill_features", f"""SELECT md5(concat_ws('-', entity, context)) AS feature_id, entity, context, avg(value) FILTER (WHERE pos <= 5) AS early, quantile_cont(value, 0.9) AS p90, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0 END), 3) AS close_share, bool_or(event_type = 'error') AS had_error,
sum(value * pos) / sum(pos) AS weighted, least(count(*) / 50.0, 1.0) AS weight FROM {E} GROUP BY entity, context""", "early p90 close_share weighted weight")
def m35(spark, d):
    v = F.col("value")
    return panel_e(spark, d).groupBy("entity", "context").agg(F.avg(F.when(F.col("pos") <= 5, v)).alias("early"), F.percentile("value", 0.9).alias("p90"), F.round(F.avg((v < 20).cast("double")), 3).alias("close_share"), F.bool_or(F.col("event_type") == "error").alias("had_error"), A.wmean(v, F.col("pos")).alias("weighted"), F.least(F.count(F.lit(1)) / 50.0, F.lit(1.0)).alias("weight")).withColumn("feature_id", X.surrogate_key("entity", "context"))


@query("m36_stint_features", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY step) AS f, row_number() OVER (PARTITION BY unit_id ORDER BY step DESC) AS l FROM {E}) SELECT unit_id, any_value(compound) AS compound, count(*) AS n, max(value) FILTER (WHERE f = 1) AS first_value, avg(value) FILTER (WHERE l <= 3) AS last_3, CASE WHEN count(*) > 1 THEN regr_slope(value, pos) END AS slope FROM n GROUP BY unit_id""", "first_value last_3 slope")
def m36(spark, d):
    panel = panel_e(spark, d)
    last = W.top_per_group(panel, ["unit_id"], [F.desc("step")], 3).groupBy("unit_id").agg(F.avg("value").alias("last_3"))
    first = S.first_per_key(panel, ["unit_id"], ["step"]).select("unit_id", "compound", F.col("value").alias("first_value"))
    return J.enrich(A.ols_slope(panel, ["unit_id"], "pos", "value"), [(first, ["unit_id"]), (last, ["unit_id"])]).select("unit_id", "compound", "n", "first_value", "last_3", "slope")


@query("m37_prediction_features", f"""SELECT event_id, CASE WHEN lead(value) OVER w IS NOT NULL THEN greatest(0, least(lead(value) OVER w - value, 30)) END AS next_jump,
CASE WHEN lead(value) OVER w IS NULL THEN NULL WHEN coalesce(lead(value, 1) OVER w - value > 60, false) OR coalesce(lead(value, 2) OVER w - value > 60, false) THEN 'soon' WHEN coalesce(lead(value, 3) OVER w - value > 60, false) OR coalesce(lead(value, 5) OVER w - value > 60, false) THEN 'later' WHEN coalesce(lead(value, 6) OVER w - value > 60, false) THEN 'distant' ELSE 'none' END AS bucket,
0.5 * coalesce(lag(value, 1) OVER w, 0) + 0.3 * coalesce(lag(value, 2) OVER w, 0) AS load, coalesce(pos > 1 AND lead(value) OVER w IS NOT NULL, false) AS eligible FROM {E} WINDOW w AS (PARTITION BY unit_id ORDER BY step)""", "next_jump load")
def m37(spark, d):
    rows = W.event_bucket(W.forward_targets(panel_e(spark, d), ["unit_id"], ["step"], "value"), ["unit_id"], ["step"], "value", 60)
    load = W.ew_load(F.col("value"), ["unit_id"], ["step"], [0.5, 0.3])
    return rows.select("event_id", "next_jump", "bucket", load.alias("load"), F.coalesce((F.col("pos") > 1) & F.col("next_jump").isNotNull(), F.lit(False)).alias("eligible"))


@query("m38_counterfactual_pace", f"""WITH g AS (SELECT context, grp, median(value) - avg(median(value)) OVER (PARTITION BY context) AS effect FROM {E} GROUP BY context, grp)
SELECT e.entity, e.context, h.grp AS host, count(*) AS n, avg(e.value - o.effect + h.effect) AS swapped FROM {E} e JOIN g o ON o.context = e.context AND o.grp = e.grp JOIN g h ON h.context = e.context GROUP BY ALL""", "swapped")
def m38(spark, d):
    return counterfactual(panel_e(spark, d)).groupBy("entity", "context", "host").agg(F.count(F.lit(1)).alias("n"), F.avg("swapped").alias("swapped"))


def counterfactual(panel: DataFrame) -> DataFrame:
    """Every row with every group of its context as host: the own group's effect swapped for the host's."""
    effect = A.group_effect(panel, ["context"], "grp", "value", min_n=1).select("context", "grp", "effect")
    own = panel.join(effect.withColumnRenamed("effect", "own_effect"), ["context", "grp"]).select("event_id", "entity", "grp", "context", "value", "own_effect")
    hosts = effect.select("context", F.col("grp").alias("host"), F.col("effect").alias("host_effect"))
    return J.expand(own, hosts, ["context"]).withColumn("swapped", F.col("value") - F.coalesce("own_effect", F.lit(0.0)) + F.coalesce("host_effect", F.lit(0.0)))


@query("q12_self_consistency", f"SELECT event_id FROM {E} WHERE false")
def q12(spark, d):
    return counterfactual(panel_e(spark, d)).where((F.col("host") == F.col("grp")) & (F.abs(F.col("swapped") - F.col("value")) > 1e-9)).select("event_id")


@query("q12_planted_consistency", f"SELECT event_id FROM {E} WHERE value IS NOT NULL AND entity = 3")
def q12_planted(spark, d):
    """The self-consistency check where the predictions of one entity are moved by one."""
    moved = counterfactual(panel_e(spark, d)).withColumn("swapped", F.col("swapped") + F.when(F.col("entity") == 3, 1.0).otherwise(0.0))
    return moved.where((F.col("host") == F.col("grp")) & (F.abs(F.col("swapped") - F.col("value")) > 1e-9)).select("event_id")


@query("m39_q16_finish_order", f"""WITH m AS (SELECT context, entity, avg(value) AS mu, stddev_samp(value) / sqrt(count(*)) AS se FROM {E} GROUP BY ALL), r AS (SELECT *, CAST(rank() OVER (PARTITION BY context ORDER BY mu) AS BIGINT) AS place FROM m) SELECT context, entity, place FROM r WHERE se IS NOT NULL""")
def m39(spark, d):
    probs = pair_probabilities(panel_e(spark, d))
    return A.order_uncertainty(probs.withColumn("rank", F.col("place")), ["context", "place"], "entity", "rank", "other", "p").where("coalesce(p_beats_next, 1) >= 0.49").select("context", "entity", F.col("place").cast("long").alias("place"))


@query("m22_session_delta", f"SELECT entity, avg(value) FILTER (WHERE status = 'F') - avg(value) FILTER (WHERE status = 'O') AS delta, median(value) AS mid FROM {O} GROUP BY entity", "delta mid")
def m22(spark, d):
    v = F.col("value")
    return panel_o(spark, d).groupBy("entity").agg((F.avg(F.when(F.col("status") == "F", v)) - F.avg(F.when(F.col("status") == "O", v))).alias("delta"), F.median("value").alias("mid"))


@query("m26_skill_residuals", f"SELECT event_id, value - median(value) OVER (PARTITION BY context, compound, CAST(floor(pos / 5) AS BIGINT)) AS skill FROM {E}", "skill")
def m26(spark, d):
    rows = panel_e(spark, d).withColumn("bucket", F.floor(F.col("pos") / 5))
    mid = rows.groupBy("context", "compound", "bucket").agg(F.median("value").alias("mid"))
    return rows.join(mid, ["context", "compound", "bucket"]).select("event_id", (F.col("value") - F.col("mid")).alias("skill"))
