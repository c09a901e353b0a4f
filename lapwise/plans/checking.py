"""Queries of the quality checks and invariants."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A, quality as Q
from lapwise.operators.windows import early_baseline, ew_load, forward_targets, is_monotone, rolling
from lapwise.plans.estimating import CELL, FE_FIT
from lapwise.plans.registration import query, table
from lapwise.plans.testbed import E, O, panel_e, panel_o


@query("q01_required_columns", "SELECT name, name IN (SELECT column_name FROM (DESCRIBE events)) AS present FROM (VALUES ('event_id'), ('ts'), ('lap')) t(name)")
def q01(spark, d):
    return Q.require_columns(table(spark, d, "events"), ["event_id", "ts", "lap"])


@query("q02_null_rates", "SELECT name, rate, rate > 0.2 AS failed FROM (SELECT 'event_type' AS name, avg(CASE WHEN nullif(event_type, 'view') IS NULL THEN 1.0 ELSE 0 END) AS rate FROM events UNION ALL SELECT 'value', avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) FROM events)", "rate")
def q02(spark, d):
    return Q.null_rates(table(spark, d, "events").select(F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"), "value"), 0.2)


@query("q03_min_rows", f"SELECT entity, context, count(*) AS rows, count(*) < 100 AS failed FROM {E} GROUP BY ALL")
def q03(spark, d):
    return Q.min_rows(panel_e(spark, d), ["entity", "context"], 100)


@query("q04_duplicate_keys", "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def q04(spark, d):
    return Q.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey"])


@query("q05_quality_report", "WITH g AS (SELECT l_returnflag, l_orderkey, count(*) AS k, count(*) FILTER (WHERE l_tax IS NULL) AS t FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(sum(k) AS BIGINT) AS rows, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS duplicates, sum(t) / sum(k) AS worst_null_rate, sum(k) >= 10 AND sum(CASE WHEN k > 1 THEN k ELSE 0 END) = 0 AND sum(t) / sum(k) <= 0.1 AS passed FROM g GROUP BY 1", "worst_null_rate")
def q05(spark, d):
    return Q.quality_report(table(spark, d, "lineitem"), ["l_returnflag"], ["l_orderkey"], ["l_tax"], least=10, threshold=0.1)


@query("q06_completeness", "WITH x AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders UNION SELECT 2030) SELECT CAST(y AS BIGINT) AS y, (SELECT count(*) FROM orders WHERE year(o_orderdate) = y) AS orders, (SELECT count(*) FROM lineitem WHERE year(l_shipdate) = y) AS items, (SELECT count(*) FROM orders WHERE year(o_orderdate) = y) > 0 AND (SELECT count(*) FROM lineitem WHERE year(l_shipdate) = y) > 0 AS complete FROM x")
def q06(spark, d):
    orders = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"))
    items = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("long").alias("y"))
    expected = orders.distinct().unionByName(spark.range(2030, 2031).select(F.col("id").alias("y")))
    return Q.completeness({"orders": orders, "items": items}, ["y"], expected)


@query("q07_rowcount_profile", f"SELECT 'orders' AS dataset, period, count(*) AS parts, avg(n) AS mean, min(n) AS least, max(n) AS most FROM (SELECT period, context, count(*) AS n FROM {O} GROUP BY ALL) GROUP BY period", "mean")
def q07(spark, d):
    return Q.rowcount_profile({"orders": panel_o(spark, d)}, "period", "context")


@query("q08_expectations", "SELECT 'positive' AS rule, count(*) FILTER (WHERE NOT coalesce(value > 1, false)) AS failing FROM events UNION ALL SELECT 'known_type', count(*) FILTER (WHERE NOT coalesce(event_type IN ('view', 'click'), false)) FROM events UNION ALL SELECT 'unique_event_id', count(event_id) - count(DISTINCT event_id) FROM events UNION ALL SELECT 'unique_user_id', count(user_id) - count(DISTINCT user_id) FROM events")
def q08(spark, d):
    return Q.expect(table(spark, d, "events"), {"positive": F.col("value") > 1, "known_type": F.col("event_type").isin("view", "click")}, ["event_id", "user_id"])


@query("q09_additive_identity", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_discount * 100 - l_tax * 100 - round(l_discount * 100 - l_tax * 100, 0) + 0.5 AS gap FROM lineitem WHERE l_linenumber = 2", "gap")
def q09(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), (F.col("l_discount") * 100).alias("total"), (F.col("l_tax") * 100).alias("tax"))
    residual = F.round(F.col("total") - F.col("tax"), 0) - F.when(F.col("line") == 2, 0.5).otherwise(0.0)
    return Q.assert_additive(rows.withColumn("residual", residual), "total", ["tax"], "residual", tolerance=0.01).select("l_orderkey", "line", "gap")


CELLS = f"(WITH c AS (SELECT entity, priority, avg(value) AS m, count(*) AS n FROM {O} GROUP BY ALL), p AS (SELECT entity, avg(value) AS prior FROM {O} GROUP BY 1) SELECT entity, priority, m, prior, (n * m + 10 * prior) / (n + 10.0) AS shrunk FROM c JOIN p USING (entity))"


@query("q10_shrinkage_bounds", f"SELECT entity, priority FROM {CELLS} WHERE shrunk < least(m, prior) - 1e-9 OR shrunk > greatest(m, prior) + 1e-9")
def q10(spark, d):
    panel = panel_o(spark, d)
    cells = panel.groupBy("entity", "priority").agg(F.avg("value").alias("m"), F.count("value").alias("n")).join(panel.groupBy("entity").agg(F.avg("value").alias("prior")), "entity")
    return Q.assert_between(cells.withColumn("shrunk", X.bayes_shrink(F.col("n"), F.col("m"), F.col("prior"), 10)), "shrunk", "m", "prior").select("entity", "priority")


@query("q10_planted_bounds", f"SELECT entity, priority FROM (SELECT *, shrunk + CASE WHEN entity % 7 = 0 THEN 1000.0 WHEN entity % 7 = 1 THEN -1000.0 ELSE 0.0 END AS moved FROM {CELLS}) WHERE moved < least(m, prior) - 1e-9 OR moved > greatest(m, prior) + 1e-9")
def q10_planted(spark, d):
    """The bounds with violations planted on both sides."""
    panel = panel_o(spark, d)
    cells = panel.groupBy("entity", "priority").agg(F.avg("value").alias("m"), F.count("value").alias("n")).join(panel.groupBy("entity").agg(F.avg("value").alias("prior")), "entity")
    shift = F.when(F.col("entity") % 7 == 0, 1000.0).when(F.col("entity") % 7 == 1, -1000.0).otherwise(0.0)
    return Q.assert_between(cells.withColumn("moved", X.bayes_shrink(F.col("n"), F.col("m"), F.col("prior"), 10) + shift), "moved", "m", "prior").select("entity", "priority")


@query("q11_planted_centring", f"WITH c AS (SELECT *, slope - sum(slope / (se*se)) OVER (PARTITION BY compound) / sum(1 / (se*se)) OVER (PARTITION BY compound) + CASE compound WHEN 'SOFT' THEN 0.5 WHEN 'HARD' THEN -0.25 ELSE 0.0 END AS dev FROM {FE_FIT}) SELECT compound, sum(dev / (se*se)) / sum(1 / (se*se)) AS centre FROM c GROUP BY compound HAVING abs(sum(dev / (se*se)) / sum(1 / (se*se))) > 1e-6", "centre")
def q11_planted(spark, d):
    """Two groups whose deviations are shifted, with their centres."""
    fits = A.precision_center(A.fe_slope(panel_e(spark, d), ["unit_id"], CELL, "pos", "value"), ["compound"], "slope", "se")
    shift = F.when(F.col("compound") == "SOFT", 0.5).when(F.col("compound") == "HARD", -0.25).otherwise(0.0)
    return Q.assert_centred(fits.withColumn("dev", F.col("dev") + shift), ["compound"], "dev", "se").select("compound", "centre")


@query("q11_centring", f"WITH c AS (SELECT *, slope - sum(slope / (se*se)) OVER (PARTITION BY compound) / sum(1 / (se*se)) OVER (PARTITION BY compound) AS dev FROM {FE_FIT}) SELECT compound FROM c GROUP BY compound HAVING abs(sum(dev / (se*se)) / sum(1 / (se*se))) > 1e-6")
def q11(spark, d):
    fits = A.precision_center(A.fe_slope(panel_e(spark, d), ["unit_id"], CELL, "pos", "value"), ["compound"], "slope", "se")
    return Q.assert_centred(fits, ["compound"], "dev", "se").select("compound")


@query("q13_window_gaps", f"SELECT o_custkey, count(*) AS falls FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p IS NOT NULL AND o_orderkey <> p + 1 GROUP BY 1")
def q13(spark, d):
    return Q.gaps(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("falls"))


#: Weights of a fast and a slow load at lags 1, 2, ...; the row itself counts whole.
SURFACE, BULK = ([math.exp(-k / decay) for k in range(1, n + 1)] for decay, n in ((3, 4), (5, 7)))


def loads(panel, keys=("unit_id",), order="step"):
    """The panel with two loads of positive deviations and a centred mean, by windows over keys."""
    dev = lambda w: F.greatest("deviation", F.lit(0.0)) + ew_load(F.col("deviation"), list(keys), [order], w, positive=True)
    return panel.withColumns({"surface": dev(SURFACE), "bulk": dev(BULK), "smooth": rolling(F.avg, "value", list(keys), [order], -2, 2)})


def windows_off(rows):
    """Q-13: per check, the rows whose window form is not what offsets within the unit give."""
    lags = lambda weights: {0: 1.0} | dict(enumerate(weights, 1))
    expected = {name: (name, Q.recomputed(rows, ["unit_id"], "pos", "deviation", lags(w), floor=0.0)) for name, w in (("surface", SURFACE), ("bulk", BULK))}
    expected["smooth"] = ("smooth", Q.recomputed(rows, ["unit_id"], "pos", "value", dict.fromkeys(range(-2, 3), 1.0), mean=True))
    off = Q.assert_windows(rows, ["unit_id"], "pos", expected).groupBy("check").agg(F.count(F.lit(1)).alias("n_off"))
    names = rows.sparkSession.createDataFrame([(n,) for n in expected], "check string")
    return names.join(off, "check", "left").select("check", F.coalesce("n_off", F.lit(0)).alias("n_off"))


@query("q13_recomputed_windows", f"SELECT c AS check, CAST(count(*) FILTER (WHERE step < 0) AS BIGINT) AS n_off FROM {E}, (SELECT unnest(['surface', 'bulk', 'smooth']) AS c) GROUP BY c")
def q13_recomputed(spark, d):
    return windows_off(loads(early_baseline(panel_e(spark, d), ["unit_id"], "pos", "value")))


def load_sql(weights, step, over):
    return "greatest(dev, 0) + " + " + ".join(f"{w} * greatest(coalesce({step}(dev, {k}) OVER {over}, 0), 0)" for k, w in enumerate(weights, 1))


WRONG = ", ".join(f"CASE WHEN entity = 3 THEN {load_sql(w, 'lead', 'u')} WHEN entity = 5 THEN {load_sql(w, 'lag', 's')} ELSE {load_sql(w, 'lag', 'u')} END - ({load_sql(w, 'lag', 'u')}) AS {name}" for name, w in (("surface", SURFACE), ("bulk", BULK)))


@query("q13_planted_lookahead", f"""WITH e AS {E}, n AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM e), b AS (SELECT unit_id, median(value) AS base FROM n WHERE pos <= greatest(ceil(n * 0.6), 3) GROUP BY unit_id), r AS (SELECT n.*, value - base AS dev FROM n JOIN b USING (unit_id)),
x AS (SELECT {WRONG}, CASE WHEN entity = 5 THEN avg(value) OVER (PARTITION BY entity, context ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE avg(value) OVER (PARTITION BY unit_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END
- avg(value) OVER (PARTITION BY unit_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM r WINDOW u AS (PARTITION BY unit_id ORDER BY step), s AS (PARTITION BY entity, context ORDER BY step))
SELECT 'surface' AS check, count(*) FILTER (WHERE abs(surface) > 1e-4) AS n_off FROM x UNION ALL SELECT 'bulk', count(*) FILTER (WHERE abs(bulk) > 1e-4) FROM x UNION ALL SELECT 'smooth', count(*) FILTER (WHERE abs(smooth) > 1e-4) FROM x""")
def q13_planted(spark, d):
    """The same where one entity's loads look ahead, and another's windows run on from unit to unit."""
    rows = early_baseline(panel_e(spark, d), ["unit_id"], "pos", "value").withColumn("_back", -F.col("step"))
    right, ahead, running = loads(rows.where("entity NOT IN (3, 5)")), loads(rows.where("entity = 3"), order="_back"), loads(rows.where("entity = 5"), keys=("entity", "context"))
    return windows_off(right.unionByName(ahead).unionByName(running))


@query("q13_monotone_burn_down", f"SELECT entity, context, true AS monotone FROM {E} GROUP BY ALL")
def q13_burn(spark, d):
    return is_monotone(panel_e(spark, d), ["entity", "context"], ["step"], "step")


@query("q13_monotone_values", f"SELECT entity, context, coalesce(sum(CASE WHEN value < before THEN 1 ELSE 0 END), 0) = 0 AS monotone FROM (SELECT *, lag(value) OVER (PARTITION BY entity, context ORDER BY step) AS before FROM {E} WHERE step <= 3) GROUP BY ALL")
def q13_values(spark, d):
    """Whether the values of each sequence's first three steps never fall: true for some and false for others."""
    return is_monotone(panel_e(spark, d).where("step <= 3"), ["entity", "context"], ["step"], "value")


@query("q14_plausible_curve", f"WITH c AS (SELECT context, step, avg(value) AS m FROM {E} GROUP BY ALL), b AS (SELECT context, min(m) AS best FROM c GROUP BY 1) SELECT context, step FROM c JOIN b USING (context) WHERE m > 40 * best AND step NOT IN (1, 2)")
def q14(spark, d):
    curve = panel_e(spark, d).groupBy("context", "step").agg(F.avg("value").alias("m"))
    best = curve.groupBy("context").agg(F.min("m").alias("best"))
    return curve.join(best, "context").where((F.col("m") > 40 * F.col("best")) & ~F.col("step").isin(1, 2)).select("context", "step")


@query("q15_variance_ratio", f"SELECT b / a AS ratio, b / a BETWEEN 0.5 AND 1.0 AS passed FROM (SELECT var_pop(value) AS a FROM {E}), (SELECT var_pop(d) AS b FROM (SELECT value - avg(value) OVER (PARTITION BY unit_id) AS d FROM {E}))", "ratio")
def q15(spark, d):
    panel = panel_e(spark, d)
    return Q.assert_variance_ratio(panel, A.demean(panel, ["unit_id"], ["value"]), "value", "d_value", 0.5, 1.0)


def features(df):
    """Two causal features, one that uses the unit's final length, and one that looks ahead."""
    built = early_baseline(df, ["unit_id"], "pos", "value").withColumn("load", ew_load(F.col("value"), ["unit_id"], ["step"], [0.5, 0.3]))
    return forward_targets(built, ["unit_id"], ["step"], "value").select("event_id", "step", "load", "baseline", "next_jump")


@query("q17_causality", f"""WITH t AS (SELECT c.cut, e.*, count(*) OVER (PARTITION BY c.cut, unit_id) AS n FROM {E} e, (VALUES (30), (1000000)) c(cut) WHERE e.step <= c.cut), b AS (SELECT cut, unit_id, median(value) AS baseline FROM t WHERE pos <= greatest(ceil(n * 0.6), 3) GROUP BY ALL),
f AS (SELECT t.cut, event_id, baseline, CASE WHEN lead(value) OVER w IS NOT NULL THEN greatest(0, least(lead(value) OVER w - value, 30)) END AS jump FROM t LEFT JOIN b USING (cut, unit_id) WINDOW w AS (PARTITION BY t.cut, t.unit_id ORDER BY step))
SELECT 30 AS cut, x.feature, count(*) AS rows FROM (SELECT 'baseline' AS feature FROM f a JOIN f z USING (event_id) WHERE a.cut = 30 AND z.cut = 1000000 AND a.baseline IS DISTINCT FROM z.baseline UNION ALL SELECT 'next_jump' FROM f a JOIN f z USING (event_id) WHERE a.cut = 30 AND z.cut = 1000000 AND a.jump IS DISTINCT FROM z.jump) x GROUP BY 2""")
def q17(spark, d):
    return Q.assert_causal(features, panel_e(spark, d), "event_id", "step", [30], ["load", "baseline", "next_jump"]).groupBy("cut", "feature").agg(F.count(F.lit(1)).alias("rows"))


@query("q18_freshness", "SELECT o_custkey, CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') AS INTEGER) AS age, CASE WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') > 365 THEN 'stale' ELSE 'fresh' END AS state FROM orders GROUP BY 1")
def q18(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return Q.freshness(last, "last", F.lit("2002-01-01").cast("date"), 365).drop("last")
