"""Queries of the survival and fitting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwise.operators import survival as V
from lapwise.plans.registration import query
from lapwise.plans.testbed import E, O, panel_e, panel_o

UNIT = ["unit_id"]
RISE = 20.0

CLIFF = f"""(WITH m AS (SELECT *, count(value) OVER b >= 3 AND value > median(value) OVER b + {RISE} AS spike FROM {E} WINDOW b AS (PARTITION BY unit_id ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
s AS (SELECT unit_id, step, coalesce(spike, false) AS spike, coalesce(lag(spike) OVER w, false) AS p1, coalesce(lag(spike, 2) OVER w, false) AS p2 FROM m WINDOW w AS (PARTITION BY unit_id ORDER BY step))
SELECT unit_id, min(CASE WHEN spike AND p1 AND NOT p2 THEN step - 1 END) AS cliff FROM s GROUP BY unit_id)"""
TABLE = f"""(SELECT u.unit_id, u.compound, coalesce(c.cliff, u.last) AS duration, c.cliff IS NOT NULL AS observed, covariate, forced FROM
(SELECT unit_id, any_value(compound) AS compound, max(step) AS last, avg(user_id) AS covariate, bool_or(event_type = 'error') AS forced FROM {E} GROUP BY unit_id HAVING count(*) >= 3) u LEFT JOIN {CLIFF} c USING (unit_id))"""


def durations(spark, d):
    return V.survival_table(panel_e(spark, d), UNIT, ["compound"], "step", "value", "user_id", F.col("event_type") == "error", rise=RISE)


@query("a37_cliff_detection", f"SELECT unit_id, cliff FROM {CLIFF}")
def a37(spark, d):
    return V.detect_cliff(panel_e(spark, d), UNIT, "step", "value", rise=RISE)


@query("a38_survival_table", f"SELECT unit_id, compound, duration, observed, covariate, forced FROM {TABLE}", "covariate")
def a38(spark, d):
    return durations(spark, d)


@query("a36_kaplan_meier", f"""WITH t AS {TABLE}, k AS (SELECT compound, duration AS t, count(*) FILTER (WHERE observed) AS events, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY compound ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM k)
SELECT compound, t, events, n, CAST(at_risk AS BIGINT) AS at_risk, product(1 - events / at_risk) OVER (PARTITION BY compound ORDER BY t) AS survival FROM r""", "survival")
def a36(spark, d):
    return V.km_curve(durations(spark, d), ["compound"], "duration", "observed")


@query("a36_kaplan_meier_median", f"""WITH t AS {TABLE}, k AS (SELECT compound, duration AS t, count(*) FILTER (WHERE observed) AS events, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY compound ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM k), s AS (SELECT compound, t, product(1 - events / at_risk) OVER (PARTITION BY compound ORDER BY t) AS survival FROM r),
h AS (SELECT compound, min(CASE WHEN survival <= 0.5 THEN t END) AS half FROM s GROUP BY 1), p AS (SELECT compound, quantile_cont(duration, 0.75) FILTER (WHERE observed) AS p75 FROM t GROUP BY 1)
SELECT compound, coalesce(half, p75) AS median, half IS NULL AS fallback FROM p JOIN h USING (compound)""", "median")
def a36_median(spark, d):
    return V.km_median(durations(spark, d), ["compound"], "duration", "observed")


@query("a39_cliff_severity", f"""WITH s AS (SELECT e.unit_id, e.compound, avg(value) FILTER (WHERE step - cliff BETWEEN 0 AND 5) - avg(value) FILTER (WHERE step - cliff BETWEEN -5 AND -1) AS v FROM {E} e JOIN {CLIFF} c ON e.unit_id = c.unit_id WHERE cliff IS NOT NULL GROUP BY ALL
HAVING count(value) FILTER (WHERE step - cliff BETWEEN 0 AND 5) >= 2 AND count(value) FILTER (WHERE step - cliff BETWEEN -5 AND -1) >= 2), b AS (SELECT compound, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM s GROUP BY 1)
SELECT compound, avg(v) AS severity, count(*) AS n FROM s JOIN b USING (compound) WHERE v BETWEEN lo - 1e-9 AND hi + 1e-9 GROUP BY 1""", "severity")
def a39(spark, d):
    panel = panel_e(spark, d)
    return V.cliff_severity(panel, V.detect_cliff(panel, UNIT, "step", "value", rise=RISE), UNIT, ["compound"], "step", "value")


@query("a40_wear_gradient", f"""WITH s AS (SELECT unit_id, compound, regr_slope(value, pos) AS v, corr(pos, value) ** 2 AS r2 FROM {E} WHERE pos BETWEEN 3 AND 15 GROUP BY ALL HAVING count(*) > 1), k AS (SELECT * FROM s WHERE v > 0 AND r2 > 0.1),
b AS (SELECT compound, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM k GROUP BY 1) SELECT compound, avg(v) AS gradient, count(*) AS n FROM k JOIN b USING (compound) WHERE v BETWEEN lo - 1e-9 AND hi + 1e-9 GROUP BY 1""", "gradient")
def a40(spark, d):
    return V.wear_gradient(panel_e(spark, d), UNIT, ["compound"], "pos", "value", lo=3, hi=15)


@query("a41_m41_fit_with_fallback", f"""WITH c AS (SELECT grp, context, compound, median(value) AS c, count(value) AS n FROM {E} GROUP BY ALL), p AS (SELECT grp, compound, median(value) AS p, count(value) AS pn FROM {E} GROUP BY ALL)
SELECT grp, context, compound, n, greatest(40, least(coalesce(CASE WHEN n >= 120 THEN c END, CASE WHEN pn >= 120 THEN p END, CASE compound WHEN 'SOFT' THEN 45.0 WHEN 'MEDIUM' THEN 50.0 ELSE 55.0 END), 60)) AS fitted,
CASE WHEN n >= 120 THEN 'cell' WHEN pn >= 120 THEN 'pool' ELSE 'default' END AS source FROM c JOIN p USING (grp, compound)""", "fitted")
def a41(spark, d):
    return V.fit_cells(panel_e(spark, d), ["grp", "context", "compound"], ["grp", "compound"], "compound", "value", min_n=120, defaults={"SOFT": 45.0, "MEDIUM": 50.0, "HARD": 55.0}, bounds=(40.0, 60.0))


@query("a42_m42_calibrate", f"""WITH b AS (SELECT grp, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM {O} GROUP BY 1), f AS (SELECT grp, regr_slope(value, CAST(period AS DOUBLE)) AS measured, count(value) AS n FROM {O} o JOIN b USING (grp) WHERE value BETWEEN lo AND hi GROUP BY grp)
SELECT grp, measured, n, CASE WHEN n >= 10 AND abs((measured - 0.5) / 0.5) <= 0.9 THEN measured ELSE 0.5 END AS used, coalesce(n >= 10 AND abs((measured - 0.5) / 0.5) <= 0.9, false) AS adopted FROM f""", "measured used")
def a42(spark, d):
    return V.calibrate(panel_o(spark, d).withColumn("year", F.col("period").cast("double")), ["grp"], "year", "value", 0.5, tolerance=0.9)
