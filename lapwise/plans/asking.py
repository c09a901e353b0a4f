"""User-level questions over the composite models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A, shaping as S, survival as V, windows as W
from lapwise.plans.marts import DECOMPOSED, PARTS, counterfactual, decomposition
from lapwise.plans.registration import query, table
from lapwise.plans.surviving import TABLE, durations
from lapwise.plans.testbed import E, O, panel_e, panel_o


@query("b01_component_averages", f"WITH a AS (SELECT entity, avg(fuel) AS fuel, avg(wear) AS wear, avg(trend) AS trend, avg(effect) AS effect FROM {DECOMPOSED} WHERE context = 1 GROUP BY entity) SELECT entity, 'fuel' AS component, 1 AS place, 0.0 AS start, fuel AS finish FROM a UNION ALL SELECT entity, 'wear', 2, fuel, fuel + wear FROM a UNION ALL SELECT entity, 'trend', 3, fuel + wear, fuel + wear + trend FROM a UNION ALL SELECT entity, 'effect', 4, fuel + wear + trend, fuel + wear + trend + effect FROM a", "start finish")
def b01(spark, d):
    means = decomposition(panel_e(spark, d)).where("context = 1").groupBy("entity").agg(*[F.avg(c).alias(c) for c in PARTS])
    return S.waterfall(means, ["entity"], PARTS)


@query("b02_consistency", f"WITH a AS (SELECT entity, avg(residual) AS pace, stddev_samp(residual) AS spread, count(*) AS n FROM {DECOMPOSED} GROUP BY entity HAVING count(*) >= 10), q AS (SELECT median(pace) AS mp, median(spread) AS ms FROM a) SELECT entity, n, pace, spread, CASE WHEN spread >= ms THEN 'high' ELSE 'low' END || '_' || CASE WHEN pace >= mp THEN 'right' ELSE 'left' END AS quadrant FROM a, q", "pace spread")
def b02(spark, d):
    rows = decomposition(panel_e(spark, d)).groupBy("entity").agg(F.avg("residual").alias("pace"), F.stddev_samp("residual").alias("spread"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return S.quadrant(rows, "pace", "spread")


@query("b03_era_series", f"SELECT entity, avg(value) AS rating, count(DISTINCT period) AS periods FROM {O} GROUP BY entity ORDER BY rating DESC, entity LIMIT 10", "rating")
def b03(spark, d):
    rows = panel_o(spark, d).groupBy("entity").agg(F.avg("value").alias("rating"), F.countDistinct("period").alias("periods"))
    return S.top_k(rows, [F.desc("rating"), F.col("entity")], 10)


@query("b04_gantt", f"""WITH s AS (SELECT entity, step AS e FROM {E} WHERE context = 1 AND event_type = 'signup' UNION ALL SELECT DISTINCT entity, NULL FROM {E} WHERE context = 1), n AS (SELECT entity, count(*) AS total FROM {E} WHERE context = 1 GROUP BY 1)
SELECT entity, row_number() OVER w AS span, coalesce(lag(e) OVER w + 1, 1) AS start, coalesce(e, total) AS finish FROM s JOIN n USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY e NULLS LAST)""")
def b04(spark, d):
    panel = panel_e(spark, d).where("context = 1")
    ends = panel.where("event_type = 'signup'").select("entity", F.col("step").alias("end")).unionByName(panel.select("entity").distinct().withColumn("end", F.lit(None).cast("long")))
    rows = W.spans(ends.join(panel.groupBy("entity").agg(F.count(F.lit(1)).alias("total")), "entity"), ["entity"], "end", "total")
    return rows.select("entity", F.col("span").cast("long").alias("span"), "start", "finish")


@query("b05_survival", f"SELECT compound, count(*) AS units, count(*) FILTER (WHERE observed) AS observed, bool_or(forced) AS any_forced, count(DISTINCT duration) AS times FROM {TABLE} GROUP BY compound")
def b05(spark, d):
    return durations(spark, d).groupBy("compound").agg(F.count(F.lit(1)).alias("units"), F.count_if("observed").alias("observed"), F.bool_or("forced").alias("any_forced"), F.countDistinct("duration").alias("times"))


@query("b06_scenario_standings", f"""WITH g AS (SELECT context, grp, median(value) - avg(median(value)) OVER (PARTITION BY context) AS effect FROM {E} GROUP BY context, grp), s AS (SELECT e.entity, avg(e.value - o.effect + h.effect) AS pace FROM {E} e JOIN g o ON o.context = e.context AND o.grp = e.grp JOIN g h ON h.context = e.context WHERE e.context = 1 AND h.grp = 2 GROUP BY ALL)
SELECT entity, pace, CAST(rank() OVER (ORDER BY round(pace, 9)) AS BIGINT) AS place FROM s""", "pace")
def b06(spark, d):
    rows = counterfactual(panel_e(spark, d).where("context = 1")).where("host = 2").groupBy("context", "entity").agg(F.avg("swapped").alias("pace"))
    return rows.withColumn("place", F.rank().over(W.over(["context"]).orderBy(F.round("pace", 9))).cast("long")).select("entity", "pace", "place")


@query("b07_scoreboard", f"SELECT period, avg(CASE WHEN value BETWEEN m - s AND m + s THEN 1.0 ELSE 0 END) AS coverage, count(*) AS n FROM (SELECT *, avg(value) OVER (PARTITION BY entity) AS m, stddev_samp(value) OVER (PARTITION BY entity) AS s FROM {O}) GROUP BY period", "coverage")
def b07(spark, d):
    w = W.over(["entity"])
    rows = panel_o(spark, d).withColumns({"lo": F.avg("value").over(w) - F.stddev_samp("value").over(w), "hi": F.avg("value").over(w) + F.stddev_samp("value").over(w)})
    return A.coverage(rows, "value", "lo", "hi", ["period"])


@query("b08_unit_options", f"SELECT unit_id, min(compound) AS compound, count(*) AS n, TRY_CAST(regexp_extract(unit_id, '(\\d+)$', 1) AS INTEGER) AS number FROM {E} GROUP BY unit_id")
def b08(spark, d):
    return panel_e(spark, d).groupBy("unit_id").agg(F.min("compound").alias("compound"), F.count(F.lit(1)).alias("n")).withColumn("number", X.rx_int("unit_id", r"(\d+)$"))


@query("b09_options_with_names", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def b09(spark, d):
    used = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    rows = table(spark, d, "nation").join(used, "n_nationkey", "left_semi").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query("b10_profiles", f"SELECT compound, quantile_cont(value, 0.9) AS peak, CASE WHEN count(*) > 1 THEN regr_slope(value, pos) END AS gradient, count(*) AS n FROM {E} GROUP BY compound", "peak gradient")
def b10(spark, d):
    return panel_e(spark, d).groupBy("compound").agg(F.percentile("value", 0.9).alias("peak"), A.ols("pos", "value").alias("gradient"), F.count(F.lit(1)).alias("n"))


@query("b05_survival_curve", f"""WITH t AS {TABLE}, k AS (SELECT duration AS t, compound, count(*) FILTER (WHERE observed) AS events, count(*) AS n FROM t WHERE compound = 'SOFT' GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM k)
SELECT t, product(1 - events / at_risk) OVER (ORDER BY t) AS survival FROM r""", "survival")
def b05_curve(spark, d):
    return V.km_curve(durations(spark, d).where("compound = 'SOFT'"), ["compound"], "duration", "observed").select("t", "survival")


@query("b01_component_averages_whole", f"WITH a AS (SELECT context, entity, avg(fuel) AS fuel, avg(wear) AS wear, avg(trend) AS trend, avg(effect) AS effect FROM {DECOMPOSED} GROUP BY context, entity) SELECT context, entity, 'fuel' AS component, 1 AS place, 0.0 AS start, fuel AS finish FROM a UNION ALL SELECT context, entity, 'wear', 2, fuel, fuel + wear FROM a UNION ALL SELECT context, entity, 'trend', 3, fuel + wear, fuel + wear + trend FROM a UNION ALL SELECT context, entity, 'effect', 4, fuel + wear + trend, fuel + wear + trend + effect FROM a", "start finish")
def b01_whole(spark, d):
    means = decomposition(panel_e(spark, d)).groupBy("context", "entity").agg(*[F.avg(c).alias(c) for c in PARTS])
    return S.waterfall(means, ["context", "entity"], PARTS)


@query("b04_gantt_whole", f"""WITH s AS (SELECT context, entity, step AS e FROM {E} WHERE event_type = 'signup' UNION ALL SELECT DISTINCT context, entity, NULL FROM {E}), n AS (SELECT context, entity, count(*) AS total FROM {E} GROUP BY ALL)
SELECT context, entity, row_number() OVER w AS span, coalesce(lag(e) OVER w + 1, 1) AS start, coalesce(e, total) AS finish FROM s JOIN n USING (context, entity) WINDOW w AS (PARTITION BY context, entity ORDER BY e NULLS LAST)""")
def b04_whole(spark, d):
    panel, by = panel_e(spark, d), ["context", "entity"]
    ends = panel.where("event_type = 'signup'").select(*by, F.col("step").alias("end")).unionByName(panel.select(*by).distinct().withColumn("end", F.lit(None).cast("long")))
    rows = W.spans(ends.join(panel.groupBy(*by).agg(F.count(F.lit(1)).alias("total")), by), by, "end", "total")
    return rows.select(*by, F.col("span").cast("long").alias("span"), "start", "finish")


@query("b05_survival_curve_whole", f"""WITH t AS {TABLE}, k AS (SELECT compound, duration AS t, count(*) FILTER (WHERE observed) AS events, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY compound ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM k)
SELECT compound, t, product(1 - events / at_risk) OVER (PARTITION BY compound ORDER BY t) AS survival FROM r""", "survival")
def b05_curve_whole(spark, d):
    return V.km_curve(durations(spark, d), ["compound"], "duration", "observed").select("compound", "t", "survival")


@query("b06_scenario_standings_whole", f"""WITH g AS (SELECT context, grp, median(value) - avg(median(value)) OVER (PARTITION BY context) AS effect FROM {E} GROUP BY context, grp), s AS (SELECT e.context, h.grp AS host, e.entity, avg(e.value - o.effect + h.effect) AS pace FROM {E} e JOIN g o ON o.context = e.context AND o.grp = e.grp JOIN g h ON h.context = e.context GROUP BY ALL)
SELECT context, host, entity, pace, CAST(rank() OVER (PARTITION BY context, host ORDER BY round(pace, 9)) AS BIGINT) AS place FROM s""", "pace")
def b06_whole(spark, d):
    rows = counterfactual(panel_e(spark, d)).groupBy("context", "host", "entity").agg(F.avg("swapped").alias("pace"))
    return rows.withColumn("place", F.rank().over(W.over(["context", "host"]).orderBy(F.round("pace", 9))).cast("long")).select("context", "host", "entity", "pace", "place")
