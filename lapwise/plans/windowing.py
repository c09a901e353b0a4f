"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwise.operators import windows as W
from lapwise.plans.registration import query, table
from lapwise.plans.testbed import E, O, panel_e, panel_o

UNIT = ["unit_id"]


@query("w01_w02_positions", f"SELECT event_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY step) AS BIGINT) AS place, count(*) OVER (PARTITION BY unit_id) AS n FROM {E}")
def w01(spark, d):
    return W.group_size(W.position(panel_e(spark, d), UNIT, ["step"], "place"), UNIT).select("event_id", F.col("place").cast("long").alias("place"), "n")


@query("w03_lag_default", f"SELECT event_id, lag(value, 1, 0.0) OVER (PARTITION BY unit_id ORDER BY step) AS previous FROM {E}", "previous")
def w03(spark, d):
    return panel_e(spark, d).select("event_id", F.lag("value", 1, 0.0).over(W.over(UNIT, ["step"])).alias("previous"))


@query("w04_neighbour_flags", f"SELECT event_id, coalesce(lag(value > 80) OVER w, false) AS after_high, coalesce(lead(value > 80) OVER w, false) AS before_high FROM {E} WINDOW w AS (PARTITION BY entity, context ORDER BY step)")
def w04(spark, d):
    return W.adjacent(panel_e(spark, d).withColumn("high", F.col("value") > 80), ["entity", "context"], ["step"], "high").select("event_id", "after_high", "before_high")


@query("w05_ew_load", f"SELECT event_id, 0.5 * coalesce(lag(value, 1) OVER w, 0) + 0.3 * coalesce(lag(value, 2) OVER w, 0) + 0.2 * coalesce(lag(value, 3) OVER w, 0) AS fast, 0.6 * greatest(coalesce(lag(value - 50, 1) OVER w, 0), 0) + 0.4 * greatest(coalesce(lag(value - 50, 2) OVER w, 0), 0) AS hot FROM {E} WINDOW w AS (PARTITION BY unit_id ORDER BY step)", "fast hot")
def w05(spark, d):
    return panel_e(spark, d).select("event_id", W.ew_load(F.col("value"), UNIT, ["step"], [0.5, 0.3, 0.2]).alias("fast"), W.ew_load(F.col("value") - 50, UNIT, ["step"], [0.6, 0.4], positive=True).alias("hot"))


@query("w06_early_baseline", f"WITH n AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n FROM {E}), b AS (SELECT unit_id, median(value) AS baseline FROM n WHERE pos <= greatest(ceil(n * 0.6), 3) GROUP BY unit_id) SELECT event_id, baseline, value - baseline AS deviation FROM n LEFT JOIN b USING (unit_id)", "baseline deviation")
def w06(spark, d):
    return W.early_baseline(panel_e(spark, d), UNIT, "pos", "value").select("event_id", "baseline", "deviation")


@query("w07_w08_rolling", f"SELECT event_id, avg(value) OVER (PARTITION BY entity, context ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth, 1 / (1 + coalesce(stddev_samp(value) OVER (PARTITION BY entity, context ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.5)) AS weight FROM {E}", "smooth weight")
def w07(spark, d):
    keys = ["entity", "context"]
    return panel_e(spark, d).select("event_id", W.rolling(F.avg, "value", keys, ["step"], -2, 2).alias("smooth"), (1 / (1 + F.coalesce(W.rolling(F.stddev_samp, "value", keys, ["step"], -4, 0), F.lit(0.5)))).alias("weight"))


@query("w09_w10_cumulative", f"SELECT event_id, sum(value) OVER (PARTITION BY unit_id ORDER BY step) AS running, value = max(value) OVER (PARTITION BY unit_id) AS is_max FROM {E}", "running")
def w09(spark, d):
    return panel_e(spark, d).select("event_id", W.cumulative("value", UNIT, ["step"]).alias("running"), (F.col("value") == F.max("value").over(W.over(UNIT))).alias("is_max"))


@query("w11_w12_ranks", f"SELECT o_orderkey, percent_rank() OVER w AS share, CAST(rank() OVER w AS BIGINT) AS place FROM {O} WINDOW w AS (PARTITION BY entity, period ORDER BY value)", "share")
def w11(spark, d):
    w = W.over(["entity", "period"], ["value"])
    return panel_o(spark, d).select("o_orderkey", F.percent_rank().over(w).alias("share"), F.rank().over(w).cast("long").alias("place"))


@query("w13_segment_metrics", f"SELECT unit_id, min(value) FILTER (WHERE pos <= 10) AS early_min, max(value) FILTER (WHERE pos > 10) AS late_max, arg_min(value, step) AS first_value FROM {E} GROUP BY unit_id", "early_min late_max first_value")
def w13(spark, d):
    return panel_e(spark, d).groupBy("unit_id").agg(F.min(F.when(F.col("pos") <= 10, F.col("value"))).alias("early_min"), F.max(F.when(F.col("pos") > 10, F.col("value"))).alias("late_max"), F.min_by("value", "step").alias("first_value"))


@query("w14_last_rows", f"SELECT unit_id, event_id FROM {E} QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY step DESC) <= 3")
def w14(spark, d):
    return W.top_per_group(panel_e(spark, d), UNIT, [F.desc("step")], 3).select("unit_id", "event_id")


@query("w15_w16_demean", f"SELECT event_id, value - avg(value) OVER (PARTITION BY unit_id) AS d_value, pos - avg(pos) OVER (PARTITION BY unit_id) AS d_pos, stddev_samp(value) OVER (PARTITION BY context) AS spread FROM {E}", "d_value d_pos spread")
def w15(spark, d):
    return W.demean(panel_e(spark, d), UNIT, ["value", "pos"]).select("event_id", "d_value", "d_pos", F.stddev_samp("value").over(W.over(["context"])).alias("spread"))


@query("w17_forward_targets", f"SELECT event_id, CASE WHEN lead(value) OVER w IS NOT NULL THEN greatest(0, least(lead(value) OVER w - value, 30)) END AS next_jump, CASE WHEN lead(value, 3) OVER w IS NOT NULL THEN greatest(lead(value, 1) OVER w + lead(value, 2) OVER w + lead(value, 3) OVER w - value, 0) END AS sum_3, CASE WHEN lead(value, 5) OVER w IS NOT NULL THEN greatest(lead(value, 1) OVER w + lead(value, 2) OVER w + lead(value, 3) OVER w + lead(value, 4) OVER w + lead(value, 5) OVER w - value, 0) END AS sum_5 FROM {E} WINDOW w AS (PARTITION BY unit_id ORDER BY step)", "next_jump sum_3 sum_5")
def w17(spark, d):
    return W.forward_targets(panel_e(spark, d), UNIT, ["step"], "value").select("event_id", "next_jump", "sum_3", "sum_5")


@query("w18_event_bucket", f"SELECT event_id, CASE WHEN lead(value) OVER w IS NULL THEN NULL WHEN coalesce(lead(value, 1) OVER w - value > 60, false) OR coalesce(lead(value, 2) OVER w - value > 60, false) THEN 'soon' WHEN coalesce(lead(value, 3) OVER w - value > 60, false) OR coalesce(lead(value, 5) OVER w - value > 60, false) THEN 'later' WHEN coalesce(lead(value, 6) OVER w - value > 60, false) THEN 'distant' ELSE 'none' END AS bucket FROM {E} WINDOW w AS (PARTITION BY unit_id ORDER BY step)")
def w18(spark, d):
    return W.event_bucket(panel_e(spark, d), UNIT, ["step"], "value", 60).select("event_id", "bucket")


@query("w19_recovery_flag", f"SELECT event_id, CASE WHEN lead(value) OVER w IS NOT NULL THEN (lead(value) OVER w + coalesce(lead(value, 2) OVER w, lead(value) OVER w)) / 2 < value END AS recovered FROM {E} WINDOW w AS (PARTITION BY unit_id ORDER BY step)")
def w19(spark, d):
    return W.recovery_flag(panel_e(spark, d), UNIT, ["step"], "value").select("event_id", "recovered")


@query("w20_boundaries", f"SELECT event_id, pos = 1 AS is_first, pos = max(pos) OVER (PARTITION BY unit_id) AS is_last FROM {E}")
def w20(spark, d):
    return panel_e(spark, d).select("event_id", (F.col("pos") == 1).alias("is_first"), (F.col("pos") == F.max("pos").over(W.over(UNIT))).alias("is_last"))


@query("w24_bucketed_median", f"SELECT compound, CAST(floor(pos / 5) * 5 AS BIGINT) AS bucket, median(value) AS mid FROM {E} GROUP BY ALL", "mid")
def w24(spark, d):
    return panel_e(spark, d).groupBy("compound", (F.floor(F.col("pos") / 5) * 5).cast("long").alias("bucket")).agg(F.median("value").alias("mid"))


@query("w25_monotone", "SELECT o_custkey, coalesce(bool_and(ok), true) AS monotone FROM (SELECT o_custkey, o_totalprice >= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ok FROM orders) GROUP BY o_custkey")
def w25(spark, d):
    return W.is_monotone(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
