"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwise.functions import exprs as X
from lapwise.operators import joins as J
from lapwise.operators.windows import over, spans
from lapwise.plans.registration import query, table
from lapwise.plans.testbed import E, O, panel_e, panel_o


@query("j01_inner_join", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("j02_enrichment_chain", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, o_orderstatus, c_nationkey, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j02(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    fact = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    return J.enrich(fact, [(orders, ["l_orderkey"]), (customer, ["o_custkey"]), (nation, ["c_nationkey"]), (region, ["r_regionkey"])]).select("l_orderkey", "line", "o_orderstatus", "c_nationkey", "n_name", "r_name")


@query("j03_asof_join", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS first_value FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT p.event_id, coalesce(v.value, f.first_value) AS seen FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts LEFT JOIN f ON p.user_id = f.user_id""")
def j03(spark, d):
    ev = table(spark, d, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("value").alias("seen"), F.col("event_id").alias("tie"))
    return J.asof_join(left, right, ["user_id"], "ts", "seen_at", ["seen"], tie="tie").select("event_id", "seen")


@query("j04_anti_before", "SELECT event_id FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts)")
def j04(spark, d):
    ev = table(spark, d, "events")
    return J.anti_before(ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at")), ["user_id"], "ts", "seen_at").select("event_id")


SEGMENTS = "(VALUES ('A', 'low', 0, 10), ('A', 'high', 40, 50), ('R', 'mid', 20, 30), ('N', 'mid', 15, 35)) s(l_returnflag, segment, lo, hi)"


@query("j05_s04_range_join", f"SELECT s.l_returnflag, segment, count(*) AS n, avg(l_extendedprice) AS mean FROM lineitem l JOIN {SEGMENTS} ON l.l_returnflag = s.l_returnflag AND l_quantity BETWEEN lo AND hi GROUP BY 1, 2", "mean")
def j05(spark, d):
    segments = spark.createDataFrame([("A", "low", 0, 10), ("A", "high", 40, 50), ("R", "mid", 20, 30), ("N", "mid", 15, 35)], "l_returnflag string, segment string, lo int, hi int")
    found = J.segment_join(table(spark, d, "lineitem"), F.broadcast(segments), ["l_returnflag"], "l_quantity", "lo", "hi", lookup=True)  # four literal rows
    return found.groupBy("l_returnflag", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"))


STEPS = f"(SELECT context, step, avg(value) AS value FROM {E} GROUP BY context, step)"


@query("j06_band_median", f"WITH t AS {STEPS} SELECT a.context, a.step, median(b.value) AS band_median FROM t a JOIN t b ON a.context = b.context AND b.step BETWEEN a.step - 3 AND a.step + 3 GROUP BY 1, 2", "band_median")
def j06(spark, d):
    steps = panel_e(spark, d).groupBy("context", "step").agg(F.avg("value").alias("value"))
    return J.band_median(steps, ["context"], "step", "value", 3).select("context", "step", "band_median")


@query("j07_w21_rolling_mad", f"""WITH t AS {E}, m AS (SELECT a.event_id, a.entity, a.context, a.step, a.value, median(b.value) AS roll_median FROM t a JOIN t b ON a.entity = b.entity AND a.context = b.context AND b.step BETWEEN a.step - 6 AND a.step GROUP BY ALL)
SELECT m.event_id, m.roll_median, greatest(median(abs(b.value - m.roll_median)), 0.5) AS roll_mad, abs(m.value - m.roll_median) / greatest(median(abs(b.value - m.roll_median)), 0.5) AS score FROM m JOIN t b ON m.entity = b.entity AND m.context = b.context AND b.step BETWEEN m.step - 6 AND m.step GROUP BY m.event_id, m.roll_median, m.value""", "roll_median roll_mad score")
def j07(spark, d):
    found = J.rolling_mad(panel_e(spark, d), ["entity", "context"], "step", "value", 7, floor=0.5)
    return found.select("event_id", "roll_median", "roll_mad", (F.abs(F.col("value") - F.col("roll_median")) / F.col("roll_mad")).alias("score"))


@query("j08_ordered_pairs", f"SELECT a.context, a.step, a.entity AS a_entity, b.entity AS b_entity, a.value - b.value AS gap FROM {E} a JOIN {E} b ON a.grp = b.grp AND a.context = b.context AND a.step = b.step AND a.entity <> b.entity", "gap")
def j08(spark, d):
    rows = J.pairs(panel_e(spark, d), ["grp", "context", "step"], "entity", ["value"])
    return rows.select("context", "step", "a_entity", "b_entity", (F.col("a_value") - F.col("b_value")).alias("gap"))


@query("j09_unordered_pairs", f"SELECT DISTINCT a.context, a.entity AS a_entity, b.entity AS b_entity FROM {E} a JOIN {E} b ON a.grp = b.grp AND a.context = b.context AND a.entity < b.entity")
def j09(spark, d):
    entities = panel_e(spark, d).select("grp", "context", "entity").distinct()
    return J.pairs(entities, ["grp", "context"], "entity", [], ordered=False).select("context", "a_entity", "b_entity")


METRICS = f"(SELECT context, entity, compound, avg(value) AS v FROM {E} GROUP BY ALL)"


@query("j10_pair_delta", f"WITH m AS {METRICS}, p AS (SELECT DISTINCT a.context, a.entity AS a_entity, b.entity AS b_entity FROM {E} a JOIN {E} b ON a.grp = b.grp AND a.context = b.context AND a.entity < b.entity) SELECT p.context, a_entity, b_entity, a.compound, round(a.v - coalesce(b.v, 0), 3) AS delta FROM p JOIN m a ON a.context = p.context AND a.entity = a_entity LEFT JOIN m b ON b.context = p.context AND b.entity = b_entity AND b.compound = a.compound", "delta")
def j10(spark, d):
    panel = panel_e(spark, d)
    pair_rows = J.pairs(panel.select("grp", "context", "entity").distinct(), ["grp", "context"], "entity", [], ordered=False)
    metrics = panel.groupBy("context", "entity", "compound").agg(F.avg("value").alias("v"))
    return J.pair_delta(pair_rows, metrics, ["context"], "entity", "v").select("context", "a_entity", "b_entity", "compound", "delta")


@query("j11_pairwise_scenario", f"WITH m AS (SELECT context, entity, avg(value) AS mu FROM {E} GROUP BY ALL) SELECT a.context, a.entity, count(*) FILTER (WHERE a.mu < b.mu) AS beaten FROM m a JOIN m b ON a.context = b.context AND a.entity <> b.entity GROUP BY 1, 2")
def j11(spark, d):
    means = panel_e(spark, d).groupBy("context", "entity").agg(F.avg("value").alias("mu"))
    found = J.pairs(means, ["context"], "entity", ["mu"])
    return found.groupBy("context", F.col("a_entity").alias("entity")).agg(F.count_if(F.col("a_mu") < F.col("b_mu")).alias("beaten"))


@query("j12_global_scalar", f"SELECT entity, avg(value) - (SELECT avg(value) FROM {E}) AS above FROM {E} GROUP BY entity", "above")
def j12(spark, d):
    panel = panel_e(spark, d)
    means = panel.groupBy("entity").agg(F.avg("value").alias("m"))
    return J.with_scalar(means, F.avg("value").alias("whole"), source=panel).select("entity", (F.col("m") - F.col("whole")).alias("above"))


@query("j13_expand_alternatives", f"WITH g AS (SELECT DISTINCT context, grp AS host FROM {E}) SELECT host, count(*) AS n, sum(value) AS total FROM {E} e JOIN g ON e.context = g.context GROUP BY host", "total")
def j13(spark, d):
    panel = panel_e(spark, d)
    hosts = panel.select("context", F.col("grp").alias("host")).distinct()
    return J.expand(panel.select("context", "value"), hosts, ["context"]).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("j14_two_roles", f"WITH s AS (SELECT context, grp, avg(value) AS mu FROM {E} GROUP BY ALL), k AS (SELECT context || '_' || grp AS k, mu FROM s), g AS (SELECT DISTINCT context, entity, grp, (grp + 1) % 5 AS host FROM {E}) SELECT g.context, g.entity, own.mu AS own_mu, host.mu AS host_mu FROM g LEFT JOIN k own ON own.k = g.context || '_' || g.grp LEFT JOIN k host ON host.k = g.context || '_' || g.host", "own_mu host_mu")
def j14(spark, d):
    panel = panel_e(spark, d)
    lookup = panel.groupBy("context", "grp").agg(F.avg("value").alias("mu")).select(X.key("context", "grp").alias("k"), "mu")
    rows = panel.select("context", "entity", "grp", ((F.col("grp") + 1) % 5).alias("host")).distinct().withColumns({"own_key": X.key("context", "grp"), "host_key": X.key("context", "host")})
    return J.join_roles(rows, lookup, "k", {"own": "own_key", "host": "host_key"}).select("context", "entity", "own_mu", "host_mu")


OVERRIDES = "(VALUES ('view', 3, 0.1), ('view', NULL, 0.5), ('click', 7, 0.2)) o(event_type, entity, weight)"


@query("j15_override", f"WITH o AS (SELECT * FROM {OVERRIDES}) SELECT e.event_id, CAST(coalesce(x.weight, g.weight) AS DOUBLE) AS weight FROM {E} e LEFT JOIN o x ON x.event_type = e.event_type AND x.entity = e.entity LEFT JOIN o g ON g.event_type = e.event_type AND g.entity IS NULL", "weight")
def j15(spark, d):
    rules = spark.createDataFrame([("view", 3, 0.1), ("view", None, 0.5), ("click", 7, 0.2)], "event_type string, entity long, weight double")
    return J.override(panel_e(spark, d).select("event_id", "event_type", "entity"), rules, ["event_type"], "entity", "weight").select("event_id", "weight")


@query("j16_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j16(spark, d):
    return J.exclude(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("j16_excluded_urgent", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def j16_urgent(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.exclude(table(spark, d, "customer").select("c_custkey"), urgent, ["c_custkey"])


@query("j17_exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer")
def j17(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.exists_flag(table(spark, d, "customer").select("c_custkey"), big, ["c_custkey"], "big")


@query("j18_w22_spans", f"""WITH s AS (SELECT entity, context, step FROM {E} WHERE event_type = 'signup' UNION ALL SELECT DISTINCT entity, context, NULL FROM {E}), n AS (SELECT entity, context, count(*) AS total FROM {E} GROUP BY ALL),
w AS (SELECT entity, context, row_number() OVER v AS span, coalesce(lag(step) OVER v + 1, 1) AS start, coalesce(step, total) AS finish FROM s JOIN n USING (entity, context) WINDOW v AS (PARTITION BY entity, context ORDER BY step NULLS LAST))
SELECT w.entity, w.context, span, start, finish, count(*) AS purchases FROM w JOIN (SELECT * FROM {E} WHERE event_type = 'purchase') p ON p.entity = w.entity AND p.context = w.context AND p.step BETWEEN start AND finish + 1 GROUP BY ALL""")
def j18(spark, d):
    panel = panel_e(spark, d)
    ends = panel.where("event_type = 'signup'").select("entity", "context", F.col("step").alias("end")).unionByName(panel.select("entity", "context").distinct().withColumn("end", F.lit(None).cast("long")))
    total = panel.groupBy("entity", "context").agg(F.count(F.lit(1)).alias("total"))
    found = spans(ends.join(total, ["entity", "context"]), ["entity", "context"], "end", "total").withColumn("span", F.col("span").cast("long"))
    inside = J.interval_join(found, panel.where("event_type = 'purchase'").select("entity", "context", "step"), ["entity", "context"], "step", "start", "finish")
    return inside.groupBy("entity", "context", "span", "start", "finish").agg(F.count(F.lit(1)).alias("purchases"))


YEARS = f"(SELECT entity, period, avg(value) AS mu FROM {O} GROUP BY ALL)"


@query("j19_next_period", f"WITH y AS {YEARS} SELECT a.entity, a.period, b.mu - a.mu AS change FROM y a JOIN y b ON a.entity = b.entity AND b.period = a.period + 1", "change")
def j19(spark, d):
    years = panel_o(spark, d).groupBy("entity", "period").agg(F.avg("value").alias("mu"))
    return J.next_period(years, ["entity"], "period", "mu").select("entity", "period", (F.col("next_mu") - F.col("mu")).alias("change"))


@query("j20_next_rank", f"WITH r AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY mu DESC) AS place FROM {YEARS}) SELECT a.period, a.place, a.entity, b.entity AS next_entity FROM r a JOIN r b ON a.period = b.period AND b.place = a.place + 1")
def j20(spark, d):
    years = panel_o(spark, d).groupBy("entity", "period").agg(F.avg("value").alias("mu"))
    ranked = years.withColumn("place", F.rank().over(over(["period"]).orderBy(F.desc("mu"))).cast("long"))
    return J.next_rank(ranked, ["period"], "place", ["entity"]).select("period", "place", "entity", "next_entity")


@query("j21_normalised_key", "SELECT c_custkey, count(*) AS orders FROM customer JOIN orders ON CAST(o_custkey AS VARCHAR) = ltrim(split_part(c_name, '#', 2), '0') GROUP BY c_custkey")
def j21(spark, d):
    customer = table(spark, d, "customer").withColumn("k", F.ltrim(F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit("0")))
    return customer.join(table(spark, d, "orders").withColumn("k", F.col("o_custkey").cast("string")), "k").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"))


@query("j22_attach_group", f"SELECT event_id, value - avg(value) OVER (PARTITION BY context, compound) AS above, count(*) OVER (PARTITION BY context, compound) AS n FROM {E}", "above")
def j22(spark, d):
    found = J.attach_group(panel_e(spark, d), ["context", "compound"], mu=F.avg("value"), n=F.count(F.lit(1)))
    return found.select("event_id", (F.col("value") - F.col("mu")).alias("above"), "n")
