"""Queries of projections, predicates, scalar functions, plain aggregates, sorting, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwise.functions import exprs as X
from lapwise.operators import shaping as S
from lapwise.operators.windows import over, top_per_group
from lapwise.plans.registration import query, table
from lapwise.plans.testbed import E, L, O, panel_e, panel_l, panel_o


@query("p01_staging", "SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem")
def p01(spark, d):
    return S.stage(table(spark, d, "lineitem"), {"order_id": ("l_orderkey", "long"), "line": ("l_linenumber", "long"), "flag": ("l_returnflag", "string"), "quantity": ("l_quantity", "long")})


@query("p02_unit_conversion", "SELECT event_id, CAST(user_id * 1500000000 AS DOUBLE) / 1e9 AS seconds FROM events", "seconds")
def p02(spark, d):
    return table(spark, d, "events").select("event_id", X.ns_to_s(F.col("user_id") * 1500000000).alias("seconds"))


@query("p03_project_except", "SELECT * EXCLUDE (props, ts) FROM events", "value")
def p03(spark, d):
    return table(spark, d, "events").drop("props", "ts")


@query("p04_null_tokens", "SELECT event_id, CASE WHEN upper(event_type) NOT IN ('CLICK', 'NAN', '') THEN upper(event_type) END AS label FROM events")
def p04(spark, d):
    return table(spark, d, "events").select("event_id", X.null_tokens("event_type", ("CLICK", "NAN", "")).alias("label"))


@query("p05_status_flags", "SELECT o_orderkey, regexp_matches(o_orderpriority, '[12]') AS urgent, regexp_matches(o_orderpriority, '[45]') AS slow FROM orders")
def p05(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.status_flag("o_orderpriority", "12").alias("urgent"), X.status_flag("o_orderpriority", "45").alias("slow"))


@query("p06_validity", "SELECT event_id, value > 20 AND NOT (event_type = 'signup') AND ts IS NOT NULL AS valid FROM events")
def p06(spark, d):
    return table(spark, d, "events").select("event_id", X.valid_row(F.col("value") > 20, F.col("event_type") == "signup", F.col("ts")).alias("valid"))


@query("p07_range_filter", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def p07(spark, d):
    return S.in_range(table(spark, d, "lineitem"), "l_quantity", 10, 20).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")


@query("p08_clean_rows", "SELECT event_type, count(*) FILTER (WHERE value > 5 AND coalesce(nullif(event_type, 'view'), 'normal') = 'normal') AS lenient, count(*) FILTER (WHERE value > 5 AND nullif(event_type, 'view') = 'normal') AS strict FROM events GROUP BY event_type")
def p08(spark, d):
    label, ok = F.nullif(F.col("event_type"), F.lit("view")), F.col("value") > 5
    lenient, strict = X.clean_row(ok, label), X.clean_row(ok, label, null_is_normal=False)
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(lenient).alias("lenient"), F.count_if(strict).alias("strict"))


@query("p09_classify", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'override' WHEN value > 80 THEN 'out' WHEN value > 40 THEN 'slow' ELSE 'normal' END AS label, CASE WHEN event_type = 'signup' THEN 0.1 WHEN value > 80 THEN 0.0 WHEN value > 40 THEN 0.5 ELSE 1.0 END AS weight FROM events", "weight")
def p09(spark, d):
    label, weight = X.classify([(F.col("event_type") == "signup", "override", 0.1), (F.col("value") > 80, "out", 0.0), (F.col("value") > 40, "slow", 0.5)], ("normal", 1.0))
    return table(spark, d, "events").select("event_id", label.alias("label"), weight.alias("weight"))


@query("p10_dominant_component", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN abs(l_discount * 100) >= greatest(l_tax * 100, l_quantity / 10) THEN 'discount' WHEN l_tax * 100 >= l_quantity / 10 THEN 'tax' ELSE 'quantity' END AS dominant FROM lineitem")
def p10(spark, d):
    label = X.argmax_label({"discount": F.col("l_discount") * 100, "tax": F.col("l_tax") * 100, "quantity": F.col("l_quantity") / 10})
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), label.alias("dominant"))


@query("p11_clamp", "SELECT event_id, greatest(10, least(value, 60)) AS clamped FROM events WHERE value IS NOT NULL", "clamped")
def p11(spark, d):
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", X.clamp("value", 10, 60).alias("clamped"))


@query("p12_state_classes", f"SELECT entity, context, CASE WHEN avg(value) > 55 THEN 'dense' WHEN avg(value) > 50 AND max(value) > 99 THEN 'mixed' WHEN avg(value) > 45 THEN 'light' ELSE 'clear' END AS state FROM {E} GROUP BY entity, context")
def p12(spark, d):
    m, top = F.avg("value"), F.max("value")
    return panel_e(spark, d).groupBy("entity", "context").agg(F.when(m > 55, "dense").when((m > 50) & (top > 99), "mixed").when(m > 45, "light").otherwise("clear").alias("state"))


@query("p14_strategy_verdict", f"SELECT unit_id, CASE WHEN best IS NULL THEN 'no_reference' WHEN n - best > 3 THEN 'late' WHEN n - best < -3 THEN 'early' ELSE 'on_time' END AS verdict FROM (SELECT unit_id, count(*) AS n, min(CASE WHEN value > 60 THEN pos END) + 5 AS best FROM {E} GROUP BY unit_id)")
def p14(spark, d):
    units = panel_e(spark, d).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), (F.min(F.when(F.col("value") > 60, F.col("pos"))) + 5).alias("best"))
    gap = F.col("n") - F.col("best")
    return units.select("unit_id", F.when(F.col("best").isNull(), "no_reference").when(gap > 3, "late").when(gap < -3, "early").otherwise("on_time").alias("verdict"))


@query("p15_eligibility", f"SELECT unit_id, count(*) AS rows, count(*) FILTER (WHERE coalesce(pos > 2 AND value > 5, false)) AS eligible FROM {E} GROUP BY unit_id")
def p15(spark, d):
    ok = F.coalesce((F.col("pos") > 2) & (F.col("value") > 5), F.lit(False))
    return panel_e(spark, d).groupBy("unit_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("eligible"))


@query("p17_outlier_bands", f"SELECT o_orderkey, value / nullif(min(value) OVER (PARTITION BY entity, period), 0) AS ratio, coalesce(value / nullif(min(value) OVER (PARTITION BY entity, period), 0) > 100, false) AS hard_outlier FROM {O}", "ratio")
def p17(spark, d):
    return S.outlier_bands(panel_o(spark, d), ["entity", "period"], "value", hard=100, soft=50).select("o_orderkey", "ratio", "hard_outlier")


@query("p18_fuel_state", f"SELECT event_id, greatest(110.0 * (1 - step / max(step) OVER (PARTITION BY entity, context)), 0.0) AS fuel_kg, value - greatest(110.0 * (1 - step / max(step) OVER (PARTITION BY entity, context)), 0.0) * 0.03 AS fuel_corrected FROM {E}", "fuel_kg fuel_corrected")
def p18(spark, d):
    return S.fuel_state(panel_e(spark, d), ["entity", "context"], "step", "value", start_kg=110.0, cost=0.03).select("event_id", "fuel_kg", "fuel_corrected")


@query("p19_fuel_state_flat", f"SELECT event_id, 5.0 * 0.03 AS fuel_penalty, value - 5.0 * 0.03 AS fuel_corrected FROM {E}", "fuel_penalty fuel_corrected")
def p19(spark, d):
    return S.fuel_state(panel_e(spark, d), ["entity", "context"], "step", "value", start_kg=5.0, cost=0.03, flat=True).select("event_id", "fuel_penalty", "fuel_corrected")


@query("p20_degradation", f"SELECT event_id, 0.1 + 0.05 * pos + 0.001 * pos * pos + 0.2 * greatest(pos - 12, 0) + greatest(0.0, least(greatest(90 - value, value - 110, 0) * 0.02, 1.0)) AS loss, 0.05 + 2 * 0.001 * pos + CASE WHEN pos > 12 THEN 0.2 ELSE 0 END AS slope FROM {E} WHERE value IS NOT NULL", "loss slope")
def p20(spark, d):
    loss, slope = X.hockey_stick(F.col("pos"), base=0.1, gradient=0.05, onset=12, severity=0.2, curve=0.001, temp=F.col("value"))
    return panel_e(spark, d).where("value IS NOT NULL").select("event_id", loss.alias("loss"), slope.alias("slope"))


@query("p21_decompose", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice - l_extendedprice * l_discount - l_extendedprice * l_tax AS residual FROM lineitem", "residual")
def p21(spark, d):
    parts = [F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice") * F.col("l_tax")]
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), X.residual_of(F.col("l_extendedprice"), parts).alias("residual"))


@query("p22_allocate", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, o_totalprice * l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "share")
def p22(spark, d):
    items, orders = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "order"), table(spark, d, "orders").withColumnRenamed("o_orderkey", "order")
    parent = items.groupBy("order").agg(F.sum("l_quantity").alias("total")).join(orders.select("order", "o_totalprice"), "order")
    return S.allocate(items, parent, ["order"], "l_quantity", "total", "o_totalprice", "share").select(F.col("order").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("line"), "share")


@query("p23_gap_and_thirds", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice / nullif(l_quantity / 3.6, 0) AS gap_s, CASE WHEN l_discount * 10 < 1.0/3 THEN 1 WHEN l_discount * 10 < 2.0/3 THEN 2 ELSE 3 END AS third FROM lineitem", "gap_s")
def p23(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), X.gap_seconds(F.col("l_extendedprice"), F.col("l_quantity")).alias("gap_s"), X.thirds(F.col("l_discount") * 10).alias("third"))


@query("p25_interactions", f"SELECT event_id, 0.02 * pos AS slope_term, greatest(-1.5, least(greatest(pos - 10, 0) * 0.3 - greatest(pos - 12, 0) * 0.3, 1.5)) AS hinge_term FROM {E}", "slope_term hinge_term")
def p25(spark, d):
    return panel_e(spark, d).select("event_id", X.slope_interaction(F.lit(0.02), F.col("pos")).alias("slope_term"), X.hinge_interaction(F.col("pos"), F.lit(12.0), F.lit(10.0), 0.3, 1.5).alias("hinge_term"))


@query("p26_recovery_probability", f"SELECT event_id, greatest(0.0, least(1 / (1 + exp(-4.0 * (value / 100 - 0.5))) * exp(-0.05 * pos), 1.0)) AS p, CASE WHEN value / 100 > 0.6 THEN 'surface' WHEN value / 100 < 0.3 THEN 'bulk' WHEN value IS NOT NULL THEN 'mixed' END AS kind FROM {E} WHERE value IS NOT NULL", "p")
def p26(spark, d):
    ratio = F.col("value") / 100
    return panel_e(spark, d).where("value IS NOT NULL").select("event_id", X.recovery_probability(ratio, F.col("pos")).alias("p"), X.band(ratio, 0.3, 0.6).alias("kind"))


@query("p28_confidence", f"SELECT unit_id, count(*) / (count(*) + 10.0) AS soft, least(count(*) / 15.0, 1.0) AS capped, CASE WHEN count(*) >= 20 THEN 0.9 WHEN count(*) >= 5 THEN 0.5 ELSE 0.1 END AS stepped FROM {E} GROUP BY unit_id", "soft capped stepped")
def p28(spark, d):
    n = F.col("n")
    return panel_e(spark, d).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).select("unit_id", X.confidence(n, 10).alias("soft"), X.capped_confidence(n, 15).alias("capped"), X.step_confidence(n, [(5, 0.5), (20, 0.9)], 0.1).alias("stepped"))


@query("p29_quadrant", f"WITH a AS (SELECT entity, avg(value) AS m, stddev_samp(value) AS s FROM {E} GROUP BY entity), q AS (SELECT median(m) AS mm, median(s) AS ms FROM a) SELECT entity, CASE WHEN s >= ms THEN 'high' ELSE 'low' END || '_' || CASE WHEN m >= mm THEN 'right' ELSE 'left' END AS quadrant FROM a, q")
def p29(spark, d):
    rows = panel_e(spark, d).groupBy("entity").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return S.quadrant(rows, "m", "s").select("entity", "quadrant")


@query("p30_span_cohort", "WITH w AS (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders), c AS (SELECT o_custkey, CAST(min(year(o_orderdate)) AS BIGINT) AS first_period, CAST(max(year(o_orderdate)) AS BIGINT) AS last_period FROM orders GROUP BY o_custkey) SELECT o_custkey, first_period, last_period, CASE WHEN first_period = lo AND last_period = hi THEN 'throughout' WHEN first_period = lo THEN 'left' WHEN last_period = hi THEN 'joined' ELSE 'passing' END AS cohort FROM c, w")
def p30(spark, d):
    return S.span_cohort(table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year")), "o_custkey", "year")


@query("p31_waterfall", "WITH a AS (SELECT l_returnflag AS flag, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1) SELECT flag, 'discount' AS component, 1 AS place, 0.0 AS start, discount AS finish FROM a UNION ALL SELECT flag, 'tax', 2, discount, discount + tax FROM a UNION ALL SELECT flag, 'quantity', 3, discount + tax, discount + tax + quantity FROM a", "start finish")
def p31(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    return S.waterfall(rows, ["flag"], ["discount", "tax", "quantity"])


@query("p32_scenario_grid", "SELECT s_suppkey, CAST(step AS INTEGER) AS step, s_acctbal + 0.1 * step AS value FROM supplier, range(1, 11) t(step)", "value")
def p32(spark, d):
    return S.scenario_grid(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), 10).select("s_suppkey", "step", (F.col("s_acctbal") + 0.1 * F.col("step")).alias("value"))


CDF = """CASE WHEN x >= 0 THEN 1 - 0.3989422804014327 * exp(-x * x / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
ELSE 0.3989422804014327 * exp(-x * x / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) END"""


@query("f01_normal_cdf", f"SELECT event_id, {CDF} AS p FROM (SELECT event_id, x, 1 / (1 + 0.2316419 * abs(x)) AS t FROM (SELECT event_id, (value - 50) / 20 AS x FROM events))", "p")
def f01(spark, d):
    return table(spark, d, "events").select("event_id", X.normal_cdf((F.col("value") - 50) / 20).alias("p"))


@query("f02_math", "SELECT event_id, abs(value - 50) AS a, sign(value - 50) AS s, exp(value / 100) AS e, sqrt(value) AS r, power(value, 2) AS p, floor(value) AS f, ceil(value) AS c, greatest(value, 50.0) AS g, least(value, 50.0) AS l, coalesce(nullif(floor(value / 50), 0), -1) AS n FROM events", "a s e r p f c g l n")
def f02(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.abs(v - 50).alias("a"), F.signum(v - 50).alias("s"), F.exp(v / 100).alias("e"), F.sqrt(v).alias("r"), F.pow(v, F.lit(2)).alias("p"), F.floor(v).alias("f"), F.ceil(v).alias("c"), F.greatest(v, F.lit(50.0)).alias("g"), F.least(v, F.lit(50.0)).alias("l"), F.coalesce(F.nullif(F.floor(v / 50), F.lit(0)), F.lit(-1)).alias("n"))


@query("f03_f08_keys", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, concat_ws('_', l_orderkey, l_linenumber, l_returnflag) AS line_id, md5(concat_ws('-', l_orderkey, l_linenumber)) AS surrogate FROM lineitem")
def f03(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), X.key("l_orderkey", "l_linenumber", "l_returnflag").alias("line_id"), X.surrogate_key("l_orderkey", "l_linenumber").alias("surrogate"))


@query("f04_f07_strings", "SELECT o_orderkey, lower(replace(replace(o_orderpriority, ' ', '_'), '-', '_')) AS slug, split_part(o_orderpriority, '-', 1) AS head, substr(o_orderpriority, 3, 4) AS middle, o_orderstatus || '/' || o_orderpriority AS joined, regexp_matches(o_orderpriority, 'HIGH') AS high, TRY_CAST(nullif(regexp_extract(o_orderpriority, '^(\\d)', 1), '') AS INTEGER) AS level, CASE upper(o_orderstatus) WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FINAL' ELSE upper(o_orderstatus) END AS status, TRY_CAST(o_orderpriority AS DOUBLE) AS failed FROM orders")
def f04(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", X.slug(p).alias("slug"), F.split_part(p, F.lit("-"), F.lit(1)).alias("head"), F.substring(p, 3, 4).alias("middle"), F.concat("o_orderstatus", F.lit("/"), p).alias("joined"), p.rlike("HIGH").alias("high"), X.rx_int(p, r"^(\d)").alias("level"), X.normalise("o_orderstatus", {"O": "OPEN", "F": "FINAL"}).alias("status"), p.try_cast("double").alias("failed"))


@query("f09_f10_dates", "SELECT event_id, CAST(date_diff('day', CAST(ts AS DATE), DATE '2025-01-01') AS INTEGER) AS age, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6 AS seconds FROM events", "seconds")
def f09(spark, d):
    return table(spark, d, "events").select("event_id", X.age_days("ts", F.lit("2025-01-01").cast("date")).alias("age"), X.session_seconds("ts", F.col("ts")).alias("seconds"))


@query("f11_payload", """SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS payload FROM events""")
def f11(spark, d):
    return table(spark, d, "events").select("event_id", X.payload("event_id", "user_id", "event_type").alias("payload"))


@query("a01_grouped_aggregates", f"SELECT entity, period, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM {O} GROUP BY entity, period", "total mean lo hi")
def a01(spark, d):
    return panel_o(spark, d).groupBy("entity", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("a02_conditional_aggregates", f"SELECT entity, avg(value) FILTER (WHERE status = 'F') AS final_mean, count(*) FILTER (WHERE status = 'O') AS open_n, sum(CASE WHEN priority LIKE '1%' THEN value ELSE 0 END) AS urgent_sum FROM {O} GROUP BY entity", "final_mean urgent_sum")
def a02(spark, d):
    return panel_o(spark, d).groupBy("entity").agg(F.avg(F.when(F.col("status") == "F", F.col("value"))).alias("final_mean"), F.count_if(F.col("status") == "O").alias("open_n"), F.sum(F.when(F.col("priority").startswith("1"), F.col("value")).otherwise(0.0)).alias("urgent_sum"))


@query("a03_percentiles", f"SELECT entity, median(value) AS mid, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.25) FILTER (WHERE status = 'F') AS q1_final FROM {O} GROUP BY entity", "mid p90 q1_final")
def a03(spark, d):
    return panel_o(spark, d).groupBy("entity").agg(F.median("value").alias("mid"), F.percentile("value", 0.9).alias("p90"), F.percentile(F.when(F.col("status") == "F", F.col("value")), 0.25).alias("q1_final"))


@query("a04_w23_mode", f"SELECT entity, arg_max(priority, n * 1000000 - r) AS modal FROM (SELECT entity, priority, count(*) AS n, row_number() OVER (ORDER BY priority) AS r FROM {O} GROUP BY entity, priority) GROUP BY entity")
def a04(spark, d):
    counts = panel_o(spark, d).groupBy("entity", "priority").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["entity"], [F.desc("n"), "priority"]).select("entity", F.col("priority").alias("modal"))


@query("a05_a06_a08_distinct_counts", f"SELECT entity, count(DISTINCT grp) AS groups, count(DISTINCT context) AS contexts, bool_or(value > 99.9) AS any_high FROM {E} GROUP BY entity HAVING count(*) > 5")
def a05(spark, d):
    found = panel_e(spark, d).groupBy("entity").agg(F.countDistinct("grp").alias("groups"), F.countDistinct("context").alias("contexts"), F.bool_or(F.col("value") > 99.9).alias("any_high"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 5").drop("n")


@query("a07_spread", f"SELECT entity, stddev_samp(value) AS sd, stddev_pop(value) AS sdp, var_pop(value) AS vp, covar_pop(value, step) AS cp, corr(value, step) AS r FROM {E} GROUP BY entity", "sd sdp vp cp r")
def a07(spark, d):
    return panel_e(spark, d).groupBy("entity").agg(F.stddev_samp("value").alias("sd"), F.stddev_pop("value").alias("sdp"), F.var_pop("value").alias("vp"), F.covar_pop("value", "step").alias("cp"), F.corr("value", "step").alias("r"))


@query("a09_distinct", f"SELECT DISTINCT entity, grp FROM {O}")
def a09(spark, d):
    return panel_o(spark, d).select("entity", "grp").distinct()


@query("o01_o05_ordered_limit", f"SELECT entity, context, total FROM (SELECT entity, context, sum(value) AS total FROM {O} GROUP BY entity, context) ORDER BY total DESC, entity, context LIMIT 20", "total")
def o01(spark, d):
    totals = panel_o(spark, d).groupBy("entity", "context").agg(F.sum("value").alias("total"))
    return S.top_k(totals, [F.desc("total"), F.col("entity"), F.col("context")], 20)


@query("o02_first_per_key", f"SELECT entity, period, o_orderkey FROM {O} QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY o_orderdate, o_orderkey) = 1")
def o02(spark, d):
    return S.first_per_key(panel_o(spark, d), ["entity", "period"], ["o_orderdate", "o_orderkey"]).select("entity", "period", "o_orderkey")


@query("o03_top_k", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def o03(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return S.top_k(rows, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 50).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice")


@query("o03_top_k_whole", "SELECT l_returnflag, l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 50")
def o03_whole(spark, d):
    rows = top_per_group(table(spark, d, "lineitem"), ["l_returnflag"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 50)
    return rows.select("l_returnflag", "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_extendedprice")


TOP = f"(SELECT period, entity, sum(value) AS a, count(*) AS b FROM {O} GROUP BY period, entity)"


@query("o04_u03_topk_overlap", f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY a DESC, entity) AS ra, row_number() OVER (PARTITION BY period ORDER BY b DESC, entity) AS rb FROM {TOP}) SELECT period, count(*) FILTER (WHERE ra <= 5 AND rb <= 5) / 5.0 AS overlap FROM t GROUP BY period", "overlap")
def o04(spark, d):
    rows = panel_o(spark, d).groupBy("period", "entity").agg(F.sum("value").alias("a"), F.count(F.lit(1)).alias("b"))
    return S.topk_overlap(rows, ["period"], "entity", "a", "b", 5)


@query("u01_union_all", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def u01(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("u02_unpivot", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))", "value")
def u02(spark, d):
    rows = table(spark, d, "lineitem").withColumn("line", F.col("l_linenumber").cast("long"))
    return S.unpivot(rows, ["l_orderkey", "line"], ["l_quantity", "l_discount", "l_tax"])


@query("u04_symmetric_difference", f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY a DESC, entity) AS ra, row_number() OVER (PARTITION BY period ORDER BY b DESC, entity) AS rb FROM {TOP}) SELECT period, entity, CASE WHEN ra <= 5 THEN 'left' ELSE 'right' END AS side FROM t WHERE (ra <= 5) <> (rb <= 5)")
def u04(spark, d):
    rows = panel_o(spark, d).groupBy("period", "entity").agg(F.sum("value").alias("a"), F.count(F.lit(1)).alias("b"))
    top = lambda v: top_per_group(rows, ["period"], [F.desc(v), "entity"], 5).select("period", "entity")
    return S.symmetric_difference(top("a"), top("b"), ["period", "entity"])


@query("p24_recombine", f"SELECT event_id, value - 0.5 * pos + 0.3 * pos AS swapped FROM {E}", "swapped")
def p24(spark, d):
    own, host = 0.5 * F.col("pos"), 0.3 * F.col("pos")
    return panel_e(spark, d).select("event_id", (X.residual_of(F.col("value"), [own]) + F.coalesce(host, F.lit(0.0))).alias("swapped"))


CLOCKS = "CASE event_id % 4 WHEN 0 THEN concat(h, ':', lpad(CAST(m AS VARCHAR), 2, '0'), ':', lpad(CAST(s AS VARCHAR), 2, '0'), '.5') WHEN 1 THEN concat(lpad(CAST(m AS VARCHAR), 2, '0'), ':', lpad(CAST(s AS VARCHAR), 2, '0')) WHEN 2 THEN concat(d, ' days ', lpad(CAST(h AS VARCHAR), 2, '0'), ':', lpad(CAST(m AS VARCHAR), 2, '0'), ':', lpad(CAST(s AS VARCHAR), 2, '0')) ELSE 'NaT' END"


@query("f10_clocks", "WITH p AS (SELECT event_id, event_id % 3 AS d, user_id % 24 AS h, event_id % 60 AS m, (event_id * 7) % 60 AS s FROM events) SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 3600 * h + 60 * m + s + 0.5 WHEN 1 THEN 60 * m + s WHEN 2 THEN 86400 * d + 3600 * h + 60 * m + s END AS DOUBLE) AS text_seconds, CAST(86400 * d + 3600 * h + 60 * m + s AS DOUBLE) AS duration_seconds FROM p", "text_seconds duration_seconds")
def f10_clocks(spark, d):
    """Clocks as text of three forms (other text is null), and durations."""
    parts = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("d"), (F.col("user_id") % 24).alias("h"), (F.col("event_id") % 60).alias("m"), (F.col("event_id") * 7 % 60).alias("s"))
    rows = parts.select("event_id", F.expr(CLOCKS.replace("VARCHAR", "STRING")).alias("text"), F.expr("make_dt_interval(int(d), int(h), int(m), s)").alias("span"))
    return rows.select("event_id", X.clock_seconds("text").alias("text_seconds"), X.duration_seconds("span").alias("duration_seconds"))


@query("p13_anomaly_label", f"WITH z AS (SELECT event_id, pos, abs(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM {E} WINDOW w AS (PARTITION BY entity, context)) SELECT event_id, CASE WHEN z > 1.6 AND pos = 1 THEN 'boundary' WHEN z > 1.6 THEN 'spike' WHEN z > 1.2 THEN 'drift' ELSE 'none' END AS anomaly, coalesce(z > 1.2, false) AS candidate, coalesce(z <= 1.6, true) AS usable FROM z")
def p13(spark, d):
    w = over(["entity", "context"])
    rows = panel_e(spark, d).withColumn("z", F.abs(F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0)))
    z = F.col("z")
    label = F.when((z > 1.6) & (F.col("pos") == 1), "boundary").when(z > 1.6, "spike").when(z > 1.2, "drift").otherwise("none")
    return rows.select("event_id", label.alias("anomaly"), F.coalesce(z > 1.2, F.lit(False)).alias("candidate"), F.coalesce(z <= 1.6, F.lit(True)).alias("usable"))


@query("l_samples_by_context", f"SELECT context, status, count(*) AS n, avg(value) AS mean FROM {L} GROUP BY context, status", "mean")
def l_samples(spark, d):
    return panel_l(spark, d).groupBy("context", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
