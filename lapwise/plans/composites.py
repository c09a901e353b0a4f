"""More composite models: staged events, entities, predictions by fitted parameters, shares of components, segments, ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A, joins as J, shaping as S, survival as V, windows as W
from lapwise.plans.registration import query, table
from lapwise.plans.storing import scratch
from lapwise.plans.testbed import E, O, panel_e, panel_o
from lapwise.sources import store as T


@query("m01_m03_staged_stops", "SELECT concat_ws('_', user_id, event_id) AS stop_id, CASE WHEN upper(event_type) NOT IN ('VIEW') THEN upper(event_type) END AS kind, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) - event_id, 0) / 1e9 AS duration_s FROM events WHERE event_type IS NOT NULL", "duration_s")
def m03(spark, d):
    events = table(spark, d, "events").where("event_type IS NOT NULL")
    gap = F.coalesce(F.lead("event_id").over(W.over(["user_id"], ["ts", "event_id"])) - F.col("event_id"), F.lit(0))
    return events.select(X.key("user_id", "event_id").alias("stop_id"), X.null_tokens("event_type", ("VIEW",)).alias("kind"), X.ns_to_s(gap).alias("duration_s"))


@query("m02_m04_sector_rows", "SELECT concat_ws('_', l_orderkey, l_linenumber, 'S' || sector) AS sector_id, CAST(l_orderkey AS BIGINT) AS l_orderkey, sector, value FROM (SELECT l_orderkey, l_linenumber, 1 AS sector, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 3, l_tax FROM lineitem) WHERE value IS NOT NULL", "value")
def m04(spark, d):
    rows = S.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")
    sector = F.when(F.col("name") == "l_quantity", 1).when(F.col("name") == "l_discount", 2).otherwise(3)
    return rows.withColumn("sector", sector).select(X.key("l_orderkey", "l_linenumber", F.concat(F.lit("S"), F.col("sector").cast("string"))).alias("sector_id"), "l_orderkey", "sector", "value")


LABELS = "(VALUES (0, 'red'), (1, 'blue'), (2, 'green')) t(grp, colour)"


@query("m08_m09_entities", f"SELECT entity, any_value(o.grp) AS grp, coalesce(any_value(colour), 'other') AS colour, min(period) AS first_period, max(period) AS last_period, count(DISTINCT context) AS contexts FROM {O} o LEFT JOIN {LABELS} ON o.grp = t.grp GROUP BY entity")
def m09(spark, d):
    colours = spark.createDataFrame([(0, "red"), (1, "blue"), (2, "green")], "grp long, colour string")
    entities = panel_o(spark, d).groupBy("entity").agg(F.min("grp").alias("grp"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.countDistinct("context").alias("contexts"))
    return entities.join(F.broadcast(colours), "grp", "left").select("entity", "grp", F.coalesce("colour", F.lit("other")).alias("colour"), "first_period", "last_period", "contexts")  # three literal rows


@query("m17_predicted_loss", f"""WITH c AS (SELECT grp, context, compound, median(value) AS c, count(value) AS n FROM {E} GROUP BY ALL), p AS (SELECT grp, compound, median(value) AS p, count(value) AS pn FROM {E} GROUP BY ALL),
f AS (SELECT grp, context, compound, greatest(4, least(coalesce(CASE WHEN n >= 100 THEN c END, CASE WHEN pn >= 100 THEN p END, 10.0), 60)) / 4 AS onset FROM c JOIN p USING (grp, compound))
SELECT event_id, 0.05 * pos + 0.2 * greatest(pos - onset, 0) AS loss, 0.05 + CASE WHEN pos > onset THEN 0.2 ELSE 0 END AS slope, pos > onset AS past_onset FROM {E} JOIN f USING (grp, context, compound)""", "loss slope")
def m17(spark, d):
    panel = panel_e(spark, d)
    fitted = V.fit_cells(panel, ["grp", "context", "compound"], ["grp", "compound"], "compound", "value", min_n=100, defaults={"SOFT": 10.0, "MEDIUM": 10.0, "HARD": 10.0}, bounds=(4.0, 60.0)).select("grp", "context", "compound", (F.col("fitted") / 4).alias("onset"))
    loss, slope = X.hockey_stick(F.col("pos"), base=0.0, gradient=0.05, onset=F.col("onset"), severity=0.2)
    return J.enrich(panel, [(fitted, ["grp", "context", "compound"])]).select("event_id", loss.alias("loss"), slope.alias("slope"), (F.col("pos") > F.col("onset")).alias("past_onset"))


@query("m23_sector_decomposition", """WITH s AS (SELECT o_orderkey, l_linenumber, l_quantity / nullif(sum(l_quantity) OVER (PARTITION BY l_orderkey), 0) AS share, o_totalprice, o_totalprice * 0.02 AS fuel, o_totalprice * 0.01 * (o_orderkey % 7) AS wear FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS line, fuel * share AS fuel, wear * share AS wear, o_totalprice * share - fuel * share - wear * share AS residual, CASE WHEN abs(fuel * share) >= abs(wear * share) THEN 'fuel' ELSE 'wear' END AS dominant FROM s""", "fuel wear residual")
def m23(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 0.02).alias("p_fuel"), (F.col("o_totalprice") * 0.01 * (F.col("o_orderkey") % 7)).alias("p_wear"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("line"), "l_quantity")
    parents = orders.join(items.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("whole")), "o_orderkey")
    share = F.col("l_quantity") / F.nullif(F.col("whole"), F.lit(0.0))
    parts = items.join(parents, "o_orderkey").select("o_orderkey", "line", (F.col("p_fuel") * share).alias("fuel"), (F.col("p_wear") * share).alias("wear"), (F.col("o_totalprice") * share).alias("total"))
    return parts.select("o_orderkey", "line", "fuel", "wear", X.residual_of(F.col("total"), [F.col("fuel"), F.col("wear")]).alias("residual"), X.argmax_label({"fuel": F.col("fuel"), "wear": F.col("wear")}).alias("dominant"))


CORNERS = "(VALUES ('A', 'c1', 0, 15), ('A', 'c2', 30, 50), ('R', 'c1', 10, 40), ('N', 'c1', 5, 25)) c(l_returnflag, corner, lo, hi)"


@query("m05_m25_segment_metrics", f"SELECT l_suppkey, l_returnflag, corner, min(l_extendedprice) AS apex, max(l_extendedprice) FILTER (WHERE l_linestatus = 'F') AS entry, arg_min(l_extendedprice, (l_quantity, l_orderkey, l_linenumber)) AS first_price, count(*) AS n FROM lineitem JOIN {CORNERS} USING (l_returnflag) WHERE l_quantity BETWEEN lo AND hi AND l_quantity > 1 AND l_quantity < 49 GROUP BY ALL", "apex entry first_price")
def m25(spark, d):
    corners = spark.createDataFrame([("A", "c1", 0, 15), ("A", "c2", 30, 50), ("R", "c1", 10, 40), ("N", "c1", 5, 25)], "l_returnflag string, corner string, lo int, hi int")
    inside = J.segment_join(S.in_range(table(spark, d, "lineitem"), "l_quantity", 1, 49), F.broadcast(corners), ["l_returnflag"], "l_quantity", "lo", "hi", lookup=True)  # four literal rows
    price = F.col("l_extendedprice")
    return inside.groupBy("l_suppkey", "l_returnflag", "corner").agg(F.min(price).alias("apex"), F.max(F.when(F.col("l_linestatus") == "F", price)).alias("entry"), F.min_by(price, F.struct("l_quantity", "l_orderkey", "l_linenumber")).alias("first_price"), F.count(F.lit(1)).alias("n"))


RATED = f"(SELECT entity, period, avg(value) AS rating, stddev_samp(value) / sqrt(count(*)) AS se FROM {O} GROUP BY ALL)"


@query("m33_era_normalised_rating", f"""WITH r AS {RATED}, a AS (SELECT entity, avg(rating) FILTER (WHERE period >= 1998) - avg(rating) FILTER (WHERE period < 1998) AS d FROM r GROUP BY entity HAVING count(*) FILTER (WHERE period < 1998) >= 2 AND count(*) FILTER (WHERE period >= 1998) >= 2),
o AS (SELECT avg(d) AS off FROM a), j AS (SELECT entity, period, CASE WHEN period >= 1998 THEN rating - off ELSE rating END AS adjusted FROM r, o), g AS (SELECT avg(adjusted) AS m, stddev_samp(adjusted) AS s FROM j) SELECT entity, period, adjusted, (adjusted - m) / nullif(s, 0) AS z FROM j, g""", "adjusted z")
def m33(spark, d):
    rated = panel_o(spark, d).groupBy("entity", "period").agg(F.avg("value").alias("rating"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    adjusted = A.era_adjust(rated, "entity", "period", "rating", "se", boundary=1998, min_n=2).select("entity", "period", "adjusted")
    return J.with_scalar(adjusted, F.avg("adjusted").alias("m"), F.stddev_samp("adjusted").alias("s")).select("entity", "period", "adjusted", A.ratio(F.col("adjusted") - F.col("m"), F.col("s")).alias("z"))


@query("m06_sample_per_step", f"""WITH v AS (SELECT context, ts, arg_max(value, event_id) AS value FROM {E} WHERE event_type = 'view' GROUP BY ALL), f AS (SELECT context, arg_min(value, ts) AS first_value FROM v GROUP BY context)
SELECT e.event_id, coalesce(v.value, f.first_value) AS sample FROM {E} e ASOF LEFT JOIN v ON e.context = v.context AND e.ts >= v.ts LEFT JOIN f ON e.context = f.context""", "sample")
def m06(spark, d):
    panel = panel_e(spark, d)
    samples = panel.where("event_type = 'view'").select("context", F.col("ts").alias("at"), F.col("value").alias("sample"), F.col("event_id").alias("tie"))
    return J.asof_join(panel.select("event_id", "context", "ts"), samples, ["context"], "ts", "at", ["sample"], tie="tie").select("event_id", "sample")


@query("m18_m19_group_and_interaction", f"""WITH m AS (SELECT context, grp, median(value) AS mid FROM {E} GROUP BY ALL), g AS (SELECT context, grp, mid - avg(mid) OVER (PARTITION BY context) AS effect FROM m), c AS (SELECT grp, context, avg(value) AS m, count(*) AS n FROM {E} GROUP BY ALL), w AS (SELECT grp, avg(value) AS a FROM {E} GROUP BY ALL)
SELECT context, grp, effect, n * (m - a) / (n + 5.0) AS interaction FROM g JOIN c USING (context, grp) JOIN w USING (grp)""", "effect interaction")
def m18(spark, d):
    panel = panel_e(spark, d)
    effect = A.group_effect(panel, ["context"], "grp", "value", min_n=1).select("context", "grp", "effect")
    inter = A.interaction(panel, "grp", "context", "period", "value").select("context", "grp", "interaction")
    return effect.join(inter, ["context", "grp"])


@query("m07_events", """SELECT p_partkey AS event_id, upper(p_type) AS kind, regexp_matches(p_type, '^(PROMO|ECONOMY)') AS is_performance, NULL::VARCHAR AS allocation FROM (SELECT p_partkey, trim(p_type) AS p_type FROM part)""")
def m07(spark, d):
    """An event lookup staged from CSV with declared types, with flags, and joined to the typed placeholder of allocations that has no rows yet."""
    path = scratch(spark)
    part = table(spark, d, "part").select("p_partkey", F.trim("p_type").alias("p_type"))
    part.write.option("header", True).csv(path)
    staged = T.read_seed(spark, path, part.schema)
    nothing = T.empty_table(spark, f"p_partkey {part.schema['p_partkey'].dataType.simpleString()}, allocation string")
    return staged.join(nothing, "p_partkey", "left").select(F.col("p_partkey").alias("event_id"), F.upper("p_type").alias("kind"), F.col("p_type").rlike("^(PROMO|ECONOMY)").alias("is_performance"), "allocation")


@query("m10_unit_geometry", f"""SELECT event_id, pos AS given, row_number() OVER u AS place, count(*) OVER (PARTITION BY unit_id) AS unit_rows, row_number() OVER u = 1 AS is_first, lead(event_id) OVER u IS NULL AS is_last,
(row_number() OVER u) / (count(*) OVER (PARTITION BY unit_id)) AS share, lag(compound) OVER s IS DISTINCT FROM compound AS new_compound FROM {E} WINDOW u AS (PARTITION BY unit_id ORDER BY step), s AS (PARTITION BY entity, context ORDER BY step)""", "share")
def m10(spark, d):
    """Place, length and ends of each row's unit, and whether the category changes with it."""
    rows = W.position(panel_e(spark, d).withColumnRenamed("pos", "given"), ["unit_id"], ["step"], "place").withColumn("place", F.col("place").cast("long"))
    unit, sequence = W.over(["unit_id"], ["step"]), W.over(["entity", "context"], ["step"])
    rows = rows.withColumns({"unit_rows": F.count(F.lit(1)).over(W.over(["unit_id"])), "is_first": F.col("place") == 1, "is_last": F.lead("event_id").over(unit).isNull(), "new_compound": ~F.lag("compound").over(sequence).eqNullSafe(F.col("compound"))})
    return rows.select("event_id", "given", "place", "unit_rows", "is_first", "is_last", (F.col("place") / F.col("unit_rows")).alias("share"), "new_compound")


@query("m40_segment_deltas", f"""WITH g AS (SELECT grp, context, entity, unit, CAST(floor((pos - 1) / 5) AS BIGINT) AS segment, avg(value) AS v, min(value) AS low, count(*) AS n FROM {E} GROUP BY ALL)
SELECT a.context, a.unit, a.segment, a.entity AS a_entity, b.entity AS b_entity, a.v - b.v AS delta, a.low - b.low AS low_delta, least(a.n, b.n) AS n FROM g a JOIN g b ON a.grp = b.grp AND a.context = b.context AND a.unit = b.unit AND a.segment = b.segment AND a.entity < b.entity""", "delta low_delta")
def m40(spark, d):
    """Differences of two entities of a group in each segment of the same unit."""
    rows = panel_e(spark, d).withColumn("segment", F.floor((F.col("pos") - 1) / 5).cast("long"))
    metrics = rows.groupBy("grp", "context", "entity", "unit", "segment").agg(F.avg("value").alias("v"), F.min("value").alias("low"), F.count(F.lit(1)).alias("n"))
    both = J.pairs(metrics, ["grp", "context", "unit", "segment"], "entity", ["v", "low", "n"], ordered=False)
    return both.select("context", "unit", "segment", "a_entity", "b_entity", (F.col("a_v") - F.col("b_v")).alias("delta"), (F.col("a_low") - F.col("b_low")).alias("low_delta"), F.least("a_n", "b_n").alias("n"))
