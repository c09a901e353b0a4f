"""Bindings of the generic panels to the driver's tables, as DataFrames and as SQL table expressions.

E: events as long sequences (entity = user_id % 20 in a week); O: orders over years (entity = nation in a month);
L: line items as samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.operators.windows import position


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value", (F.col("user_id") % 20).alias("entity"), (F.col("user_id") % 5).alias("grp"), F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("long").alias("context"), F.lit(2024).cast("long").alias("period"))
    ev = position(ev, ["entity", "context"], ["ts", "event_id"], "step").withColumn("step", F.col("step").cast("long"))
    unit = F.floor((F.col("step") - 1) / 20).cast("long")
    ev = ev.withColumns({"unit": unit, "pos": (F.col("step") - 1) % 20 + 1})
    compound = F.when(F.col("unit") % 3 == 0, "SOFT").when(F.col("unit") % 3 == 1, "MEDIUM").otherwise("HARD")
    return ev.withColumns({"compound": compound, "unit_id": F.concat_ws("_", "entity", "context", "unit")})


E = """(SELECT *, CASE unit % 3 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS compound, concat_ws('_', entity, context, unit) AS unit_id FROM (
SELECT *, CAST(floor((step - 1) / 20) AS BIGINT) AS unit, (step - 1) % 20 + 1 AS pos FROM (
SELECT event_id, ts, user_id, event_type, value, user_id % 20 AS entity, user_id % 5 AS grp, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS context, CAST(2024 AS BIGINT) AS period,
row_number() OVER (PARTITION BY user_id % 20, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) ORDER BY ts, event_id) AS step FROM events)))"""


def panel_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = joined.select("o_orderkey", "o_orderdate", F.col("c_nationkey").cast("long").alias("entity"), F.col("n_regionkey").cast("long").alias("grp"), F.date_format("o_orderdate", "yyyy-MM").alias("context"), F.year("o_orderdate").cast("long").alias("period"), (F.col("o_totalprice") / 1000).alias("value"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return position(rows, ["entity", "context"], ["o_orderdate", "o_orderkey"], "step").withColumn("step", F.col("step").cast("long"))


O = """(SELECT *, row_number() OVER (PARTITION BY entity, context ORDER BY o_orderdate, o_orderkey) AS step FROM (
SELECT o_orderkey, o_orderdate, CAST(c_nationkey AS BIGINT) AS entity, CAST(n_regionkey AS BIGINT) AS grp, strftime(o_orderdate, '%Y-%m') AS context, CAST(year(o_orderdate) AS BIGINT) AS period,
o_totalprice / 1000 AS value, o_orderpriority AS priority, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""


def panel_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("entity"), (F.col("l_suppkey") % 10).alias("grp"), F.col("l_returnflag").alias("context"), F.year("l_shipdate").cast("long").alias("period"), F.col("l_extendedprice").alias("value"), F.col("l_linestatus").alias("status"), "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", "l_discount", "l_tax", "l_shipdate")


L = """(SELECT l_suppkey AS entity, l_suppkey % 10 AS grp, l_returnflag AS context, CAST(year(l_shipdate) AS BIGINT) AS period, l_extendedprice AS value, l_linestatus AS status, l_orderkey,
CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_discount, l_tax, l_shipdate FROM lineitem)"""
