"""Queries of sources, sinks and streams: each writes to a scratch folder and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapwise.functions.exprs import ns_to_s
from lapwise.operators.shaping import stage
from lapwise.sources import publish as B, store as S
from lapwise.sources.scratch import shared_dir
from lapwise.streaming import ordered, replay as R
from lapwise.plans.registration import query, table
from lapwise.plans.testbed import O, panel_o


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query("s01_s02_partitioned_roundtrip", "SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderstatus AS session, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1997 GROUP BY ALL", "total")
def s01(spark, d):
    path = scratch(spark)
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("session"))
    S.write_partitioned(orders, f"{path}/laps", ["season", "session"])
    back = S.read_dataset(spark, path, "laps", orders.schema, session="F").where("season = 1997")
    return back.groupBy(F.col("season").cast("long").alias("season"), "session").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("s06_file_layout", "SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderstatus AS session, 'zstd' AS codec, count(*) AS n FROM orders GROUP BY ALL")
def s06(spark, d):
    """The partition folders and the codec as the files' own names have them, with the rows of each."""
    path = scratch(spark)
    S.write_partitioned(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("session")), path, ["season", "session"])
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "o_orderkey")
    part = lambda name: F.regexp_extract("file", rf"/{name}=([^/]+)/", 1)
    codec = F.regexp_extract("file", r"[.]([a-z0-9]+)[.]parquet$", 1)
    return files.groupBy(part("season").cast("long").alias("season"), part("session").alias("session"), codec.alias("codec")).agg(F.count(F.lit(1)).alias("n"))


@query("s03_seed", "SELECT n_nationkey, n_name FROM nation")
def s03(spark, d):
    path = scratch(spark)
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    nation.coalesce(1).write.option("header", True).csv(path)
    return S.read_seed(spark, path, nation.schema)


@query("s05_empty_table", "SELECT n_nationkey, NULL::VARCHAR AS code FROM nation")
def s05(spark, d):
    nothing = S.empty_table(spark, f"n_nationkey {table(spark, d, 'nation').schema['n_nationkey'].dataType.simpleString()}, code string")
    return table(spark, d, "nation").select("n_nationkey").join(nothing, "n_nationkey", "left")


@query("s07_single_file", "SELECT count(*) AS n FROM supplier")
def s07(spark, d):
    path = scratch(spark)
    S.write_single(table(spark, d, "supplier"), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("s08_enriched_export", "SELECT CAST(year(o_orderdate) AS BIGINT) AS season, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def s08(spark, d):
    path = scratch(spark)
    keyed = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("long").alias("season"))
    S.write_enriched(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), keyed, ["l_orderkey"], path, ["season"])
    return spark.read.parquet(path).groupBy(F.col("season").cast("long").alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("s09_manifest", "SELECT 'orders' AS name, count(*) AS rows, CAST(min(year(o_orderdate)) AS VARCHAR) AS first, CAST(max(year(o_orderdate)) AS VARCHAR) AS last, count(DISTINCT year(o_orderdate)) AS periods FROM orders UNION ALL SELECT 'items', count(*), CAST(min(year(l_shipdate)) AS VARCHAR), CAST(max(year(l_shipdate)) AS VARCHAR), count(DISTINCT year(l_shipdate)) FROM lineitem")
def s09(spark, d):
    tables = {"orders": table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "items": table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))}
    return S.export_manifest(tables, {"orders": "y", "items": "y"}).drop("content")


@query("s09_manifest_json", "SELECT 'orders' AS name, count(*) AS rows, CAST(min(year(o_orderdate)) AS VARCHAR) AS first, CAST(max(year(o_orderdate)) AS VARCHAR) AS last, 1 AS versions, true AS moved FROM orders UNION ALL SELECT 'items', count(*), CAST(min(year(l_shipdate)) AS VARCHAR), CAST(max(year(l_shipdate)) AS VARCHAR), 1, true FROM lineitem")
def s09_json(spark, d):
    """The manifest as JSON, read back; its one version differs from that of a manifest with a row less in one table."""
    path = scratch(spark)
    orders, items = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    for name, rows in (("now", orders), ("then", orders.where("o_orderkey <> 1"))):
        S.write_manifest(S.export_manifest({"orders": rows, "items": items}, {"orders": "y", "items": "y"}), f"{path}/{name}")
    schema = "name string, rows long, first string, last string, periods long, content string, version string"
    now, then = (spark.read.schema(schema).json(f"{path}/{name}") for name in ("now", "then"))
    versions = now.agg(F.countDistinct("version").cast("int").alias("versions"), F.max("version").alias("_now")).crossJoin(F.broadcast(then.agg(F.max("version").alias("_then"))))
    return now.crossJoin(F.broadcast(versions)).select("name", "rows", "first", "last", "versions", (F.col("_now") != F.col("_then")).alias("moved"))


@query("s10_u05_manifest_diff", "SELECT r_regionkey, r_name, 'new' AS side FROM region WHERE r_regionkey = 2 UNION ALL SELECT r_regionkey, r_name || 'x', 'current' FROM region WHERE r_regionkey = 2")
def s10(spark, d):
    region = table(spark, d, "region").select("r_regionkey", "r_name", F.current_timestamp().alias("at"))
    changed = region.withColumn("r_name", F.when(F.col("r_regionkey") == 2, F.concat("r_name", F.lit("x"))).otherwise(F.col("r_name")))
    return S.manifest_diff(changed, region, ["at"])


@query("s11_s12_incremental", f"SELECT period, count(*) AS n FROM {O} WHERE period > 1997 GROUP BY period")
def s11(spark, d):
    path = scratch(spark)
    panel = panel_o(spark, d)
    S.append_manifest(panel.where("period <= 1997").groupBy("period").agg(F.count(F.lit(1)).alias("rows")), path)
    return S.load_incremental(panel, spark.read.parquet(path), ["period"]).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("s11_s12_publish", f"SELECT period, count(*) AS n, sum(value) AS total, CASE WHEN period = 1999 THEN 3 WHEN period <= 1997 THEN 1 ELSE 2 END AS version FROM {O} GROUP BY period", "total")
def s11_publish(spark, d):
    """Two runs publish, the second only what is new; one partition is forced; a run without news writes nothing."""
    path = scratch(spark)
    panel = panel_o(spark, d).select("o_orderkey", "value", "period")
    B.publish(panel.where("period <= 1997"), path, ["period"])
    B.publish(panel, path, ["period"])
    B.publish(panel.where("period = 1999"), path, ["period"], force=True)
    B.publish(panel, path, ["period"])
    read = B.read_published(spark, path, panel.schema).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    versions = B.visible(spark, path).select(F.get_json_object("key", "$.period").cast("long").alias("period"), F.col("version").cast("int").alias("version"))
    return read.join(versions, "period").select(F.col("period").cast("long").alias("period"), "n", "total", "version")


@query("s13_schema_fingerprint", "SELECT t AS name, substr(sha1(cols), 1, 12) AS fingerprint, n FROM (SELECT 'region' AS t, (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE region)) AS cols, (SELECT count(*) FROM region) AS n)")
def s13(spark, d):
    region = table(spark, d, "region")
    return region.agg(F.lit("region").alias("name"), F.lit(S.schema_fingerprint(region)).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("s14_s15_extract_and_views", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def s14(spark, d):
    path = scratch(spark)
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    S.extract_partitions({"items": items}, S.literal_table(spark, [("A",), ("R",)], "l_returnflag string"), ["l_returnflag"], path)
    S.register_views(spark, {"lapwise_items": f"{path}/items"})
    return spark.sql("SELECT l_returnflag, count(*) AS n FROM lapwise_items GROUP BY l_returnflag")


@query("st01_event_payloads", """SELECT CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events WHERE user_id % 10 = 3""")
def st01(spark, d) -> DataFrame:
    path = scratch(spark)
    events = table(spark, d, "events").where("user_id % 10 = 3").select("event_id", "user_id", "event_type")
    events.write.parquet(f"{path}/in")
    stream = R.step_stream(spark, f"{path}/in", events.schema)
    R.replay(stream, f"{path}/out", f"{path}/checkpoint", stage=lambda s: R.event_payloads(s, "user_id", ["event_id", "event_type"]))
    return spark.read.parquet(f"{path}/out")


@query("st01_event_payloads_whole", """SELECT CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def st01_whole(spark, d) -> DataFrame:
    path = scratch(spark)
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    events.write.parquet(f"{path}/in")
    stream = R.step_stream(spark, f"{path}/in", events.schema)
    R.replay(stream, f"{path}/out", f"{path}/checkpoint", stage=lambda s: R.event_payloads(s, "user_id", ["event_id", "event_type"]))
    return spark.read.parquet(f"{path}/out")


@query("st01_ordered_stream", """SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n, event_id AS step, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def st01_ordered(spark, d) -> DataFrame:
    """All events as shuffled files, out as numbered payloads in order of time, and a second run that adds nothing."""
    path = scratch(spark)
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    typed = events.withColumn("user_id", F.col("user_id").cast("string"))
    typed.repartition(4, "event_id").write.parquet(f"{path}/in")
    ordered.closing_file(spark, f"{path}/in", typed.schema, "user_id", "ts")
    for _ in range(2):
        ordered.replay_in_order(R.step_stream(spark, f"{path}/in", typed.schema, files_per_trigger=5), f"{path}/out", f"{path}/checkpoint", "user_id", "ts", "event_id", ["event_id", "event_type"], late="3650 days")
    return spark.read.schema(ordered.OUT).parquet(f"{path}/out").select("key", "n", "step", "value")


@query("st02_staged_stream", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS entity, event_id * 1000000 / 1e9 AS seconds FROM events", "seconds")
def st02(spark, d) -> DataFrame:
    path = scratch(spark)
    events = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") * 1000000).alias("ns"))
    events.write.parquet(f"{path}/in")
    staged = lambda s: stage(s, {"id": ("event_id", "long"), "entity": ("user_id", "string"), "ns": ("ns", "long")}).select("id", "entity", ns_to_s("ns").alias("seconds"))
    R.replay(R.step_stream(spark, f"{path}/in", events.schema, files_per_trigger=4), f"{path}/out", f"{path}/checkpoint", stage=staged)
    return spark.read.parquet(f"{path}/out")
