"""Publishing that survives being stopped, and streams that come out in order."""

import uuid

import pytest
from pyspark.sql import functions as F

from lapwise.sources import publish as P
from lapwise.sources.scratch import shared_dir
from lapwise.streaming import ordered, replay


def rows(spark, shift=0):
    return spark.range(600).select((F.col("id") % 3).cast("int").alias("season"), F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("r/"), (F.col("id") % 2).cast("string"))).alias("race"), (F.col("id") + shift).alias("v"))


def root_of(spark):
    return f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"


def content(spark, root):
    return sorted(map(tuple, P.read_published(spark, root, rows(spark).schema).select("season", F.coalesce("race", F.lit("-")), "v").collect()))


def test_a_run_killed_before_its_commit(spark, monkeypatch):
    """Nothing is seen of it; repeated, it equals one run; repeated again, it writes nothing; its leavings can be swept."""
    root, by, whole = root_of(spark), ["season", "race"], sorted((r[0], r[1] or "-", r[2]) for r in rows(spark).collect())
    real = P.commit
    monkeypatch.setattr(P, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        P.publish(rows(spark), root, by)
    assert content(spark, root) == []
    monkeypatch.setattr(P, "commit", real)
    assert P.publish(rows(spark), root, by) == 1 and content(spark, root) == whole
    assert P.publish(rows(spark), root, by) is None and P.commits(spark, root).count() == 1
    assert len(P.vacuum(spark, root)) == 1 and content(spark, root) == whole


def test_new_partitions_only_unless_forced(spark):
    root, by = root_of(spark), ["season"]
    assert P.publish(rows(spark).where("season < 2"), root, by) == 1
    assert P.publish(rows(spark, 1000), root, by) == 2  # season 2 alone is new
    seen = {r["key"]: (r["version"], r["rows"]) for r in P.visible(spark, root).collect()}
    assert seen == {'{"season":"0"}': (1, 200), '{"season":"1"}': (1, 200), '{"season":"2"}': (2, 200)}
    assert min(v for s, _, v in content(spark, root) if s == 2) >= 1000 > max(v for s, _, v in content(spark, root) if s < 2)
    assert P.publish(rows(spark, 5000), root, by, force=True) == 3
    assert min(v for _, _, v in content(spark, root)) >= 5000 and len(content(spark, root)) == 600
    assert P.read_published(spark, root, rows(spark).schema, keys=['{"season":"1"}']).count() == 200
    assert P.publish(rows(spark).where("false"), root, by) is None


def arrivals(spark, path, part):
    """Steps of three keys, a second apart, in files whose rows are shuffled; part picks files."""
    steps = spark.range(300).select((F.col("id") % 3).cast("string").alias("k"), F.timestamp_seconds(1_699_999_800 + F.col("id")).alias("t"), F.floor(F.col("id") / 3).alias("step"))
    for f in part:
        steps.where(F.floor(F.unix_seconds("t") / 30) % 10 == f).orderBy(F.rand(f)).coalesce(1).write.mode("append").parquet(path)
    return steps.schema


def test_payloads_in_order_stopped_and_resumed(spark):
    """Shuffled files in, two runs with a restart between: every step once, numbered in order of time."""
    base = root_of(spark)
    schema = arrivals(spark, f"{base}/in", range(0, 5))
    run = lambda: ordered.replay_in_order(replay.step_stream(spark, f"{base}/in", schema), f"{base}/out", f"{base}/state", "k", "t", "step", ["k", "step"], late="60 seconds")
    run()
    first = spark.read.parquet(f"{base}/out").count()
    arrivals(spark, f"{base}/in", range(5, 10))
    ordered.closing_file(spark, f"{base}/in", schema, "k", "t")
    run()
    run()  # nothing new
    out = spark.read.parquet(f"{base}/out")
    assert 0 < first < 300 and out.count() == 300
    for k in ("0", "1", "2"):
        got = [(r["n"], r["step"]) for r in out.where(F.col("key") == k).orderBy("n").collect()]
        assert got == [(i + 1, i) for i in range(100)]
    assert out.where(F.get_json_object("value", "$.step").cast("long") != F.col("step")).count() == 0


def test_late_steps_are_counted(spark):
    base = root_of(spark)
    schema = arrivals(spark, f"{base}/in", range(0, 10))
    late = spark.createDataFrame([("0", 999)], "k string, step long").select("k", F.timestamp_seconds(F.lit(1_600_000_000)).alias("t"), "step")
    run = lambda: ordered.replay_in_order(replay.step_stream(spark, f"{base}/in", schema), f"{base}/out", f"{base}/state", "k", "t", "step", ["step"], late="10 seconds")
    dropped = run()
    late.coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert run() == 1 and dropped == 0
    assert spark.read.parquet(f"{base}/out").where("step = 999").count() == 0


def test_the_gate_comes_before_the_one_task(spark, monkeypatch):
    """A table far over the gate is refused before it goes through one task, and leaves no file; a small one is one file."""
    from lapwise.sources import store

    root, big = root_of(spark), spark.range(50_000, numPartitions=4).select(F.rand(1).alias("v"))
    with pytest.raises(ValueError, match="would have about"):
        store.write_single(big, f"{root}/big", max_bytes=1000)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{root}/big")
    assert 0 < store.write_single(spark.range(5), f"{root}/small") < 10_000
    assert len(spark.read.parquet(f"{root}/small").inputFiles()) == 1


def test_clocks(spark):
    from lapwise.functions.exprs import clock_seconds

    cases = {"1:02:03.5": 3723.5, "02:03": 123.0, "0 days 00:00:01": 1.0, "2 days, 1:00:00": 176400.0, "-0:10": -10.0, " 1:1:1 ": 3661.0, "NaT": None, "": None, "12": None, "1:2:3:4": None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", clock_seconds("t").alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases | {None: None}


def test_a_batch_of_steps_costs_one_list_and_one_timer():
    """A key's state is spoken to once a batch, not once a step; an earlier step moves the one timer forward."""
    from types import SimpleNamespace

    import pandas as pd

    timers, calls = set(), []

    class State:
        def __init__(self):
            self.held = []

        def exists(self):
            return bool(self.held)

        def get(self):
            calls.append("get")
            return self.held[0] if self.held and not isinstance(self.held[0][-1], str) else iter(self.held)

        def appendList(self, rows):  # noqa: N802
            calls.append("append")
            self.held += rows

        def put(self, rows):
            self.held = list(rows)

        def update(self, row):
            self.held = [row]

        def clear(self):
            self.held = []

    handle = SimpleNamespace(getListState=lambda *_: State(), getMapState=lambda *_: State(), getValueState=lambda *_: State(), registerTimer=timers.add, deleteTimer=timers.discard)
    steps = ordered.InOrder()
    steps.init(handle)
    for base in (5_000, 1_000):
        ms = range(base, base + 1_000)
        list(steps.handleInputRows(("k",), iter([pd.DataFrame({"us": [m * 1000 for m in ms], "ms": list(ms), "step": 0, "value": "v", "at": pd.Timestamp(0)})]), None))
    assert timers == {1_000} and calls.count("append") == 2 and len(calls) <= 4
    put = pd.concat(steps.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5_499), None))
    assert put["n"].tolist() == list(range(1, 1_501)) and 5_500 in timers


def test_a_large_partition_goes_through_many_tasks(spark, monkeypatch):
    """Of a table whose rows all but a few lie in one partition, each file holds about TASK_ROWS rows, nulls and repeats kept."""
    from lapwise.sources import store

    monkeypatch.setattr(store, "TASK_ROWS", 500, raising=False)
    rows = spark.range(4_000, numPartitions=4).select(F.floor(F.col("id") / 2).alias("v"), F.when(F.col("id") > 20, "large").when(F.col("id") > 5, "small").alias("p"))
    path = root_of(spark)
    store.write_partitioned(rows, path, ["p"])
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("v", "p").collect())) == sorted(map(str, rows.collect()))
    files = back.where("p = 'large'").groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(files) >= 6 and max(r["count"] for r in files) <= 1_000
