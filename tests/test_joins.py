"""As-of joins cut into time slices and interval joins by an index, against plain versions, with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from lapwise.operators import joins as J


def plain_asof(left, right, fallback=True):
    out = []
    for k, t, i in left:
        own = sorted((r for r in right if r[0] == k), key=lambda r: (r[1], r[2]))
        before = [r for r in own if r[1] <= t]
        out.append((i, before[-1][3] if before else own[0][3] if own and fallback else None))
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [10, 60, 10**6])
@pytest.mark.parametrize("fallback", ["first", None])
def test_asof_equals_the_plain_version(spark, slice_rows, fallback):
    """A hot key, a key with samples only at its end, keys on one side only, equal times and ties, null keys."""
    rng = random.Random(slice_rows)
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(rng.choice(keys), rng.randrange(150), i) for i in range(400)] + [("left only", 3, 1000), ("late", 0, 1001), ("late", 500, 1002)]
    right = [(rng.choice(keys), rng.randrange(40, 120), j, f"s{j}") for j in range(150)] + [("late", 400, 900, "late one"), ("right only", 1, 901, "unused")]
    df = spark.createDataFrame(left, "k string, t long, i long").repartition(3)
    samples = spark.createDataFrame(right, "k string, at long, tie long, sample string").repartition(3)
    got = J.asof_join(df, samples, ["k"], "t", "at", ["sample"], tie="tie", fallback=fallback, slice_rows=slice_rows).select("i", "sample")
    assert sorted(map(tuple, got.collect())) == plain_asof(left, right, fallback == "first")


def test_a_hot_key_is_many_slices(spark):
    """A million rows of one key: no slice holds over three hundredths of them, and a sample is carried over many slices."""
    rows = spark.range(1_000_000, numPartitions=4).select(F.lit("hot").alias("k"), (F.xxhash64("id") % 10_000_000).alias("t"), "id")
    sizes = [r["count"] for r in J.time_slices(rows, ["k"], "t", slice_rows=100_000).groupBy("_slice").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 30_000
    samples = spark.createDataFrame([("hot", -9_999_999 * 2, 1)], "k string, at long, sample long")
    found = J.asof_join(rows, samples, ["k"], "t", "at", ["sample"], slice_rows=100_000)
    assert found.where("sample = 1").count() == 1_000_000


def test_asof_by_time_stamps(spark):
    times = spark.range(2000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("t"), "id")
    samples = spark.range(0, 20_000, 100).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("sample"))
    found = J.asof_join(times, samples, ["k"], "t", "at", ["sample"], slice_rows=100)
    assert found.where("sample <> floor(id / 10) * 100").count() == 0 and found.count() == 2000


def test_spans_equal_the_plain_join(spark):
    """Nested, touching, single-point, very long, inverted and negative spans; null keys and points."""
    rng = random.Random(2)
    spans = [("a", s, s + rng.choice([0, 1, 3, 7, 40, 900]), f"n{i}") for i, s in enumerate(rng.randrange(-200, 1000) for _ in range(150))]
    spans += [("a", -10_000, 10_000, "whole"), ("a", 10, 20, "touch1"), ("a", 20, 30, "touch2"), ("a", 50, 40, "inverted"), ("b", 0, 5, "b"), (None, 0, 5, "null"), ("a", None, 5, "open")]
    points = [("a", rng.randrange(-250, 1100), i) for i in range(300)] + [("a", 20, 1000), ("b", 5, 1001), ("b", 6, 1002), (None, 3, 1003), ("a", None, 1004), ("c", 1, 1005)]
    p, s = spark.createDataFrame(points, "k string, x long, i long"), spark.createDataFrame(spans, "k string, lo long, hi long, name string")
    wanted = sorted((i, n) for k, x, i in points for q, lo, hi, n in spans if k is not None and k == q and x is not None and lo is not None and lo <= x <= hi)
    for width in (None, 1.0, 64.0):
        assert sorted(map(tuple, J.span_join(p, s, ["k"], "x", "lo", "hi", width=width).select("i", "name").collect())) == wanted
    assert sorted(map(tuple, J.segment_join(p, s, ["k"], "x", "lo", "hi").select("i", "name").collect())) == wanted
    assert J.span_join(p, s.where("false"), ["k"], "x", "lo", "hi").count() == 0


def test_few_pairs_are_examined(spark):
    """20,000 points and 20,000 spans of one key, some of them very long: pairs tested stay near the pairs found."""
    points = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 5).alias("x"))
    spans = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 5).alias("lo"), (F.col("id") * 5 + F.when(F.col("id") % 5000 == 0, 50_000).otherwise(8)).alias("hi"))
    tested, found = J.span_candidates(points, spans, ["k"], "x", "lo", "hi").count(), J.span_join(points, spans, ["k"], "x", "lo", "hi").count()
    assert found > 40_000 and tested < 4 * found < 20_000 * 20_000 / 1000


def test_interval_join_keeps_its_slack(spark):
    spans = spark.createDataFrame([(1, 1, 4), (1, 5, 9)], "k long, start long, finish long")
    events = spark.createDataFrame([(1, s) for s in range(0, 12)], "k long, step long")
    found = J.interval_join(spans, events, ["k"], "step", "start", "finish")
    assert sorted((r["start"], r["step"]) for r in found.collect()) == [(1, s) for s in range(1, 6)] + [(5, s) for s in range(5, 11)]
