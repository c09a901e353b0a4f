"""Exact grouped quantiles against percentile, on skewed keys, ties and nulls."""

import pytest
from pyspark.sql import functions as F

from lapwise.operators.quantiles import grouped_quantiles

SHARES = {"low": 0.1, "mid": 0.5, "late": 0.75, "most": 0.99, "all": 1.0, "least": 0.0}


def same(df, by, accuracy):
    found = {tuple(r[b] for b in by): tuple(r[n] for n in SHARES) for r in grouped_quantiles(df, by, "v", SHARES, accuracy=accuracy).collect()}
    wanted = {tuple(r[b] for b in by): tuple(r[n] for n in SHARES) for r in df.where("v IS NOT NULL").groupBy(*by).agg(*[F.percentile("v", p).alias(n) for n, p in SHARES.items()]).collect()}
    assert found.keys() == wanted.keys()
    for key, values in wanted.items():
        assert found[key] == pytest.approx(values, rel=1e-12, abs=1e-12), key


@pytest.mark.parametrize("accuracy", [20, 100, 2000])
def test_equal_to_percentile(spark, accuracy):
    """One key of most rows, heavy tails, many ties, small keys, a null key, null values and a key of nulls alone."""
    i = F.col("id")
    rows = spark.range(60_000, numPartitions=7).select(
        F.when(i % 3 < 2, "hot").when(i % 97 == 0, None).otherwise(F.concat(F.lit("k"), (i % 40).cast("string"))).alias("k"),
        F.when(i % 11 == 0, None).when(i % 5 == 0, F.lit(7.0)).when(i % 7 == 0, F.exp((F.xxhash64("id") % 300).cast("double"))).otherwise((F.xxhash64("id", F.lit(1)) % 100_000) / 7).alias("v"),
    )
    rows = rows.unionByName(spark.createDataFrame([("none", None), ("one", 3.5), ("two", 1.0), ("two", 2.0)], "k string, v double"))
    same(rows, ["k"], accuracy)


def test_two_keys_and_no_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), F.sin("id").alias("v"))
    same(rows, ["a", "b"], 25)
    assert grouped_quantiles(rows.where("false"), ["a"], "v", {"mid": 0.5}).count() == 0


def test_no_buffer_holds_a_key(spark):
    """The plan has no percentile buffer, and of a hot key's distinct values only a few per cent are put in order."""
    rows = spark.range(200_000, numPartitions=4).select(F.lit("hot").alias("k"), F.rand(3).alias("v"))
    plan = grouped_quantiles(rows, ["k"], "v", {"mid": 0.5}, accuracy=500)
    assert "percentile(" not in plan._jdf.queryExecution().optimizedPlan().toString().replace("percentile_approx(", "")
    assert abs(plan.first()["mid"] - rows.agg(F.percentile("v", 0.5)).first()[0]) < 1e-15
