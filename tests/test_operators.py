"""Hand-computed frames for edge cases."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lapwise.functions import exprs as X
from lapwise.operators import estimators as A, joins as J, mlprep as M, quality as Q, survival as V, windows as W
from lapwise.plans.validating import rank_distribution
from lapwise.sources import store as S


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_asof_takes_the_last_sample_and_falls_back(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), ("c", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("b", 4, 40.0)], "k string, s int, v double")
    found = J.asof_join(left, right, ["k"], "t", "s", ["v"])
    assert rows(found, "k", "t", "v") == [("a", 1, 20.0), ("a", 5, 50.0), ("b", 3, 40.0), ("c", 9, None)]


def test_rolling_mad_by_step_value(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 9, 8.0)], "k string, s int, v double")
    found = J.rolling_mad(df, ["k"], "s", "v", 3, floor=0.5)
    assert rows(found, "s", "roll_median", "roll_mad") == [(1, 1.0, 0.5), (2, 2.0, 1.0), (9, 8.0, 0.5)]


def test_slope_is_null_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 5.0)], "k string, x double, y double")
    assert rows(A.ols_slope(df, ["k"], "x", "y"), "k", "slope") == [("a", None), ("b", 3.0)]


def test_fixed_effects_recover_a_slope(spark):
    data = [(u, "c", float(x), 10.0 * u + 2.5 * x) for u in range(4) for x in range(8)]
    found = A.fe_slope(spark.createDataFrame(data, "u int, c string, x double, y double"), ["u"], ["c"], "x", "y").first()
    assert found["slope"] == pytest.approx(2.5) and found["units"] == 4 and found["qualified"]


def test_bivariate_fixed_effects_recover_both(spark):
    data = [(u, "c", float(x), float(x * x), 3.0 * u + 2.0 * x - 0.5 * x * x) for u in range(3) for x in range(6)]
    found = A.fe_slope2(spark.createDataFrame(data, "u int, c string, x double, z double, y double"), ["u"], ["c"], "x", "z", "y").first()
    assert found["slope_x"] == pytest.approx(2.0) and found["slope_z"] == pytest.approx(-0.5)


def test_kaplan_meier_reaches_zero_and_stays(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 2, False), ("a", 3, True)], "k string, t int, e boolean")
    found = rows(V.km_curve(df, ["k"], "t", "e"), "t", "survival")
    assert [t for t, _ in found] == [1, 2, 3] and found[0][1] == pytest.approx(0.75) and found[1][1] == pytest.approx(0.5) and found[2][1] == 0.0


def test_cliff_needs_a_streak(spark):
    steady = [("a", i, 1.0) for i in range(1, 7)] + [("a", 7, 3.0), ("a", 8, 3.0)]
    single = [("b", i, 1.0) for i in range(1, 7)] + [("b", 7, 3.0), ("b", 8, 1.0)]
    found = V.detect_cliff(spark.createDataFrame(steady + single, "u string, s int, v double"), ["u"], "s", "v")
    assert rows(found, "u", "cliff") == [("a", 7), ("b", None)]


def test_causality_finds_the_feature_that_looks_ahead(spark):
    df = spark.createDataFrame([(i, i, float(i)) for i in range(1, 9)], "id int, s int, v double").withColumn("u", F.lit("x"))
    build = lambda x: x.withColumns({"before": F.lag("v").over(W.over(["u"], ["s"])), "after": F.lead("v").over(W.over(["u"], ["s"]))})
    found = Q.assert_causal(build, df, "id", "s", [4], ["before", "after"])
    assert {r["feature"] for r in found.collect()} == {"after"}


def test_normal_cdf(spark):
    got = spark.createDataFrame([(-1.96,), (0.0,), (1.96,)], "x double").select(X.normal_cdf("x")).collect()
    assert [r[0] for r in got] == pytest.approx([0.0249979, 0.5, 0.9750021], abs=1e-6)


def test_argmax_ties_take_the_first(spark):
    got = spark.createDataFrame([(1.0, -1.0, None), (None, 0.5, 2.0)], "a double, b double, c double").select(X.argmax_label({k: F.col(k) for k in "abc"}).alias("l")).collect()
    assert [r["l"] for r in got] == ["a", "c"]


def test_rank_distribution_is_doubly_stochastic(spark):
    df = spark.createDataFrame([("r", e, float(e), 1.0) for e in range(4)], "c string, e int, mu double, se double")
    found = rank_distribution(df, ["c"], "e", "mu", "se", 300).cache()
    for key in ("e", "position"):
        assert all(math.isclose(r["s"], 1.0) for r in found.groupBy(key).agg(F.sum("p").alias("s")).collect())


def test_encoder_gives_minus_one_to_the_unknown(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    got = M.encode(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "v string"), M.fit_encoder(train, "v"), "v", "code")
    assert rows(got, "v", "code") == sorted([("a", 0), ("b", 1), ("z", -1), (None, -1)], key=str)


def test_schema_is_enforced(spark):
    with pytest.raises(ValueError, match="missing"):
        M.enforce_schema(spark.range(1))


def test_single_file_gate(spark, tmp_path):
    assert S.write_single(spark.range(10), f"file://{tmp_path}/a") > 0
    with pytest.raises(ValueError, match="more than"):
        S.write_single(spark.range(10), f"file://{tmp_path}/b", max_bytes=1)


def test_the_rest_does_not_import_the_optional_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lapwise")
    for folder, _, names in os.walk(root):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                assert "lapwise.llm" not in open(os.path.join(folder, name)).read()


def test_asof_of_one_long_key_is_linear(spark):
    """Fifty thousand rows of one key: a frame that is built anew for every row would not end."""
    left, right = spark.range(50_000).selectExpr("1 AS k", "id * 2 AS t"), spark.range(100, 50_000).selectExpr("1 AS k", "id * 2 - 1 AS s", "id AS v")
    found = J.asof_join(left, right, ["k"], "t", "s", ["v"])
    assert found.where("v <> greatest(t / 2, 100)").count() == 0 and found.count() == 50_000


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9995, 1.0])
def test_exact_quantile(spark, p):
    import numpy as np

    for values in ([3.0], [1.0, 2.0], [5.0] * 1000 + [1.0, 9.0], list(np.random.default_rng(0).normal(size=30_001))):
        found = A.exact_quantile(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v", p)
        assert found == pytest.approx(np.quantile(values, p))
    assert A.exact_quantile(spark.createDataFrame([], "v double"), "v", p) is None


def test_permuted_keeps_values_and_moves_them(spark):
    df = spark.range(3000).selectExpr("id", "id * 10 AS v")
    found = M.permuted(df, "v", "id", bin_rows=500)
    assert sorted(r["v"] for r in found.collect()) == [10 * i for i in range(3000)] and found.where("v = id * 10").count() < 100
    assert rows(found, "id", "v") == rows(M.permuted(df.repartition(7), "v", "id", bin_rows=500), "id", "v")


def test_features_that_leak_are_refused():
    import types

    spec = M.FeatureSpec({"state": ["pos", "load"], "who": ["code", "next_jump"]}, leaky=frozenset({"next_jump"}), masks={"remaining": ["pos"]})
    with pytest.raises(ValueError, match="next_jump"):
        spec.features(types.SimpleNamespace(columns=["pos", "load", "code", "next_jump"]), "remaining")
    assert spec.features(types.SimpleNamespace(columns=["pos", "load", "code"]), "remaining") == ["load", "code"]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS v")
    base = M.fingerprint(df).first()
    assert base == M.fingerprint(df.orderBy("v").select("v", "id")).first() != M.fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 9).otherwise(F.col("v")))).first()


def test_conformal_widens_by_the_order_statistic(spark):
    data = [(i, float(i % 50)) for i in range(400)]
    found = M.conformal(spark.createDataFrame(data, "id long, y double").withColumns({"lo": F.lit(20.0), "hi": F.lit(30.0)}), "y", "lo", "hi", "id").first()
    marked = spark.createDataFrame(data, "id long, y double").withColumn("cal", M.half("id")).collect()
    scores = sorted(max(20.0 - r["y"], r["y"] - 30.0) for r in marked if r["cal"])
    widen = scores[min(math.ceil((len(scores) + 1) * 0.8), len(scores)) - 1]
    test = [r["y"] for r in marked if not r["cal"]]
    assert found["widen"] == pytest.approx(widen) and found["raw"] == pytest.approx(sum(20 <= y <= 30 for y in test) / len(test))
    assert found["calibrated"] == pytest.approx(sum(20 - widen <= y <= 30 + widen for y in test) / len(test))


def test_finish_summary_adds_up(spark):
    from lapwise.plans.validating import finish_summary

    df = spark.createDataFrame([("r", e, float(e), 2.0 if e else None) for e in range(6)], "race string, e int, mu double, se double")
    found = sorted(finish_summary(df, ["race"], "e", "mu", "se", 3000).collect(), key=lambda r: r["e"])
    assert sum(r["expected"] for r in found) == pytest.approx(21) and sum(r["p_win"] for r in found) == pytest.approx(1) and sum(r["p_podium"] for r in found) == pytest.approx(3)
    assert found[5]["p_beats_next"] is None and all(0.5 < r["p_beats_next"] <= 1 for r in found[:5])
    places = rank_distribution(df, ["race"], "e", "mu", "se", 3000).groupBy("e").agg(F.sum(F.col("position") * F.col("p")).alias("x")).collect()
    assert {r["e"]: r["x"] for r in places} == pytest.approx({r["e"]: r["expected"] for r in found})


def test_bootstrap_interval_holds_the_gap(spark):
    from lapwise.plans.validating import bootstrap_mean_gap

    df = spark.createDataFrame([(i, i % 2 == 0, float(i % 5) + (3.0 if i % 2 == 0 else 0.0)) for i in range(300)], "u int, flag boolean, e double")
    found = bootstrap_mean_gap(df, "u", "flag", "e", 400).first()
    assert found["gap"] == pytest.approx(3.0, abs=0.1) and found["lo"] < found["gap"] < found["hi"] and found["hi"] - found["lo"] == pytest.approx(4 * (2 / 150 + 2 / 150) ** 0.5, rel=0.25)


def test_envelope_takes_the_training_range(spark):
    train = spark.createDataFrame([(1.0, 5), (3.0, 9)], "a double, b int")
    df = spark.createDataFrame([(1, 1.0, 9), (2, 0.5, 6), (3, 2.0, 10), (4, None, 6)], "id int, a double, b int")
    assert rows(M.envelope(df, train, ["a", "b"]), "id", "in_envelope") == [(1, True), (2, False), (3, False), (4, False)]
