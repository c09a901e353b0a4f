"""Fitted parameters, sensitivities and the uncertainty of an order, on planted cases."""

import math
import random

from pyspark.sql import functions as F

from lapwise.operators import fitting, recombining

DEFAULTS = {"SOFT": (9.0, 2.0, 0.05), "HARD": (13.0, 1.0, 0.02)}


def unit_rows(name, place, compound, season, cliff, rise, gradient, n=20):
    """A unit whose value rises by gradient a step and by rise at and after the cliff."""
    return [(name, place, compound, season, k, 90 + gradient * k + (rise if cliff and k >= cliff else 0.0)) for k in range(1, n + 1)]


def fit(spark, rows, **options):
    df = spark.createDataFrame(rows, "unit string, place string, compound string, season long, pos long, value double").repartition(3)
    found = fitting.fit_hierarchy(df, ["unit"], ["place", "compound", "season"], ["place", "compound"], "compound", "pos", "value", defaults=DEFAULTS, min_units=4, min_pool_rows=100, min_curve_units=4, min_events=2, **options)
    return {(r["place"], r["compound"], r["season"]): r for r in found.collect()}


def test_cells_pools_and_defaults(spark):
    """A full cell is recovered; a thin one takes its pool's fit; a lone one its kind's defaults, each with its reason."""
    rows = [r for i in range(6) for r in unit_rows(f"a{i}", "x", "SOFT", 1, 12, 3.0, 0.1)]
    rows += unit_rows("b", "x", "SOFT", 2, 12, 3.0, 0.1) + unit_rows("c", "y", "SOFT", 1, 8, 3.0, 0.1) + unit_rows("short", "x", "SOFT", 2, None, 0, 0.1, n=2)
    found = fit(spark, rows)
    cell, pool, default = found["x", "SOFT", 1], found["x", "SOFT", 2], found["y", "SOFT", 1]
    assert (cell["source"], cell["n_units"], cell["onset"]) == ("cell", 6, 12.0) and abs(cell["gradient"] - 0.1) < 1e-9
    assert abs(cell["severity"] - (3.0 + 0.1 * 5.5)) < 1e-9  # six steps from the cliff against five before it
    assert (pool["source"], pool["n_units"], pool["onset"]) == ("pool", 1, 12.0) and "used 7 of the pool" in pool["notes"]
    assert (default["source"], default["onset"], default["severity"], default["gradient"]) == ("default", 9.0, 2.0, 0.05)


def test_values_out_of_range_become_defaults(spark):
    rows = [r for i in range(5) for r in unit_rows(f"a{i}", "x", "HARD", 1, 4, 30.0, 2.0)]
    found = fit(spark, rows, rise=5.0)["x", "HARD", 1]
    assert (found["source"], found["onset"], found["severity"], found["gradient"]) == ("cell", 5.0, 1.0, 0.02)


def test_hinge_finds_who_wears_earlier(spark):
    """Of five groups one falls off by more past the fitted onset: its shift is negative, the others' near zero."""
    rng, rows = random.Random(4), []
    for g in range(5):
        for u in range(8):
            level = rng.random()
            rows += [(g, "S", f"{g}-{u}", k, level + 0.02 * k + (0.30 if g == 3 else 0.10) * max(k - 10, 0) + rng.gauss(0, 0.02), 10.0) for k in range(1, 21)]
    df = spark.createDataFrame(rows, "grp long, compound string, unit string, pos long, residual double, onset double")
    severities = spark.createDataFrame([("S", 1.0)], "compound string, severity double")
    found = {r["grp"]: r for r in fitting.hinge_sensitivity(df, severities, ["unit"], ["grp", "compound"], ["compound"], "pos", "residual", "onset").collect()}
    assert found[3]["qualified"] and found[3]["shift"] < -0.7 and all(0 < found[g]["shift"] < 0.3 for g in (0, 1, 2, 4))
    assert abs(found[3]["hinge"] - 0.30) < 0.02 and found[3]["n_post"] == 80 and not found[3]["clipped"]
    few = fitting.hinge_sensitivity(df.where("pos <= 11"), severities, ["unit"], ["grp", "compound"], ["compound"], "pos", "residual", "onset").collect()
    assert all(not r["qualified"] and r["shift"] == 0 and r["shift_se"] is None for r in few)


PARTS = "scenario string, e long, is_self boolean, place long, actual_place long, mu double, n long, own_var double, slope_term double, cliff_term double, pace_se double"


def order(spark, pace_se, slope):
    rows = [("s", i, False, i + 1, i + 1, 90 + 0.1 * i, 50, 0.01, slope, 0.05 * i, pace_se) for i in range(4)] + [("lone", 9, True, 1, 1, 90.0, 3, 0.1, slope, 0.0, pace_se)]
    return {(r["scenario"], r["e"]): r for r in recombining.scenario_order(spark.createDataFrame(rows, PARTS), ["scenario"], "e").collect()}


def test_what_both_share_cancels(spark):
    """A huge shared error moves no pair probability; a differing exposure does. The last place and a lone entity have no next."""
    small, huge = order(spark, 0.0, 0.0), order(spark, 1e6, 1e6)
    for key, row in small.items():
        assert row["p_beats_next"] == huge[key]["p_beats_next"] and row["place_sd"] == huge[key]["place_sd"]
    sd = math.sqrt(0.02 + 0.05**2)
    assert abs(small["s", 0]["p_beats_next"] - 0.5 * (1 + math.erf(0.1 / sd / math.sqrt(2)))) < 1e-6
    assert small["s", 3]["p_beats_next"] is None and small["lone", 9]["place_sd"] is None


def test_parts_of_the_variance(spark):
    """Own parts and shared terms by hand, coverage against the longest entity, low-confidence rows left out."""
    row = lambda e, predicted, confidence: ("s", e, 1, 2, predicted, predicted, 0.3, 0.1, 0.2, 0.5, 0.4, 10.0, 2.0, 1.0, 0.0, confidence)
    names = "scenario string, e long, grp long, host long, actual double, predicted double, pace_se double, host_slope_sd double, own_slope_sd double, host_shift_se double, own_shift_se double, age double, severity double, host_active double, own_active double, confidence double"
    rows = [row(1, v, 0.8) for v in (90.0, 91.0, 92.0, 93.0)] + [row(2, 95.0, 0.8), row(2, 1000.0, 0.1)]
    found = {r["e"]: r for r in recombining.propagate_se(spark.createDataFrame(rows, names), ["scenario"], "e", "grp").collect()}
    one, two = found[1], found[2]
    assert abs(one["own_var"] - (2.0**2 + (5 / 3) / 4)) < 1e-9 and one["slope_term"] == 1.0 and one["cliff_term"] == 1.0
    assert abs(one["se"] - math.sqrt(one["own_var"] + 0.09 + 1 + 1)) < 1e-9
    assert two["n"] == 1 and two["coverage"] == 0.25 and two["short_run"] and two["mu"] == 95.0 and abs(two["confidence"] - 0.4) < 1e-12 and not two["is_self"]


def test_a_fit_reads_bounded_tasks(spark, monkeypatch):
    """However the rows were made, no task of a fit holds more than about FIT_ROWS of them; a rerun deals them alike."""
    from lapwise.plans import learning

    monkeypatch.setattr(learning, "FIT_ROWS", 50)
    d = "/root/testdata/sf0.001"
    parts = lambda: [[r["event_id"] for r in part] for part in learning.jump_rows(spark, d)[0].select("event_id").rdd.glom().collect()]
    found = parts()
    assert sum(map(len, found)) > 400 and max(map(len, found)) <= 100 and len(found) >= 9
    assert parts() == found


def test_squared_correlation_of_constant_units(spark):
    """A unit whose values do not vary has no correlation and stops nothing; others have corr's."""
    from lapwise.operators import estimators

    rows = spark.createDataFrame([(u, float(x), y) for u, ys in ((1, (5.0, 5.0, 5.0)), (2, (1.0, 2.0, 4.0)), (3, (None, 2.0, None))) for x, y in enumerate(ys)], "u long, x double, y double")
    found = {r["u"]: r["r2"] for r in rows.groupBy("u").agg(estimators.r_squared("x", "y").alias("r2")).collect()}
    assert found[1] is None and found[3] is None and abs(found[2] - 0.9642857142857143) < 1e-12


def test_the_chain_reads_its_panel_once(spark):
    """The events are scanned when the panel is written, not again by what is built on it."""
    from lapwise.plans import explaining, marts, testbed

    d = "/root/testdata/sf0.001"
    for rows in (explaining.panel(spark, d), marts.decomposition(testbed.panel_e(spark, d))):
        assert rows.inputFiles() and not any("events.parquet" in f for f in rows.inputFiles())
