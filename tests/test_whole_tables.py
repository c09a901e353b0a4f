"""Queries of one week, compound, flag or tenth have one beside them over the whole table."""

from lapwise.plans import registry
from lapwise.plans.registration import table
from tests.oracle import SF

NAMES = ["b01_component_averages", "b04_gantt", "b05_survival_curve", "b06_scenario_standings", "o03_top_k", "st01_event_payloads"]


def test_whole_tables(spark):
    assert {f"{n}_whole" for n in NAMES} <= set(registry.QUERIES) & set(registry.ORACLES)
    assert registry.QUERIES["st01_event_payloads_whole"](spark, SF).count() == table(spark, SF, "events").count()
