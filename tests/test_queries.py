"""Every query with an oracle agrees with DuckDB; those without give rows of a stable schema."""

import pytest

from lapwise.plans import registry
from tests.oracle import SF, check


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_oracle(spark, name):
    check(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    found = registry.QUERIES[name](spark, SF)
    assert found.columns
    assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
