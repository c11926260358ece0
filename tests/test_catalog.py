"""Registered queries against their comparison SQL on the smallest tables."""

import compare
import pytest

from catalog import registry

QUICK = sorted(set(registry.ORACLES) - {"factorial", "feedback_rounds", "local_difficulty", "effect_modifiers", "routing_delta"})


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", QUICK)
def test_equal_to_sql(spark, small, con, name):
    assert compare.mismatch(registry.QUERIES[name](spark, small), con, registry.ORACLES[name]) is None


def test_every_comparison_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
