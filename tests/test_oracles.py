"""Registered queries vs their DuckDB oracle SQL (sf0.001)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from facsimile.plans import catalog
from oracle_harness import check

# every query with SQL except those of the optional training-data subpackage, whose tests are its own
NAMES = sorted(n for n in entry.oracle_sql() if n in catalog.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    ok, msg = check(spark, name, SF_SMALL)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "contract_balance" in df.columns
