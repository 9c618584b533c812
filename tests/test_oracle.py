"""Every registered report against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_harness import compare, duck

from conftest import SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
SLOW = {"m07_linear_baseline_report"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, n, _, _, detail = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert ok, detail


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "statistical_significance" in df.columns
