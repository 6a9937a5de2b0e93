"""Every registered query against its SQL, on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# long jobs without SQL have tests of their own on fixtures
LONG = {"run_sweep", "subspace", "time_profile", "forecast_best", "forecast_gbt", "forecast_forest", "elastic_runs", "gmm"}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, small, name):
    assert compare(spark, duck, small, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).limit(1).count() == 1


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
