"""Every registered query at the smallest scale, against DuckDB where SQL can say it."""

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
QUERIES, CHECKS = driver.queries(), driver.oracle_sql()
SLOW = {"p07_random_forest", "p08_boosted_trees", "p12_feature_importance"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, con, name):
    assert oracle.compare(spark, con, FOLDER, QUERIES[name], CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["site", "avg_unit_price", "avg_deal_score", "n_listings"]
    assert rows.count() > 0
