"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as driver
from compare import difference, oracle_connection
from plyclock.plans.queries import QUERIES as OWN

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(OWN) <= set(QUERIES)
    assert set(OWN) <= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["outcome", "label", "count", "mean", "std"]
    assert result.count() == 6
