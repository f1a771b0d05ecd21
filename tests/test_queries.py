"""Every registered query runs on the smallest tables; those with SQL must equal it."""

import pytest

import __spark_entry__ as entry
from tests.compare import connection, difference
from tests.conftest import SMALL

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows


def test_entry(spark):
    df = entry.entry(spark)
    assert {"capture", "prediction", "confidence", "method", "actions", "features"} <= set(df.columns)
    assert len(df.collect()) == 75
