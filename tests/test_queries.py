import pytest

from corpusmill.plans.oracle import oracle_sql
from corpusmill.plans.queries import queries

from .oracle import connected, same


@pytest.fixture(scope="module")
def con(sf):
    return connected(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    same(con, queries()[name](spark, sf), oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries().keys() - oracle_sql().keys()))
def test_query_without_sql_runs(spark, sf, name):
    df = queries()[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert oracle_sql().keys() <= queries().keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
