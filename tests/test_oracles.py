"""Every query that SQL can say gives the SQL's rows."""

import pytest

from strata.plans import ORACLES, QUERIES
from tests.oracle import SF, connect, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
