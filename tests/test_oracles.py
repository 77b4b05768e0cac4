"""Every named query beside its SQL on the smallest tables, as far as these are there."""

import os

import pytest

from tests.compare import compare, duck
from tidewatch.plans.queries import ORACLES, QUERIES

#: Queries that find nothing on the smallest tables.
EMPTY: set[str] = set()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    spark_rows, sql_rows = compare(spark, con, QUERIES[name], ORACLES[name], DATA)
    assert spark_rows == sql_rows
    assert spark_rows[1] or name in EMPTY


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_without_sql(spark):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, DATA).count() > 0
