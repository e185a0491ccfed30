"""Every query with a SQL equivalent must give DuckDB's rows."""

import pytest

import __spark_entry__ as contract
from compare import connect, duckdb_result, spark_result

QUERIES = contract.OWN_QUERIES
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}
MODEL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert MODEL == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    names, rows = spark_result(QUERIES[name](spark, small))
    expected_names, expected = duckdb_result(duck, ORACLES[name])
    assert names == expected_names
    assert len(rows) > 0 and rows == expected


def test_entry(spark):
    assert contract.entry(spark).count() == 10
