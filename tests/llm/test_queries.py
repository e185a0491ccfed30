"""Registered training-data queries against their SQL."""

import pytest

import __spark_entry__ as contract
from commlens.llm.oracles import ORACLES
from compare import connect, duckdb_result, spark_result


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tiny, name):
    names, rows = spark_result(contract.queries()[name](spark, tiny))
    expected_names, expected = duckdb_result(connect(tiny), contract.oracle_sql()[name])
    assert names == expected_names
    assert len(rows) > 0 and rows == expected


def test_pipeline_keeps_whole_documents(spark, tiny):
    pieces = contract.queries()["pipeline"](spark, tiny).cache()
    whole = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(whole) > 100 and all(r["sum(length)"] % r["max(doc_tokens)"] == 0 for r in whole)
