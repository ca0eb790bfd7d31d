"""Every registered query against its SQL on the smallest sample."""

import pytest
from compare import compare, connect

import __spark_entry__ as entrypoint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entrypoint.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


def test_sql_has_a_query_each():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_entry(spark):
    df = entrypoint.entry(spark)
    assert df.columns == ["client_id", "sku", "revenue", "cum_pct"] and df.count() > 0
