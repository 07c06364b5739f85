"""Every registered query with SQL must give what DuckDB gives on the same files."""

import pytest

import compare
from conftest import SF
from registry import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, connection, name):
    assert compare.difference(QUERIES[name](spark, SF), connection, SQL[name]) is None


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() == 11
    assert set(__spark_entry__.queries()) >= set(QUERIES)
