"""Every registered query against its SQL on the smallest tables."""

import os

import oracle
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 6
    assert "numeric_type" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = oracle.spark_rows(QUERIES[name](spark, SF_DIR))
    if name not in SQL:
        assert rows
        return
    expected_names, expected = oracle.duck_rows(con, SQL[name])
    assert names == expected_names
    assert rows == expected
