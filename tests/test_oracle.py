"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duck

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_sql_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
