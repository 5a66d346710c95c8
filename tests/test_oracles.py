"""Every registered query with SQL, against DuckDB; every other one runs and has a stable schema."""

import os

import pytest

import __spark_entry__ as entry
from tests import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", [n for n, f in QUERIES.items() if ".llm." not in f.__module__])
def test_query(spark, con, small, name):
    text, ok = compare.compare(spark, con, small, name, QUERIES[name], SQL.get(name))
    assert ok, text


def test_typed_columns(spark, con, small):
    from strataframe.plans import problems

    text, ok = compare.compare(spark, con, small, "p4_wide", problems.p4_wide, problems.WIDE_SQL)
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1 or not os.path.exists("/root/testdata")
    assert set(SQL) <= set(QUERIES)
