"""Every registered query against its SQL form on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# every query is checked by `python -m checks.compare` and with TEST_ALL=1; a plain test run takes every fourth
NAMES = sorted(QUERIES) if os.environ.get("TEST_ALL") else sorted(QUERIES)[::4]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert ok, text
