"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from cordwood.plans.oracle import ORACLE_SQL
from cordwood.plans.registry import QUERIES

from .compare import difference, duck, run_spark, run_sql

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    found = run_spark(spark, QUERIES[name], SF_DIR)
    assert difference(found, run_sql(connection, ORACLE_SQL[name])) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["start", "group", "count"]
