"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
import oracle
from gridkin import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.all_queries(), catalog.all_sql()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_entry_points_hold_all_of_them():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert oracle.spark_result(QUERIES[name](spark, SF_DIR)) == oracle.sql_result(duck, SQL[name])


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["a", "b", "est", "exact"] and df.count() > 0
