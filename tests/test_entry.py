"""Every query of the core with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from veldspaat.queries import citations, composed, deliveries, maintenance, retrieval, rulings

FOLDER = "/root/testdata/sf0.001"
CORE = [citations, composed, deliveries, maintenance, retrieval, rulings]
HELD = sorted(name for module in CORE for name in module.SQL)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", HELD)
def test_same_as_sql(same_as_sql, name):
    same_as_sql(name, FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["rulings_read_back", "nonverbatim_gaps"])
def test_runs_without_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.columns and df.toPandas() is not None


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(HELD) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["product", "clausule_id", "opgehaald_op", "soort"]
