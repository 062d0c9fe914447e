"""Every query on training data with SQL against DuckDB on the smallest tables; those without only run."""

import os

import pytest

from veldspaat.llm.queries import MODULES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(n for m in MODULES for n in m.SQL))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(name, FOLDER)


@pytest.mark.parametrize("name", ["p5_per_bron", "p6_passages", "p7_aandelen", "p8_scores"])
def test_runs_without_sql(spark, name):
    query = {n: q for m in MODULES for n, q in m.QUERIES.items()}[name]
    assert query(spark, FOLDER).count() > 0
