import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(pdf):
    """Rows in any order, columns by name, as text that is equal where values are."""
    out = []
    for row in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False):
        out.append(repr([None if x is None or x != x else round(x, 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in row]))
    return sorted(out)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Runs a registered query over the tables of a folder and compares it with its SQL."""
    import duckdb

    import __spark_entry__ as entry

    queries, sql, connections = entry.queries(), entry.oracle_sql(), {}

    def compare(name, folder):
        if folder not in connections:
            connections[folder] = duckdb.connect()
            for file in os.listdir(folder):
                connections[folder].execute(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
        got, want = queries[name](spark, folder).toPandas(), connections[folder].execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return compare
