import datetime as dt

from pyspark.sql import functions as F

from veldspaat.functions import addresses as a
from veldspaat.operators.profiles import first_where


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_addresses(spark):
    assert values(spark, [("/art/4:9/lid",), (None,)], "p string", a.anchor(F.col("p"))) == ["art_4_9_lid", None]
    row = [("https://w/x/", dt.date(2020, 1, 1), "/a/b")]
    assert values(spark, row, "b string, d date, p string", a.article_address(F.col("b"), F.col("d"), F.col("p"))) == ["https://w/x/2020-01-01#a_b"]


def test_bound(spark):
    rows = [("2020-1", "Uitspraak 2020 - 1", "u/", "u"), ("2020-1", "Uitspraak 2021-1", "u", "u"), ("2020-1", "2020-1", "v", "u"), ("2020-1", None, None, "u")]
    assert values(spark, rows, "n string, t string, u string, e string", a.bound(*[F.col(c) for c in "ntue"])) == [True, False, False, None]


def test_captured_and_dates(spark):
    rows = [(6000, "Welkom"), (6000, "Please VERIFY you are human"), (10, "Welkom"), (None, None), (9000, None)]
    assert values(spark, rows, "s int, t string", a.captured(F.col("s"), F.col("t"))) == [True, False, False, False, True]
    got = [tuple(v) for v in values(spark, [("2024-02-29",), ("",), (None,), ("2023-02-29",), ("1-1-2020",)], "t string", a.iso_date(F.col("t")))]
    assert got == [(dt.date(2024, 2, 29), None), (None, None), (None, None), (None, "no date: 2023-02-29"), (None, "no date: 1-1-2020")]


def test_first_where(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 5, 9, 7])] + [(2, 0, 0)], "g int, i int, v int")
    assert [(r.g, r["at"]) for r in first_where(df, group=["g"], order="i", conditions=[F.col("v") > 4, F.col("v") % 2 == 1, F.col("i") > 1]).collect()] == [(1, 2)]
