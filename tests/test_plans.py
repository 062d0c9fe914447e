from pyspark.sql import functions as F

from veldspaat.plans.joins import bytes_of, matched, salted_join, sized_join
from veldspaat.plans.pairs import pairs_within
from veldspaat.plans.shared import release, shared_folder, written
from veldspaat.sources.tables import spread


def test_written_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    out = written(df, "t", sort=["b"])
    assert out.schema == df.schema and sorted(out.collect()) == sorted(df.collect())
    empty = written(df.where("a > 5"), "t")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    assert shared_folder(spark)
    assert release(spark) >= 2


def test_salted_join_equals_join_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 1")
    got = salted_join(rows, keys, "k", "n", 3000, "id", share=0.1, least=10, salts=8)
    assert sorted(map(tuple, got.select("k", "id", "n").collect())) == sorted(map(tuple, rows.join(keys, "k").select("k", "id", "n").collect()))


def test_sized_join_both_ways(spark):
    a, b = spark.range(100).withColumn("x", F.lit(1)), spark.range(50)
    assert bytes_of(b) == 400
    assert sized_join(a, b, ["id"], most=399).count() == sized_join(a, b, ["id"], most=400).count() == 50
    assert "BroadcastHashJoin" in sized_join(a, b, ["id"], most=400)._jdf.queryExecution().toString()


def test_bytes_of_values(spark):
    df = spark.createDataFrame([("abcd", [1, 2], ["é", None], None, 1), (None, None, None, {"x": 1}, None)], "s string, a array<int>, t array<string>, m map<string,int>, n int")
    assert bytes_of(df.select("s")) == 36 and bytes_of(df.select("a")) == 16 + 16 + 16 and bytes_of(df.select("n")) == 16
    assert bytes_of(df.select("t")) == 16 + 18 + 16 + 16 and bytes_of(df.select("m")) > 32
    assert bytes_of(df.where("n > 5")) == 0


def test_matched_equals_join_with_hot_keys_on_both_sides(spark):
    left = spark.range(900).select(F.when(F.col("id") < 300, 1).when(F.col("id") > 890, F.lit(None)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    right = spark.range(400).select(F.when(F.col("id") < 130, 1).when(F.col("id") > 390, F.lit(None)).otherwise(F.col("id") % 70).alias("k"), F.col("id").alias("y"))
    want = sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    for kind in ({"most": 0, "share": 0.1, "least": 10, "salts": 4}, {"most": 1 << 20}):
        assert sorted(map(tuple, matched(left, right, ["k"], "x", "y", **kind).select("k", "x", "y").collect())) == want


def test_pairs_in_blocks_equal_all_pairs(spark):
    rows = spark.range(120).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 7).cast("int").alias("k"), "id").where("k is not null")
    rows = rows.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    got = pairs_within(rows, "k", "id", "n", block=9)
    want = rows.alias("x").join(rows.alias("y"), "k").where("x.id < y.id").count()
    assert got.count() == got.distinct().count() == want


def test_spread_only_small_scans(spark):
    df = spark.range(10, numPartitions=1)
    assert spread(df, "id").rdd.getNumPartitions() == 4
    assert spread(spark.range(10, numPartitions=9), "id").rdd.getNumPartitions() == 9
