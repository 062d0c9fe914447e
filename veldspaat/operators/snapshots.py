"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.plans.shared import written

#: Snapshot dates that are held as a list: days of 270 years.
MAX_DATES = 100_000


def row_hash(columns: list[Column]) -> Column:
    """128-bit hash of the values in order, as a struct of two longs, the second hashed from another seed.

    A null differs from every value, and from a null elsewhere.
    """
    values = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("0")) for c in columns]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def _calendar(df: DataFrame, spark: SparkSession) -> DataFrame:
    """(_at, _next) of the snapshots in order; broadcast while the dates are few, which DATE values are."""
    dates = sorted(r[0] for r in df.select("_at").distinct().where("_at is not null").limit(MAX_DATES + 1).collect())
    if len(dates) > MAX_DATES:
        raise ValueError(f"more than {MAX_DATES} snapshots: these aren't full deliveries dated by day")
    schema = T.StructType([T.StructField("_at", T.DateType()), T.StructField("_next", T.DateType())])
    return F.broadcast(spark.createDataFrame(list(zip(dates, dates[1:], strict=False)), schema))


def snapshot_changes(
    df: DataFrame,
    *,
    keys: Mapping[str, Column],
    snapshot: str,
    version: str,
    content: list[Column],
    imprint: list[Column],
    kinds: tuple[str, str, str, str] = ("added", "removed", "changed", "reprinted"),
) -> DataFrame:
    """Changes of each snapshot against the one before it: (*keys, snapshot, kind).

    ``keys`` names the canonical key expressions, ``content`` the canonical values whose change makes a record changed,
    ``imprint`` those whose change alone makes it reprinted. Of several rows of one key in one snapshot the one with
    the latest ``version`` counts; a tie goes to the larger hash, whatever the order of the rows. The snapshots are the
    distinct dates in ``snapshot``; rows without a date belong to none. The first snapshot has nothing to be compared
    with. A null key is a key of its own, a null version the oldest. Two nulls are equal, null and a value aren't.
    An empty table, or one snapshot, gives no rows.

    The texts are read and hashed once, into a written table of keys and hashes; both sides of the comparison are read
    from there. Each side is reduced to one row per key before and after its shuffle, on just the columns of the full
    outer join, which adds no exchange: a key that holds a third of all rows comes down to one row per task first.
    """
    names = list(keys)
    null = [f"_null_{k}" for k in names]
    rows = df.select(
        *[F.coalesce(c, F.lit("")).alias(k) for k, c in keys.items()],
        *[c.isNull().alias(f"_null_{k}") for k, c in keys.items()],
        F.col(snapshot).cast("date").alias("_at"),
        F.struct(F.col(version).alias("version"), row_hash(content).alias("content"), row_hash(imprint).alias("imprint")).alias("_row"),
    )
    rows = written(rows.where("_at is not null"), "snapshots-hashed")
    calendar = _calendar(rows.select("_at"), df.sparkSession)
    on = ["_at", *names, *null]

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.max("_row").alias(name))

    after = side(rows.join(calendar.select(F.col("_next").alias("_at")), "_at"), "_after")
    before = side(rows.join(calendar, "_at").withColumn("_at", F.col("_next")), "_before")
    added, removed, changed, reprinted = kinds
    kind = (
        F.when(F.col("_before").isNull(), added)
        .when(F.col("_after").isNull(), removed)
        .when(F.col("_before.content") != F.col("_after.content"), changed)
        .when(F.col("_before.imprint") != F.col("_after.imprint"), reprinted)
    )
    return (
        after.join(before, on, "full")
        .withColumn("_kind", kind)
        .where("_kind is not null")
        .select(*[F.when(~F.col(n), F.col(k)).alias(k) for k, n in zip(names, null, strict=True)], F.col("_at").alias(snapshot), F.col("_kind").alias("kind"))
    )
