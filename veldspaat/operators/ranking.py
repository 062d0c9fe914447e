"""Top rows per group, first rows per key, caps, seeded orders and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspaat.plans.shared import written


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark keeps ``k`` per group on each task before the shuffle, so a group that
    holds a third of all rows sends no more than that. ``order`` should be total."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null in the key are kept apart from others only by that null."""
    return top_per_group(rows, key, order, 1).drop("rank")


def last_per_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: ``new`` rows replace ``old`` ones of the same key; both must be unique by key. Nulls in keys match."""
    on = [old[c].eqNullSafe(new[c]) for c in key]
    kept = old.join(new, on, "left_anti")
    return kept.unionByName(new)


def seeded(item: Column, seed: int) -> Column:
    """A pseudo-random order that depends on the item and the seed only, the same on any cluster and in SQL."""
    return F.md5(F.concat(F.lit(f"{seed}:"), item.cast("string")))


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """All rows with their place 1, 2, ... in a total order, without a single task for all.

    Range partitions are sorted and counted apart; the counts, one per partition, are added up and broadcast. The
    table is written in between, so that both reads see the same partitions.
    """
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    placed = written(sorted_rows, "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + local).drop("_part", "_before")


def label(n: Column) -> Column:
    """Letters for 1, 2, ...: A to Z, AA to ZZ, AAA and so on, as many as the place needs: a long has at most fourteen."""
    n = n.cast("long")
    first = [(26 ** (p + 1) - 1) // 25 for p in range(14)]  # the first place whose label has a letter at p from the right

    def letter(p: int) -> Column:
        i = F.call_function("div", n - first[p], F.lit(26**p))
        return F.when(n >= first[p], F.char(ord("A") + i % 26)).otherwise("")

    return F.when(n >= 1, F.concat(*[letter(p) for p in reversed(range(14))]))


def capped(rows: DataFrame, group: list[str], order: list[Column], k: int, exempt: Column) -> DataFrame:
    """At most ``k`` rows of each group in order; exempt rows stay, and don't count."""
    free = rows.where(F.coalesce(exempt, F.lit(False)))
    bound = rows.where(~F.coalesce(exempt, F.lit(False)))
    return top_per_group(bound, group, order, k).drop("rank").unionByName(free)


def words_in(name: Column, words: list[str]) -> Column:
    """Those of ``words`` that a name contains, whatever the case."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(name), w))


def viewport(name: Column) -> Column:
    """mobile, desktop or onbekend, by a file name or address."""
    n = F.lower(name)
    return F.when(F.contains(n, F.lit("mobile")) | n.rlike(r"[_-]390(?:[x_.-]|$)"), "mobile").when(F.contains(n, F.lit("desktop")) | n.rlike(r"[_-]1440(?:[x_.-]|$)"), "desktop").otherwise("onbekend")
