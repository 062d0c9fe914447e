"""Pairs of rows that share a key, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2000


def pairs_within(rows: DataFrame, key: str, item: str, times: str, *, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b for all pairs of values of ``item`` under one ``key``, with ``carry`` columns as ``x_a``, ``x_b``.

    ``times`` is the number of rows of the key. A key of more than ``block`` rows is cut into blocks by the hash of
    ``item``, and each pair of blocks is joined on its own: no task holds more than some ``2 * block`` rows of a key,
    however many it has. Rows of small keys are not repeated. Items must be unique within a key.
    """
    groups = F.ceil(F.col(times) / block).cast("int")
    cut = rows.withColumn("_groups", groups).withColumn("_block", F.pmod(F.xxhash64(item), F.col("_groups")).cast("int"))

    def side(name: str, mine: str, other: str, others) -> DataFrame:
        return cut.select(key, F.col(item).alias(name), *[F.col(c).alias(f"{c}_{name}") for c in carry], F.col("_block").alias(mine), F.explode(others).alias(other))

    left = side("a", "_i", "_j", F.sequence(F.lit(0), F.col("_groups") - 1))
    right = side("b", "_j", "_i", F.sequence(F.lit(0), F.col("_groups") - 1))
    return left.join(right, [key, "_i", "_j"]).where("a < b").drop(key, "_i", "_j")
