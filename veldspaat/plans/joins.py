"""Joins whose plan depends on checked sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that one side may have, uncompressed, to be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it holds more than this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Keys with fewer rows than this are never worth salting.
HOT_ROWS = 20_000
SALTS = 64


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value: what a string or an array really holds, 8 for anything of fixed size."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(16), lambda n, x: n + _width(x, inner).cast("int")), F.lit(16))
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.length(F.to_json(F.struct(value.alias("v")))), F.lit(0)) + 16
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """Bytes of all values of ``df``, by one aggregation; ``df`` should be a written table or a plain scan."""
    widths = [_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema]
    total = widths[0]
    for w in widths[1:]:
        total = total + w
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"]


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *, most: int | None = None) -> DataFrame:
    """Equi join that broadcasts ``right`` only if it has at most ``most`` bytes (BROADCAST_BYTES), else shuffles both sides.

    ``right`` should be a written table or a plain scan, since its bytes are added up first.
    """
    return left.join(F.broadcast(right) if bytes_of(right) <= (BROADCAST_BYTES if most is None else most) else right, on, how)


def salted_join(
    rows: DataFrame, keys: DataFrame, on: str | list[str], times: str, total: int, spread: str, how: str = "inner", *, share: float = HOT_SHARE, least: int = HOT_ROWS, salts: int = SALTS
) -> DataFrame:
    """Join, inner or left, of ``rows`` with ``keys``, one row per value of ``on``, that survives a value with a third of all rows.

    ``times`` is the column of ``keys`` with the number of rows that have the key, ``total`` the number of all rows.
    The counts add up to ``total`` at most, so no more than 1 / share keys can reach ``share * total``: that list is
    bounded whatever the data, and is the only thing broadcast. Rows of hot keys are spread over ``salts`` partitions
    by the hash of column ``spread``; the hot keys are repeated once per salt. Null keys match nothing.
    """
    on = [on] if isinstance(on, str) else on
    line = max(least, int(total * share))
    hot = keys.where(F.col(times) >= line).select(*on, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    left = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col(times) >= line, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(keys.withColumn("_salt", F.explode(copies)), [*on, "_salt"], how).drop("_salt")


def matched(
    left: DataFrame, right: DataFrame, on: list[str], left_item: str, right_item: str, *, most: int | None = None, share: float = HOT_SHARE, least: int | None = None, salts: int = SALTS
) -> DataFrame:
    """Inner join of many rows with many rows per key; both sides should be written tables or plain scans.

    ``right`` is broadcast if it has at most ``most`` bytes (BROADCAST_BYTES). Else both sides are shuffled, and a key that is hot on a side
    has its rows there spread over ``salts`` partitions by the hash of that side's item, the other side's rows of the key
    being repeated for each: no task gets more than a part of a key on either side. A side's hot keys are at most
    1 / share, whatever the data, and are the only thing broadcast then. Null keys match nothing.
    """
    if bytes_of(right) <= (BROADCAST_BYTES if most is None else most):
        return left.join(F.broadcast(right), on)
    least = HOT_ROWS if least is None else least

    def hot(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
        return F.broadcast(counts.where(F.col("_n") >= max(least, int(rows.count() * share))).select(*on, F.lit(True).alias(name)))

    marks = hot(left, "_hot_l"), hot(right, "_hot_r")

    def side(rows: DataFrame, item: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        marked = rows.join(marks[0], on, "left").join(marks[1], on, "left")
        place = F.when(F.col(own), F.pmod(F.xxhash64(item), F.lit(salts)).cast("int")).otherwise(0)
        repeats = F.when(F.col(other), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        return marked.withColumn(mine, place).withColumn(theirs, F.explode(repeats)).drop("_hot_l", "_hot_r")

    sides = side(left, left_item, "_hot_l", "_hot_r", "_i", "_j"), side(right, right_item, "_hot_r", "_hot_l", "_j", "_i")
    return sides[0].join(sides[1], [*on, "_i", "_j"]).drop("_i", "_j")
