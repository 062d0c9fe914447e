"""The version of a record that holds on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Whether a period holds on a day; an open end never ends, a missing start never begins."""
    return start.isNotNull() & (start <= day) & (day <= F.coalesce(end, F.lit(FOREVER).cast("date")))


def version_on(rows: DataFrame, *, key: list[str], day: Column, start: str, end: str, order: list[str]) -> DataFrame:
    """Of each key the row that holds on ``day``, the latest by (start, end, *order) if several do.

    The filter reaches the scan; the rest is one aggregation that is partly done before the shuffle.
    """
    held = rows.where(valid_on(day, F.col(start), F.col(end)))
    last = F.struct(F.col(start).alias("_1"), F.coalesce(F.col(end), F.lit(FOREVER).cast("date")).alias("_2"), *[F.col(c).alias(f"_{i + 3}") for i, c in enumerate(order)])
    rest = [c for c in rows.columns if c not in key]
    return held.groupBy(*key).agg(F.max_by(F.struct(*rest), last).alias("_row")).select(*key, "_row.*")
