"""Window operators on ordered rows: runs, trailing against following means, steepest steps, band statistics.

A group of any size is cut into stretches of consecutive rows first, so that no window holds more than a stretch: one
busy group isn't one task. What a stretch needs of its neighbours is carried over as a few border rows or sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspaat.plans.shared import written


def stretches(rows: DataFrame, *, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``_part``: range partitions in the order of group and order, written, so that a part holds
    consecutive rows of each of its groups. ``order`` must be total within a group."""
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    return written(placed, "stretches")


def _with_rows_before(placed: DataFrame, *, group: list[str], order: list[str], back: int) -> DataFrame:
    """The rows of each stretch and, marked ``_ghost``, the last ``back`` rows of its group before it.

    Each stretch hands on at most ``back`` rows, and none needs more than its ``back`` predecessors.
    """
    columns = [c for c in placed.columns if c != "_part"]
    last = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*[F.desc(c) for c in order]))
    row = F.struct(*order, *[c for c in columns if c not in order])
    tails = placed.withColumn("_last", last).where(F.col("_last") <= back).groupBy(*group, "_part").agg(F.array_sort(F.collect_list(row)).alias("_tail"))
    before = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(-back, -1)))
    ghosts = tails.select("_part", F.slice(before, F.greatest(F.size(before) - back + 1, F.lit(1)), back).alias("_before"))
    ghosts = ghosts.select("_part", F.inline("_before")).select(*columns, "_part", F.lit(True).alias("_ghost"))
    return placed.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def runs(rows: DataFrame, *, group: list[str], order: list[str], state: Column, parts: int | None = None) -> DataFrame:
    """(*group, state, start, n): longest stretches of equal state; two nulls are equal.

    Runs are found within each part of a group; only the first and the last run of a part can go on in another, and only
    these are brought together.
    """
    placed = stretches(rows.select(*group, *order, state.alias("_state")), group=group, order=order, parts=parts)
    here = Window.partitionBy(*group, "_part").orderBy(*order)
    new = F.when((F.row_number().over(here) == 1) | ~F.lag("_state").over(here).eqNullSafe(F.col("_state")), 1).otherwise(0)
    islands = placed.withColumn("_new", new).withColumn("_island", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    found = islands.groupBy(*group, "_part", "_island", "_state").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n"))
    found = written(found.withColumn("_border", F.col("_island").isin(1) | (F.col("_island") == F.max("_island").over(Window.partitionBy(*group, "_part")))), "runs")
    across = Window.partitionBy(*group).orderBy("_part", "_island")
    goes_on = (F.col("_island") == 1) & F.lag("_state").over(across).eqNullSafe(F.col("_state")) & (F.row_number().over(across) > 1)
    border = found.where("_border").withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    joined = border.groupBy(*group, "_run", "_state").agg(F.min("_first").alias("_first"), F.sum("n").alias("n")).drop("_run")
    whole = found.where("not _border").select(*joined.columns).unionByName(joined)
    return whole.select(*group, F.col("_state").alias("state"), F.col(f"_first.{order[0]}").alias("start"), "n")


def trailing_and_following(rows: DataFrame, *, group: list[str], order: list[str], value: str, back: int, parts: int | None = None) -> DataFrame:
    """Rows with ``before``, the mean of the ``back`` rows before, and ``after``, the mean from the row on to the end.

    The mean to the end is a running sum from the end, so time grows with the rows; later parts of the group come in as
    one sum and one count each.
    """
    placed = stretches(rows, group=group, order=order, parts=parts)
    sums = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    later = Window.partitionBy(*group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    rest = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_gp"), F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_later_s"), F.coalesce(F.sum("_c").over(later), F.lit(0)).alias("_later_c"))
    here = Window.partitionBy(*group, "_part")
    back_rows = here.orderBy(*order).rowsBetween(-back, -1)
    to_end = here.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    both = _with_rows_before(placed, group=group, order=order, back=back).withColumn("before", F.avg(value).over(back_rows))
    own = both.where("not _ghost").withColumn("_s", F.coalesce(F.sum(value).over(to_end), F.lit(0))).withColumn("_c", F.count(value).over(to_end))
    total, n = F.col("_s") + F.col("_later_s"), F.col("_c") + F.col("_later_c")
    same = F.col("_part") == F.col("_gp")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return own.join(rest, same).withColumn("after", F.when(n > 0, total / n)).select(*rows.columns, "before", "after")


def steepest(rows: DataFrame, *, group: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """(*group, at, step): where a value differs most from the row before, the first such place on ties."""
    placed = stretches(rows.select(*group, *order, value), group=group, order=order, parts=parts)
    both = _with_rows_before(placed, group=group, order=order, back=1)
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*group, "_part").orderBy(*order)))
    best = both.withColumn("_step", step).where("not _ghost and _step is not null")
    return best.groupBy(*group).agg(F.max("_step").alias("step"), F.max_by(F.col(order[-1]), F.struct(F.col("_step"), -F.col(order[-1]))).alias("at"))


def band_statistics(rows: DataFrame, *, group: list[str], value: str, calm: float) -> DataFrame:
    """(*group, mean, spread, calm_share, quartile): mean, population deviation, share of values under ``calm``, lower quartile."""
    v = F.col(value)
    return rows.groupBy(*group).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("spread"), F.avg((v < calm).cast("double")).alias("calm_share"), F.percentile(v, 0.25).alias("quartile"))


def first_where(rows: DataFrame, *, group: list[str], order: str, conditions: list[Column]) -> DataFrame:
    """(*group, at): the first place where all conditions hold; groups without one are left out. One aggregation, no window."""
    met = F.lit(True)
    for condition in conditions:
        met = met & condition
    return rows.where(met).groupBy(*group).agg(F.min(order).alias("at"))
