"""Validators: each gives the violations of one rule, to be united into a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspaat.functions.text import SPACE, letters

TYPES = ("dekking", "uitsluiting", "eigen risico", "verplichting verzekerde", "schaderegeling", "verjaring")


def row_violations(rows: DataFrame, *, item: str, required: list[str], allowed: dict[str, tuple[str, ...]], not_blank: list[str]) -> DataFrame:
    """(item, rule, column): missing required values, values outside an enumeration, blank texts; one scan for all."""
    found = [F.when(F.col(c).isNull(), F.struct(F.lit("missing").alias("rule"), F.lit(c).alias("column"))) for c in required]
    found += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.struct(F.lit("not allowed").alias("rule"), F.lit(c).alias("column"))) for c, v in allowed.items()]
    found += [F.when(F.regexp_replace(c, SPACE, "") == "", F.struct(F.lit("blank").alias("rule"), F.lit(c).alias("column"))) for c in not_blank]
    return rows.select(item, F.inline(F.filter(F.array(*found), lambda v: v.isNotNull())))


def mixed_hashes(rows: DataFrame, *, source: str, digest: Column) -> DataFrame:
    """(source, n_hashes) of sources that were seen with more than one digest; nulls aren't digests."""
    return rows.groupBy(source).agg(F.count_distinct(digest).alias("n_hashes")).where("n_hashes > 1")


def containment(left: DataFrame, right: DataFrame, *, on: list[str], part: str, whole: str) -> DataFrame:
    """Rows of ``left`` joined to ``right`` on equal keys, with ``verbatim``: whether the letters of ``part`` stand in ``whole``.

    Containment alone would need every pair; the key makes it an equi join. Letters are taken on each side, once a row.
    """
    joined = left.withColumn("_part", letters(F.col(part))).join(right.withColumn("_whole", letters(F.col(whole))), on)
    return joined.withColumn("verbatim", F.contains("_whole", F.col("_part"))).drop("_part", "_whole")


def covered(references: DataFrame, records: DataFrame, *, key: str, member: str, members: str) -> DataFrame:
    """``references`` with ``covered``: 'no record', 'no member' or 'covered'.

    A record is covered if its key exists and, where a member number is given, one of its members starts with it.
    """
    there = F.exists(F.col(members), lambda m: F.startswith(F.trim(m), F.concat(F.col(member), F.lit("."))))
    state = F.when(F.col("_hit").isNull(), "no record").when(F.col(member).isNull() | F.coalesce(there, F.lit(False)), "covered").otherwise("no member")
    known = references.join(records.select(key, members, F.lit(True).alias("_hit")), key, "left")
    return known.withColumn("covered", state).drop("_hit", members)


def report(*violations: DataFrame) -> DataFrame:
    """All violations (item, rule, column) as text, counted: (rule, column, n)."""
    return reduce(DataFrame.unionByName, violations).groupBy("rule", "column").agg(F.count("*").alias("n"))
