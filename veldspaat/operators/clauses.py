"""Cutting clauses out of documents, and telling where a wording isn't that of its source."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspaat.functions.text import clause_between
from veldspaat.plans.joins import sized_join
from veldspaat.plans.shared import written

#: Equal stretches shorter than this are chance.
BLOCK = 25


def cut_clauses(documents: DataFrame, specs: DataFrame, *, on: str, text: str, start: str, end: str, lead: str | None = None) -> DataFrame:
    """``specs`` with ``cut`` and ``error``: the text between the markers of each spec in its document, in paragraphs.

    Column ``lead``, where given and not null, names a beginning that is cut off the piece.

    Specs of an unknown document give no row; a marker that isn't there exactly once gives an error, not a guess.
    """
    joined = sized_join(documents.select(on, F.col(text).alias("_text")), written(specs, "specs"), [on])
    done = joined.withColumn("_cut", clause_between(F.col("_text"), F.col(start), F.col(end), F.col(lead) if lead else F.lit(None).cast("string")))
    return done.select(*specs.columns, F.col("_cut.cut").alias("cut"), F.col("_cut.error").alias("error"))


def _gaps(a: str | None, b: str | None) -> list[str]:
    if not a or not b:
        return []
    blocks = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size > BLOCK]
    return [a[x.a + x.size : y.a] for x, y in zip(blocks, blocks[1:], strict=False) if y.a > x.a + x.size]


def foreign_stretches(part: Column, whole: Column, most: int = 3) -> Column:
    """Up to ``most`` stretches of ``part`` between two long stretches that it has in common with ``whole``.

    What comes before the first or behind the last such stretch isn't reported. Meant for pairs that are known not to be
    verbatim: it compares one pair at a time.
    """

    @F.pandas_udf("array<string>")
    def gaps(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_gaps(x, y) for x, y in zip(a, b, strict=True)])

    return F.slice(gaps(part, whole), 1, most)

