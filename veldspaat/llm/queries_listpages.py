"""Problem 8: pages that only list search terms, links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.llm.listpages import list_scores
from veldspaat.sources.tables import table

#: A page is a case if more than this part of its characters is listed.
HALF = 0.5


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The listed parts of every page that has any."""
    return list_scores(table(spark, folder, "documents"), ids=["doc_id"], text=F.col("text"), language=F.col("lang")).where("score > 0")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are mostly lists of terms, links or labels."""
    return p8_scores(spark, folder).where(F.col("score") > HALF).select("doc_id").distinct()


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores}
SQL: dict[str, str] = {}
