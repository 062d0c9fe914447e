"""Problem 7: training mixtures by recipe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.llm.mixture import mixture
from veldspaat.sources.tables import table


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    names = {"doc": "doc_id", "source": "source", "text": "text", "recipe": "recept", "weight": "doel_aandeel", "repeats": "max_herhaling", "budget": "budget_fractie"}
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mixdoelen"), **names)


def p7_keuze(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents of each recipe, with their number of uses."""
    return _mixture(spark, folder)[0].select(F.col("recipe").alias("recept"), "doc_id", "source", "tokens", F.col("uses").alias("keren"))


def p7_aandelen(spark: SparkSession, folder: str) -> DataFrame:
    """Per recipe and source the wanted and the actual share."""
    return _mixture(spark, folder)[1].withColumnRenamed("recipe", "recept")


QUERIES = {"p7_keuze": p7_keuze, "p7_aandelen": p7_aandelen}
SQL: dict[str, str] = {}
