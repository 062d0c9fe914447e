"""Problem 5: complaints and outcomes that were stored incompletely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.llm.truncation import judged_values, truncation_rates
from veldspaat.sources.tables import table

FIELDS = ["kern_klacht", "uitkomst_letterlijk_uit_pdf"]


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return judged_values(table(spark, folder, "kifid"), item="rij_id", source="bron_soort", fields=FIELDS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that stop before their text was complete."""
    return _judged(spark, folder).where("reason is not null").select("rij_id", F.col("field").alias("veld")).distinct()


def p5_oordelen(spark: SparkSession, folder: str) -> DataFrame:
    """Each cut value with what shows it: its length, by the histograms, or its ending."""
    return _judged(spark, folder).where("reason is not null").distinct()


def p5_per_bron(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts each field, in all and as far as the length histograms show it."""
    rates = truncation_rates(_judged(spark, folder), item="rij_id", source="bron_soort")
    return rates.select(
        "bron_soort", F.col("field").alias("veld"), F.col("n_values").alias("waarden"), F.col("n_cut").alias("afgebroken"), F.round("rate", 6).alias("deel"),
        F.col("n_by_length").alias("afgebroken_op_lengte"), F.round("rate_by_length", 6).alias("deel_op_lengte"),
    )


QUERIES = {"p5_found": p5_found, "p5_oordelen": p5_oordelen, "p5_per_bron": p5_per_bron}
SQL: dict[str, str] = {}
