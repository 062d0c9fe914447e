"""The parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``, a parquet file or folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, spread by the hash of ``keys``; any other scan unchanged.

    A small file of one row group is one task, however heavy the work on its texts. Tables of the size this is built for
    have far more splits than cores and are not shuffled. Only for plain scans and filters: the plan is looked at, not run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
