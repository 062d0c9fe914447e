"""Intermediate tables in the folder that all executors share.

A long plan is cut by writing a table there and reading it back: the files survive the loss of any executor, and
unlike a checkpoint they are columnar, compressed and pruned by later reads. The folder is the one the cluster names
in ``spark.checkpoint.dir``. Only a local master may fall back to a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one if it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def written(df: DataFrame, name: str, *, sort: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, rows and columns unchanged.

    ``sort`` orders the rows inside each file, without a shuffle, so that later filters on those columns skip row
    groups. An empty ``df`` gives an empty table of the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veldspaat/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table that this application wrote; DataFrames built on them can't be used afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
