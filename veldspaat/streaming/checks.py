"""Gate, references and masking as stateless streaming queries.

Everything here works on one record at a time, so a stream needs no state and no watermark, and gives the rows of the
batch operators whatever the order or the size of its batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veldspaat.functions.citations import masked, references
from veldspaat.operators.gate import usable


def arriving(spark: SparkSession, folder: str, schema: T.StructType, *, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def gated(records: DataFrame, *, verified: Column) -> DataFrame:
    """The records that pass the source gate; batch or stream."""
    return records.where(usable(verified))


def checked_stream(texts: DataFrame, keys: DataFrame, *, item: str, text: str) -> DataFrame:
    """(item, soort, verwijzing, positie, gefundeerd) of every reference in arriving texts, against a static key table.

    The static side is joined anew for each batch; Spark broadcasts it if it is small by its own measure.
    """
    found = texts.select(item, F.inline(references(F.col(text))))
    joined = found.join(keys.withColumn("_known", F.lit(True)), ["soort", "verwijzing"], "left").withColumn("gefundeerd", F.coalesce("_known", F.lit(False)))
    silent = (F.col("soort") == "wetsartikel") & ~F.contains("verwijzing", F.lit(":")) & ~F.col("gefundeerd")
    return joined.where(~silent).select(item, "soort", "verwijzing", "positie", "gefundeerd")


def masked_stream(texts: DataFrame, *, item: str, text: str, known: list[tuple[str, str]]) -> DataFrame:
    """(item, gemaskeerd) of arriving texts, against a short list of (soort, verwijzing) that may be cited."""
    keys = F.array(*[F.lit(f"{kind}|{key}") for kind, key in known]) if known else F.array().cast("array<string>")
    wrong = F.filter(references(F.col(text)), lambda r: ~F.array_contains(keys, F.concat(r["soort"], F.lit("|"), r["verwijzing"])) & ((r["soort"] != "wetsartikel") | F.contains(r["verwijzing"], F.lit(":"))))
    first = F.filter(wrong, lambda r, i: ~F.exists(F.slice(wrong, 1, i), lambda e: (e["soort"] == r["soort"]) & (e["verwijzing"] == r["verwijzing"])))
    return texts.select(item, masked(F.col(text), first).alias("gemaskeerd"))


def landed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now to parquet, exactly once by the checkpoint, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
