"""Manifests of image files, in the shapes they come in, and what is kept of them over rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "array<struct<file:string,name:string,omschrijving:string>>"
COMPS = "struct<comps:array<struct<naam:string,omschrijving:string,bestanden:map<string,string>>>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(source, file, name, description) of manifests that are a list of rows or an object of sets with their files.

    A file that is neither gives no rows; a missing path fails, rather than passing as an empty set.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), "value")
    rows = text.select("source", F.inline(F.from_json("value", LIST)))
    rows = rows.select("source", "file", "name", F.col("omschrijving").alias("description")).where("file is not null")
    sets = text.select("source", F.inline(F.from_json("value", COMPS)["comps"]))
    sets = sets.select("source", F.explode(F.map_values("bestanden")).alias("file"), F.col("naam").alias("name"), F.col("omschrijving").alias("description"))
    return rows.unionByName(sets)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, kind, bytes) of the images in a folder, told by their first bytes; others have a null kind."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(folder)
    head = F.hex(F.substring("content", 1, 4))
    kind: Column = F.when(head == "89504E47", "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), kind.alias("kind"), F.col("length").alias("bytes"))


def upserted(old: DataFrame, new: DataFrame, *, key: list[str], files: DataFrame | None = None, file: str = "file") -> DataFrame:
    """``new`` rows replace ``old`` ones by key; rows whose file is no longer there are dropped."""
    out = old.join(new.select(*key), key, "left_anti").unionByName(new)
    return out.join(files.select(file).distinct(), file, "left_semi") if files is not None else out
