"""Long exact spans that records share.

Rabin-Karp hashes of every fixed-length token window are counted in Spark; here a token is a character, since spans are
asked for character by character. Counting happens in two rounds, so that windows which can't repeat are never
shuffled:

1. Every window of ``length // 2`` characters is hashed, and per run of ``length - length // 2 + 1`` windows the one
   with the smallest hash is kept (all of them on ties). Equal spans of ``length`` characters keep equal windows at
   equal places, so a span can only be shared if a kept window is. About one window in forty is counted.
2. All windows of full ``length`` whose own kept window two owners share are hashed to 126 bits and counted; the
   repeated ones merge into maximal intervals.

The first round only proposes; the second one decides, over all windows that can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.llm.charhash import SLAB, code_points, prime_hashes, sliding, word_hashes
from veldspaat.plans.joins import salted_join
from veldspaat.plans.shared import written

LENGTH = 160


def _slabs(lengths: np.ndarray) -> Iterator[slice]:
    """Runs of texts of at most SLAB code points together, or one longer text."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > SLAB:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def winnowed(points: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept windows of texts laid end to end: (places, hashes). Texts shorter than ``length`` keep none."""
    half = length // 2
    run = length - half + 1
    hashes = prime_hashes(points, half)
    if len(hashes) < run:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    least = sliding(hashes, run, np.minimum)
    least = np.where(np.arange(len(least)) + length <= ends[: len(least)], least, -1)
    held = sliding(np.concatenate([np.full(run - 1, -1), least, np.full(run - 1, -1)]), run, np.maximum)
    places = np.flatnonzero(held == hashes)
    return places, hashes[places]


def _beside(batch: pa.RecordBatch, row: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows ``row`` of a batch, with further columns."""
    out = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays([*out.columns, *map(pa.array, columns.values())], names=[*out.schema.names, *columns])


def _candidates(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [code_points(t) for t in batch.column("_text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            rest = batch.drop_columns(["_text"])
            for part in _slabs(sizes):
                own = sizes[part]
                places, hashes = winnowed(np.concatenate(texts[part]), own, length)
                row = np.searchsorted(np.cumsum(own), places, side="right")
                first = np.cumsum(own) - own
                yield _beside(rest, row + part.start, {"_place": (places - first[row]).astype(np.int32), "_hash": hashes})

    return run


def _windows(length: int):
    half = length // 2
    run_of = length - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["_text", "_places"])
            for i, (text, at) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_places").to_pylist(), strict=True)):
                points = code_points(text)
                short = prime_hashes(points, half)
                starts = np.flatnonzero(np.isin(sliding(short, run_of, np.minimum), short[np.array(at)]))
                hashes = {"_hash": prime_hashes(points, length)[starts], "_hash2": word_hashes(points, length)[starts]}
                yield _beside(rest, np.full(len(starts), i), {"_place": starts.astype(np.int32), **hashes})

    return run


def shared_spans(records: DataFrame, *, ids: list[str], owner: Column, text: Column, length: int = LENGTH) -> DataFrame:
    """Maximal intervals of each record that stand, character for character, in a record of another owner.

    Gives (*ids, n_chars, spans, n_shared, share): ``spans`` is an array of (start, stop) in characters of ``text``,
    stop exclusive, each made of repeated windows of ``length`` characters that overlap or touch; ``share`` is the part
    of the record's characters inside spans. Records without a span are left out. Rows with equal ``ids``, nulls
    included, are one record; records with equal ``owner`` don't count as each other's copy; a null owner is an owner
    of its own per record. Null, empty and short texts share nothing; an empty table gives no rows; columns not named
    are ignored.

    Texts are written once with a number for each row; after that only numbers, places and hashes are moved. A span that a
    third of all records hold is counted by partial aggregation, and the join that brings the counts back spreads such a
    hash over many partitions. Rows are rejoined with their texts only where round 1 found something.
    """
    own = F.when(owner.isNotNull(), F.xxhash64(F.lit("o"), owner)).otherwise(F.xxhash64(F.lit("r"), F.to_json(F.struct(*ids))))
    texts = records.select(*ids, own.alias("_owner"), text.alias("_text")).where(F.length("_text") >= length)
    base = written(texts.select("*", F.length("_text").alias("n_chars"), F.monotonically_increasing_id().alias("_row")), "span-texts")
    long, whole = T.LongType(), T.IntegerType()
    schema = T.StructType([T.StructField("_row", long), T.StructField("_owner", long), T.StructField("_place", whole), T.StructField("_hash", long)])

    def repeated(windows: DataFrame, key: list[str]) -> DataFrame:
        owners = windows.groupBy(*key).agg(F.min("_owner").alias("_a"), F.max("_owner").alias("_b"), F.count("*").alias("_n"))
        return salted_join(windows.drop("_owner"), owners.where("_a < _b").select(*key, "_n"), key, "_n", windows.count(), "_row")

    kept = base.select("_row", "_owner", "_text").mapInArrow(_candidates(length), schema)
    near = repeated(written(kept, "span-candidates"), ["_hash"]).groupBy("_row").agg(F.collect_set("_place").alias("_places"))
    near = written(near, "span-places")

    schema = schema.add(T.StructField("_hash2", long))
    found = base.select("_row", "_owner", "_text").join(near, "_row").mapInArrow(_windows(length), schema)
    windows = written(found, "span-windows")
    starts = repeated(windows, ["_hash", "_hash2"]).groupBy("_row").agg(F.array_sort(F.collect_set("_place")).alias("_starts"))

    here = F.col("_starts")
    first = F.filter(here, lambda s, i: (i == 0) | (s - F.get(here, i - 1) > length))
    last = F.filter(here, lambda s, i: (i == F.size(here) - 1) | (F.get(here, i + 1) - s > length))
    spans = F.arrays_zip(first.alias("start"), F.transform(last, lambda s: s + length).alias("stop"))
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    found = written(starts.select("_row", spans.alias("spans")), "spans").join(base.select(*ids, "n_chars", "_row"), "_row")
    return found.dropDuplicates(ids).select(*ids, "n_chars", "spans", covered.alias("n_shared"), (covered / F.col("n_chars")).alias("share"))
