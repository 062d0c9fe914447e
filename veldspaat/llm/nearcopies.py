"""Near-duplicate records: equal but for small edits, insertions or reordering.

Min-max hashing: under each permutation of the shingle hashes both the minimum and the maximum are kept, so the
signature has two values per hash evaluation. Bands of signature values propose pairs, the exact shingle sets decide.

Records with equal shingle sets form a class; all work after the first pass is on one representative per class, however
many copies it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.llm.words import mixed, shingles, word_codes, words
from veldspaat.plans.joins import matched, salted_join, sized_join
from veldspaat.plans.pairs import pairs_within
from veldspaat.plans.shared import written

WIDTH = 5
SIMILARITY = 0.8
#: Texts hashed at once.
TEXTS = 2000


def band_plan(similarity: float, miss: float = 2e-4) -> tuple[int, int]:
    """(rows, bands): the most selective bands of at most 6 rows that miss a pair at the threshold with at most
    probability ``miss``, with no more than 72 bands; one row and as many bands as needed if none does."""
    for rows in range(6, 0, -1):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(similarity**rows))))
        if bands + bands % 2 <= 72 or rows == 1:
            return rows, bands + bands % 2
    raise AssertionError


def minmax_bands(values: np.ndarray, offsets: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty shingle sets.

    rows * bands / 2 permutations are evaluated. A band takes minima and maxima from different permutations, so its
    values are independent.
    """
    half = (rows * bands + 1) // 2
    seeds = mixed(np.arange(1, 2 * half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((2, half, len(offsets) - 1), np.uint64)
    for i in range(half):
        permuted = values * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1]
        permuted ^= permuted >> np.uint64(32)
        np.minimum.reduceat(permuted, offsets[:-1], out=out[0, i])
        np.maximum.reduceat(permuted, offsets[:-1], out=out[1, i])
    out[1] = np.roll(out[1], rows, axis=0)
    signature = out.transpose(1, 0, 2).reshape(2 * half, -1)
    hashed = np.empty((bands, signature.shape[1]), np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
        hashed[b] = h
    return hashed.T


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a batch without its text, restricted to texts with a shingle: (rows, values, offsets)."""
    for start in range(0, batch.num_rows, TEXTS):
        piece = batch.slice(start, TEXTS)
        flat, offsets = words(piece.column("_text"))
        values, offsets = shingles(word_codes(flat), offsets, width)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            yield piece.drop_columns(["_text"]).take(pa.array(full)), values, np.append(offsets[full], len(values))


def _signatures(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rest, values, offsets in _sets(batch, width):
                hashed = minmax_bands(values, offsets, rows, bands)
                digests = [xxhash.xxh3_128_hexdigest(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, hashed.size + 1, bands, np.int32)), pa.array(hashed.ravel().view(np.int64)))
                arrays = [*rest.columns, pa.array(digests), pa.array(np.diff(offsets).astype(np.int32)), flat]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest.schema.names, "_class", "_size", "_bands"])

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rest, values, offsets in _sets(batch, width):
                flat = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*rest.columns, flat], names=[*rest.schema.names, "_set"])

    return run


def near_copies(records: DataFrame, *, item: str, text: Column, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal shingle sets, and the similar pairs of classes.

    Gives (members, links): members is (item, class, copies), one row per record, a class being called by its smallest
    item; links is (a, b, similarity) with a < b, each pair of classes whose Jaccard similarity of shingle sets is at least ``similarity``. Records of one class
    have similarity 1. Rows with an equal ``item`` are one record; a null item, a null text and a text of fewer words
    than a shingle belong to no class. An empty table gives two empty ones.

    Nothing is capped: a band bucket with any number of classes is paired in blocks, and copies meet as one class.
    """
    rows, bands = band_plan(similarity)
    base = records.select(F.col(item).alias("_item"), text.alias("_text")).where("_item is not null and _text is not null")
    key = T.StructField("_item", records.schema[item].dataType)
    schema = T.StructType([key, T.StructField("_class", T.StringType()), T.StructField("_size", T.IntegerType()), T.StructField("_bands", T.ArrayType(T.LongType()))])
    signed = written(base.mapInArrow(_signatures(width, rows, bands), schema), "copies-signatures")

    classes = signed.groupBy("_class").agg(F.min("_item").alias("class"), F.first("_size").alias("_size"), F.first("_bands").alias("_bands"))
    buckets = classes.select("class", "_size", F.posexplode("_bands").alias("_band", "_value")).select("class", "_size", F.xxhash64("_band", "_value").alias("_bucket"))
    buckets = written(buckets, "copies-buckets")
    shared = written(buckets.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1"), "copies-shared")
    met = written(salted_join(buckets, shared, "_bucket", "_n", buckets.count(), "class"), "copies-met")
    least, most = F.least("_size_a", "_size_b"), F.greatest("_size_a", "_size_b")
    pairs = pairs_within(met, "_bucket", "class", "_n", carry=("_size",)).where(least >= most * similarity).select("a", "b").distinct()
    pairs = written(pairs, "copies-pairs")

    chosen = written(pairs.select(F.explode(F.array("a", "b")).alias("_item")).groupBy("_item").agg(F.count("*").alias("_n")), "copies-representatives")
    schema = T.StructType([key, T.StructField("_n", T.LongType()), T.StructField("_set", T.ArrayType(T.LongType()))])
    sets = sized_join(base, chosen, ["_item"]).select("_item", "_n", "_text").mapInArrow(_shingle_sets(width), schema)
    sets = written(sets.dropDuplicates(["_item"]), "copies-sets")
    total = pairs.count()
    both = salted_join(pairs, sets.select(F.col("_item").alias("a"), "_n", F.col("_set").alias("_set_a")), "a", "_n", total, "b").drop("_n")
    both = salted_join(both, sets.select(F.col("_item").alias("b"), "_n", F.col("_set").alias("_set_b")), "b", "_n", total, "a")
    common = F.size(F.array_intersect("_set_a", "_set_b"))
    links = both.select("a", "b", common.alias("_c"), (F.size("_set_a") + F.size("_set_b") - common).alias("_u")).where(F.col("_c") >= F.col("_u") * F.lit(similarity) - 1e-9)
    links = written(links.select("a", "b", (F.col("_c") / F.col("_u")).alias("similarity")), "copies-links")

    held = written(signed.select("_item", "_class").distinct(), "copies-members")
    named = held.groupBy("_class").agg(F.min("_item").alias("class"), F.count("*").alias("copies"))
    members = salted_join(held, named, "_class", "copies", held.count(), "_item")
    return members.select(F.col("_item").alias(item), "class", "copies"), links


def item_pairs(members: DataFrame, links: DataFrame, *, item: str) -> DataFrame:
    """(a, b), a < b: the links of classes and the copies of each class, spelt out as pairs of records.

    This is as large as it says: a class of m copies has m * (m - 1) / 2 pairs. Blocks keep each task bounded, also where
    a class with a third of all records is linked to others, or a third of all links lead to one class.
    """
    members = written(members, "copies-spelt")
    within = pairs_within(members.where("copies > 1"), "class", item, "copies")
    links = written(links.select("a", "b"), "copies-links-spelt")
    half = matched(links, members.select(F.col("class").alias("a"), F.col(item).alias("_x")), ["a"], "b", "_x")
    half = written(half.select("b", "_x"), "copies-half-spelt")
    across = matched(half, members.select(F.col("class").alias("b"), F.col(item).alias("_y")), ["b"], "_x", "_y")
    return within.unionByName(across.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))


def groups(members: DataFrame, links: DataFrame, *, item: str) -> DataFrame:
    """(item, class, copies, n_links, group): one row per record; ``group`` is the smallest class that links lead to.

    Labels spread along links and then jump to their label's label, so a chain of n classes takes about log n rounds.
    Each round is a written table; only counts reach the driver. A class that a third of all links lead to, or a label
    that a third of all classes have, is salted in the joins and reduced by partial aggregation.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "groups-edges")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n_links"))
    labels = written(labels, "groups-labels")
    n_edges, n_nodes = edges.count(), labels.count()
    while True:
        near = salted_join(edges, labels.select(F.col("a").alias("b"), "label", "n_links"), "b", "n_links", n_edges, "a")
        lower = near.groupBy("a").agg(F.min("label").alias("near"))
        held = labels.groupBy("label").agg(F.count("*").alias("_held")).join(labels.select(F.col("a").alias("label"), F.col("label").alias("far")), "label")
        step = salted_join(labels.join(lower, "a"), held, "label", "_held", n_nodes, "a")
        step = step.select("a", F.least("label", "near", "far").alias("label"), "n_links", (F.least("near", "far") < F.col("label")).alias("moved"))
        step = written(step, "groups-labels")
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    found = labels.withColumnRenamed("a", "class").join(members.groupBy("class").agg(F.count("*").alias("_held")), "class")
    out = salted_join(members, found, "class", "_held", members.count(), item, how="left")
    return out.select(item, "class", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "class").alias("group"))
