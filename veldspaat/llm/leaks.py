"""Evaluation passages inside training text, found through a positional inverted index.

The index holds one row per (document, term) with all positions of the term. It is written segment by segment: each task
indexes its own documents and sorts them by term. Only terms of the evaluation items are kept, by a semi join with the
items' terms, as no other can take part in a match.

A passage is looked up from its rarest terms: every window of ``length`` item words names its two rarest terms by document
frequency, their posting lists are offset by the place in the item and intersected, and only where both agree are the
remaining terms intersected as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.llm.words import words
from veldspaat.plans.joins import matched, sized_join
from veldspaat.plans.shared import written

LENGTH = 13
#: How many item words a proximity match of ``length`` words may take.
SPAN = 16
TEXTS = 2000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            piece = batch.slice(start, TEXTS)
            flat, offsets = words(piece.column("_text"))
            encoded = flat.dictionary_encode()
            code = encoded.indices.to_numpy().astype(np.int64)
            text = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
            order = np.argsort(code * piece.num_rows + text, kind="stable")
            place, code, text = (np.arange(len(code)) - offsets[text])[order], code[order], text[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(place.astype(np.int32)))
            columns = [encoded.dictionary.take(pa.array(code[first])).cast(pa.string()), piece.column("_doc").take(pa.array(text[first])), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "_doc", "places"])


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = words(batch.column("_text"))
        text = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        place = (np.arange(len(text)) - offsets[text]).astype(np.int32)
        columns = [batch.column("_item").take(pa.array(text)), pa.array(place), flat.cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["_item", "at", "term"])


def positional_index(documents: DataFrame, *, doc: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, _doc, places): the posting lists of the terms of a written table (term), or of all terms, sorted by term
    within each segment.

    ``places`` counts the words of the document from 0. Rows with a null id or text are not indexed.
    """
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("_doc", documents.schema[doc].dataType), T.StructField("places", T.ArrayType(T.IntegerType()))])
    rows = documents.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).where("_doc is not null and _text is not null")
    index = rows.mapInArrow(_postings, schema)
    return written(sized_join(index, terms, ["term"], "left_semi") if terms is not None else index, "leaks-index", sort=["term"])


def leaked_passages(items: DataFrame, documents: DataFrame, *, item: str, item_text: str, doc: str, text: str, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(item, doc, kind, item_start, doc_start, n_words) of item passages in documents.

    kind 'exact': a longest run of at least ``length`` consecutive words of the item that is consecutive in the document
    too; n_words is its length. kind 'near': no such run on that offset, but at least ``length`` of ``span`` consecutive
    item words stand at their place, the others being replaced; n_words is the most that do.
    Words are runs of letters and digits in lower case, so case, punctuation and white space don't matter. Items shorter
    than ``length`` words, null ids and null texts match nothing; repeated rows count once; empty tables give no rows.

    Posting lists of a frequent term are only read for windows that have no rarer one. What the items hold is broadcast if
    its bytes allow it; else it is shuffled, and a term, or an item, that a third of all rows have is spread over many
    tasks. Nothing is collected.
    """
    if length < 2:
        raise ValueError("a passage has at least two words")
    kind = items.schema[item].dataType
    schema = T.StructType([T.StructField("_item", kind), T.StructField("at", T.IntegerType()), T.StructField("term", T.StringType())])
    rows = items.select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).where("_item is not null and _text is not null").dropDuplicates(["_item"])
    spelt = written(rows.mapInArrow(_spelt, schema), "leaks-items")
    index = positional_index(documents, doc=doc, text=text, terms=written(spelt.groupBy("term").agg(F.count("*").alias("_n")), "leaks-terms").select("term"))

    frequency = written(index.groupBy("term").agg(F.count("*").alias("df")), "leaks-frequencies")
    ahead = Window.partitionBy("_item").orderBy("at").rowsBetween(0, length - 1)
    rated = sized_join(spelt, frequency, ["term"], "left").select("_item", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "at").alias("_t"), "at")
    windows = rated.select("_item", F.array_sort(F.collect_list("_t").over(ahead)).alias("_w")).where((F.size("_w") == length) & (F.get("_w", F.lit(0))["df"] > 0))
    first, second = F.get("_w", F.lit(0)), F.get("_w", F.lit(1))
    both = windows.select("_item", F.slice("_w", 1, 2).alias("_t"), F.least(first["at"], second["at"]).alias("_a"), F.greatest(first["at"], second["at"]).alias("_b"))
    both = written(both.dropDuplicates(["_item", "_a", "_b"]), "leaks-windows")
    anchors = written(both.select("_item", F.explode("_t").alias("_t")).select("_item", "_t.term", "_t.at").distinct(), "leaks-anchors")

    offset = matched(index, anchors, ["term"], "_doc", "_item").select("_item", "_doc", "at", F.explode("places").alias("place"))
    offset = offset.groupBy("_item", "_doc", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("_n"), F.min("at").alias("_a"), F.max("at").alias("_b"))
    # Two hits must be the two terms of one window; three or more go on to the exact check.
    pairs = both.select("_item", "_a", "_b", F.lit(True).alias("_pair"))
    offset = sized_join(offset.where("_n >= 2"), pairs, ["_item", "_a", "_b"], "left").where("_n > 2 or _pair")
    offset = written(offset.select("_item", "_doc", "shift"), "leaks-offsets")

    lists = sized_join(index, written(offset.select("_doc").distinct(), "leaks-documents"), ["_doc"], "left_semi")
    wanted = matched(offset, spelt, ["_item"], "_doc", "at")
    whole = wanted.join(lists, ["_doc", "term"]).where(F.array_contains("places", F.col("at") + F.col("shift")))
    whole = whole.select("_item", "_doc", "shift", "at").distinct()  # a repeated document has its postings twice
    line = ["_item", "_doc", "shift"]
    order = Window.partitionBy(*line).orderBy("at")
    near = Window.partitionBy(*line).orderBy("at").rangeBetween(0, span - 1)
    hits = whole.select(*line, "at", (F.col("at") - F.row_number().over(order)).alias("_run"), F.count("*").over(near).alias("_near"))
    runs = hits.groupBy(*line, "_run").agg(F.min("at").alias("start"), F.count("*").cast("int").alias("n"), F.max(F.struct("_near", -F.col("at"))).alias("_near"))
    best = Window.partitionBy(*line)
    runs = runs.withColumn("_longest", F.max("n").over(best)).withColumn("_best", F.max("_near").over(best))
    exact = F.col("n") >= length
    loose = (F.col("_longest") < length) & (F.col("_near") == F.col("_best")) & (F.col("_near._near") >= length)
    start = F.when(exact, F.col("start")).otherwise(-F.col("_near.col2"))
    return runs.where(exact | loose).select(
        F.col("_item").alias(item),
        F.col("_doc").alias(doc),
        F.when(exact, "exact").otherwise("near").alias("kind"),
        start.alias("item_start"),
        (start + F.col("shift")).alias("doc_start"),
        F.when(exact, F.col("n")).otherwise(F.col("_near._near")).cast("int").alias("n_words"),
    )
