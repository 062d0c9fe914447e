"""Terms of whole Arrow batches, counted: what ``functions.text.tokens`` gives, without a step per token.

Tokens are found as runs of bytes, by a table of bytes, and each distinct word of a piece is looked at once. An index row
has its terms packed, as a string and a block of numbers: Spark moves it as two values, not as two per term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.functions.text import ENDING, LONG, STOPWORDS
from veldspaat.plans.shared import written

#: Bytes of text that are taken at once; a longer text is taken alone.
PIECE = 1 << 20
_byte = np.arange(256)
_DIGIT = (_byte >= ord("0")) & (_byte <= ord("9"))
_LETTER = (_byte >= ord("a")) & (_byte <= ord("z"))
_CONTINUED = (_byte >= 0x80) & (_byte <= 0xBF)
_ACCENT = (_byte >= 0xA0) & (_byte <= 0xBF)  # behind 0xC3: à to ÿ
_stop, _ending = frozenset(STOPWORDS), re.compile(ENDING)


@lru_cache(1 << 17)
def _term(word: str) -> str | None:
    return None if word in _stop else _ending.sub("", word) if len(word) > LONG else word


def _places(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin and end in lower-case UTF-8. ``edges`` are the offsets of the texts, which no token crosses."""
    n = len(raw)
    word = (_DIGIT | _LETTER)[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[_ACCENT[raw[lead + 1]]]
    word[lead] = word[lead + 1] = True
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    before, here = np.append(False, word), np.append(word, False)
    start, end = here & (~before | edge), before & (~here | edge)
    # a colon and a number behind a word belong to it, with one letter at most: 4:22a
    colon = np.flatnonzero((raw[:-1] == ord(":")) & end[: n - 1] & start[1:n] & ~edge[: n - 1] & ~edge[1:n] & _DIGIT[raw[1:]])
    if len(colon):
        number, other, ends = colon + 1, np.append(np.flatnonzero(~_DIGIT[raw]), n), np.flatnonzero(end)
        last = ends[np.searchsorted(ends, number, "right")]
        stop = np.minimum(other[np.searchsorted(other, number)], last)
        stop += (stop < last) & _LETTER[raw[np.minimum(stop, n - 1)]]
        start[number] = end[colon] = False
        rest = stop[stop < last]
        start[rest] = end[rest] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def counted_terms(texts: pa.StringArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_tokens of lower-case texts without nulls, and their packed terms, in order, with tf."""
    n, edges = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    start, end = _places(raw, edges) if len(raw) else (edges[:0], edges[:0])
    inner = np.append(0, np.cumsum(_CONTINUED[raw], dtype=np.int32))
    long = end - start - inner[end] + inner[start] > 1
    start, end = start[long], end[long]
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    ends = np.append(0, np.cumsum(end - start)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(raw[np.cumsum(mark[:-1], dtype=np.int8).view(bool)])).dictionary_encode()
    found = [_term(w) for w in words.dictionary.to_pylist()]
    terms = sorted({t for t in found if t is not None})
    place = {t: i for i, t in enumerate(terms)}
    code = np.array([place.get(t, -1) for t in found], np.int64)[words.indices.to_numpy()]
    text = np.searchsorted(edges, start, "right") - 1
    text, code = text[code >= 0], code[code >= 0]
    cells, tf = np.unique(text * max(1, len(terms)) + code, return_counts=True)
    of, term = np.divmod(cells, max(1, len(terms)))
    at = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
    spelt = pc.binary_join(pa.ListArray.from_arrays(at, pa.array(terms, pa.string()).take(pa.array(term))), " ")
    times = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.to_numpy() * np.int32(4)), pa.py_buffer(tf.astype("<i4"))])
    return pa.array(np.bincount(text, minlength=n), pa.int32()), spelt, times


def unpacked(rows: pa.RecordBatch) -> tuple[pa.ListArray, np.ndarray]:
    """The terms of each index row, none as a null, and tf of all of them."""
    terms = pc.split_pattern(pc.if_else(pc.equal(rows["terms"], ""), None, rows["terms"]), " ")
    return terms, np.frombuffer(b"".join(rows["tf"].to_pylist()), "<i4")


def with_terms(texts: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """Columns ``keep`` of every row with n_tokens, terms and tf of its text, see ``unpacked``; null has none. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            spelt, begin = rows["_text"].cast(pa.string()), 0
            ends = np.cumsum(pc.binary_length(spelt).to_numpy(zero_copy_only=False), dtype=np.int64)
            while begin < len(spelt):
                size = max(1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PIECE, "right")) - begin)
                kept = rows.slice(begin, size)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *counted_terms(spelt.slice(begin, size))], [*kept.schema.names[:-1], "n_tokens", "terms", "tf"])
                begin += size

    rows = texts.select(*keep, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    added = [T.StructField("n_tokens", T.IntegerType()), T.StructField("terms", T.StringType()), T.StructField("tf", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields[:-1], *added])
    return rows.mapInArrow(run, schema)


def frequencies(index: DataFrame) -> DataFrame:
    """(_p, term, _df) of an index (_p, terms): texts that have a term, a row per batch and term, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for p in rows["_p"].unique().drop_null():
                counts = pc.value_counts(pc.split_pattern(rows.filter(pc.equal(rows["_p"], p))["terms"], " ").flatten())
                yield pa.RecordBatch.from_arrays([pa.repeat(p, len(counts)), counts.field("values"), counts.field("counts")], ["_p", "term", "_df"])

    return index.select("_p", "terms").mapInArrow(run, T.StructType([index.schema["_p"], T.StructField("term", T.StringType()), T.StructField("_df", T.LongType())]))


def terms_asked(asked: DataFrame) -> DataFrame:
    """(term): the distinct terms of packed queries, written."""
    return written(frequencies(asked.select(F.lit("").alias("_p"), "terms")).select("term").distinct(), "terms-distinct")
