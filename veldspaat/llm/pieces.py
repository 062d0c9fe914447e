"""Cutting long texts into pieces at natural boundaries.

Dynamic programming over boundary positions: among all ways to cut a text into pieces of at most ``limit`` characters,
each but the first starting ``overlap`` characters before the end of the piece before, the one with the least sum of cut
penalties and size imbalance is taken. Each text is cut on its own, so texts are only spread over tasks, never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 1500
OVERLAP = 150
#: Penalties of cutting after a line break, after a sentence, after white space within a sentence, and anywhere else.
PENALTY = {"line": 0.0, "sentence": 1.0, "space": 50.0, "inside": 400.0}
#: Weight of the squared distance from an even size, as a part of the limit.
IMBALANCE = 4.0
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LINE = re.compile(r"\r\n|[\r\n]")
_SENTENCE = re.compile(rf"(?<=[.!?;])[{_SPACE}]")
_BREAK = re.compile(rf"[\r\n]|(?<=[.!?;])[{_SPACE}]")
_BLANK = re.compile(rf"[{_SPACE}]+")


def longest_stretch(text: str) -> int:
    """Most characters between two neighbouring boundaries or ends, the boundary characters not counted."""
    best = start = 0
    for m in _BREAK.finditer(text):
        best = max(best, m.start() - start)
        start = m.end()
    return max(best, len(text) - start)


def _places(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Ends a piece may have, best kind each, in order: natural ones, and others only where no natural end is in reach."""
    found: dict[int, str] = {m.end(): "sentence" for m in _SENTENCE.finditer(text)}
    found.update((m.end(), "line") for m in _LINE.finditer(text))
    found = {p: k for p, k in found.items() if overlap < p < len(text)}
    found[len(text)] = "line"
    reach = limit - overlap
    ordered = sorted(found)
    blanks: list[int] | None = None
    last = overlap
    for p in ordered:
        if p - last > reach:
            if blanks is None:
                blanks = [m.end() for m in _BLANK.finditer(text)]
            inner = blanks[bisect_right(blanks, last) : bisect_right(blanks, p - 1)]
            found.update((q, "space") for q in inner)
            at = last
            for q in [*inner, p]:
                while q - at > reach:
                    at += reach
                    found[at] = "inside"
                at = q
        last = p
    return sorted(found.items())


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, stop, kind of end) of the pieces. A text within the limit is one piece; kind of the last end is 'end'."""
    if len(text) <= limit:
        return [(0, len(text), "end")]
    places = _places(text, limit, overlap)
    ends = np.array([p for p, _ in places])
    cost = np.array([PENALTY[k] for _, k in places])
    pieces = -(-(len(text) - overlap) // (limit - overlap))
    even = overlap + (len(text) - overlap) / pieces
    best, came = np.full(len(ends), np.inf), np.full(len(ends), -1)
    low = 0
    for j, end in enumerate(ends):
        while low < j and ends[low] - overlap + limit < end:
            low += 1
        if end <= limit:
            best[j] = cost[j] + IMBALANCE * ((end - even) / limit) ** 2
        if low < j:
            sizes = end - ends[low:j] + overlap
            total = best[low:j] + cost[j] + IMBALANCE * ((sizes - even) / limit) ** 2
            k = int(total.argmin())
            if total[k] < best[j]:
                best[j], came[j] = total[k], low + k
    out, j = [], len(ends) - 1
    while j >= 0:
        i = int(came[j])
        out.append((int(ends[i]) - overlap if i >= 0 else 0, int(ends[j]), "end" if j == len(ends) - 1 else places[j][1]))
        j = i
    return out[::-1]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, start, stop, end, stretch, of, piece = ([] for _ in range(8))
            for i, text in enumerate(batch.column("_text").to_pylist()):
                longest = longest_stretch(text)
                parts = cut(text, limit, overlap)
                for n, (a, b, kind) in enumerate(parts, 1):
                    for column, value in zip((row, number, start, stop, end, stretch, of, piece), (i, n, a, b, kind, longest, len(parts), text[a:b]), strict=True):
                        column.append(value)
            rest = batch.drop_columns(["_text"]).take(pa.array(row, pa.int64()))
            whole = [pa.array(x, pa.int32()) for x in (number, of, start, stop)]
            arrays = [*rest.columns, *whole, pa.array(end, pa.string()), pa.array(stretch, pa.int32()), pa.array(piece, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest.schema.names, "piece", "pieces", "start", "stop", "ends_at", "longest_stretch", "text"])

    return run


def split_texts(records: DataFrame, *, ids: list[str], text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(*ids, piece, pieces, start, stop, ends_at, longest_stretch, text): numbered pieces of at most ``limit`` characters.

    Characters are code points. Piece 1 starts at 0, each later one ``overlap`` characters before the stop of the one
    before; the last stops at the end, so nothing is lost. ``ends_at`` says where a piece was cut: 'line' after a line
    break, 'sentence' after white space that follows one of . ! ? ;, 'space' after other white space, 'inside' a word,
    'end' at the end of the text. 'space' and 'inside' only come where no natural boundary is in reach.
    ``longest_stretch`` is the longest stretch without a natural boundary. A text within the limit is one piece, an
    empty text one empty piece, a null text none. Every row is cut, repeated ones too; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    base = records.select(*ids, text.alias("_text")).where("_text is not null")
    whole, string = T.IntegerType(), T.StringType()
    added = [("piece", whole), ("pieces", whole), ("start", whole), ("stop", whole), ("ends_at", string), ("longest_stretch", whole), ("text", string)]
    schema = T.StructType([*base.drop("_text").schema, *[T.StructField(n, t) for n, t in added]])
    return base.mapInArrow(_pieces(limit, overlap), schema)
