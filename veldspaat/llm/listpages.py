"""Pages made of repeated keywords, lists of links or product labels instead of sentences.

Function words are found from the corpus itself: short words that a large part of a language's pages have. A page is cut
into segments, lines and the sentences in them, and the recurrence gaps of every content word over the whole page are
read off. Two things are unnatural: gaps that stay the same, so that the page's positional autocorrelation has a peak,
whatever its lag, at which most content words recur; and content words that nearly all recur within a few words. A
segment is 'repeats' if, with its neighbours, most of its content words recur in one of these ways; 'links' if it holds
an address and next to no function words; 'list' if it strings content words together without function words, most of
them different. The page's score is the part of its characters in such segments. Whole batches are worked on as arrays;
a page's text never leaves its task, and only counts of short words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.llm.words import words
from veldspaat.plans.shared import written

#: A function word has at most so many letters and stands in that part of the pages of its language.
SHORT_LETTERS, PAGE_PART = 6, 0.25
#: A language counts if it has so many pages, and that part of all.
LEAST_PAGES, LANGUAGE_PART = 5, 0.01
#: Part of a segment's words that may be function words, in a list and beside a link.
LIST_PART, LINK_PART = 0.1, 0.15
#: Part of the words with at most three letters, from which on a segment is taken for prose of a language the corpus hardly has.
TINY_PART = 0.25
#: Part of the content words that recur within so many words, from which on a segment repeats.
NEAR, NEAR_PART = 8, 0.45
#: The same for words of which three places lie within so many words.
DENSE, DENSE_PART = 32, 0.65
#: Part of the content words that recur at the page's own lag, from which on a segment repeats; and how far two gaps, or a
#: gap and that lag, may differ.
REGULAR_PART, SAME_GAP, LAG_WINDOW = 0.55, 0.1, 0.15
#: Places of a word in a row with equal gaps, from which on it recurs regularly.
PLACES = 5
TEXTS = 1000

_SENTENCE = r"([.!?])\s+"
_ADDRESS = r"(?i)(?:https?://|www\.)[^\s)\]]+"
#: A label in front of a value, such as "tag:"; it is neither a content word nor a function word.
_LABEL = r"[\p{L}\p{Nd}.]+:(?:\s|$)"
#: Scripts that don't put spaces between words: what looks like one word there says nothing about function words.
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"


def function_words(pages: DataFrame, *, text: Column, language: Column) -> list[str]:
    """Words of up to SHORT_LETTERS letters that PAGE_PART of the pages of some language have, or of all pages.

    A language is a value of ``language``, as dirty as it is; null is one too. The list is bounded: per language it has at
    most 1 / PAGE_PART times the mean number of different short words of a page, and there are at most 1 / LANGUAGE_PART
    languages. Counts are made over all pages, each page counting a word once, and only counts are shuffled.
    """
    rows = pages.select(F.coalesce(language, F.lit("")).alias("_lang"), text.alias("_text")).where("_text is not null")
    short = F.regexp_extract_all(F.lower("_text"), F.lit(rf"(?<![\p{{L}}\p{{Nd}}])\p{{L}}{{1,{SHORT_LETTERS}}}(?![\p{{L}}\p{{Nd}}])"), F.lit(0))
    spelt = rows.select("_lang", F.explode_outer(F.array_distinct(short)).alias("word")).where("word is not null")
    counts = written(spelt.groupBy("_lang", "word").agg(F.count("*").alias("n")), "pages-words")
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("_pages"))
    total = sizes.agg(F.sum("_pages").alias("_all"))
    known = sizes.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").where((F.col("_pages") >= LEAST_PAGES) & (F.col("_pages") >= LANGUAGE_PART * F.col("_all")))
    own = counts.join(known.select("_lang", "_pages"), "_lang").where(F.col("n") >= PAGE_PART * F.col("_pages")).select("word")
    every = counts.groupBy("word").agg(F.sum("n").alias("n"), F.lit(1).alias("_one")).join(total.withColumn("_one", F.lit(1)), "_one")
    every = every.where((F.col("_all") >= LEAST_PAGES) & (F.col("n") >= PAGE_PART * F.col("_all"))).select("word")
    return sorted(r["word"] for r in own.unionByName(every).distinct().collect())


def _segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of the texts that aren't blank, and the text of each."""
    lines = pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), _SENTENCE, "\\1\n")
    parts = pc.split_pattern_regex(lines, r"[\r\n]+")
    flat = pc.utf8_trim_whitespace(parts.flatten())
    of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), of[full.to_numpy(zero_copy_only=False)]


def recurrences(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, dense, regular, first) of each word, a word with code -1 being none.

    near: whether the word stands within NEAR words of another of its places in its text. dense: whether it is one of
    three of its places within DENSE words. regular: whether the word
    stands in a row of PLACES of its places, each or every second or third one, with equal gaps, at the lag at which most
    such rows of its text lie. first: whether it is the word's first place in its text.
    """
    at = np.flatnonzero(code >= 0)
    at = at[np.lexsort((at, code[at], text[at]))]
    t, c = text[at], code[at]
    near, dense, first = (np.zeros(len(code), bool) for _ in range(3))
    first[at] = True
    same = (t[1:] == t[:-1]) & (c[1:] == c[:-1])
    first[at[1:][same]] = False
    close = same & (at[1:] - at[:-1] <= NEAR)
    near[at[1:][close]] = near[at[:-1][close]] = True
    three = np.flatnonzero((t[2:] == t[:-2]) & (c[2:] == c[:-2]) & (at[2:] - at[:-2] <= DENSE))
    for j in range(3):
        dense[at[three + j]] = True
    rows = []
    for m in (1, 2, 3):
        last = (PLACES - 1) * m
        k = len(at) - last
        if k > 0:
            row = np.stack([at[j * m : j * m + k] for j in range(PLACES)], 1)
            gaps = np.diff(row, axis=1)
            longest = gaps.max(1)
            same = (t[last:] == t[:k]) & (c[last:] == c[:k]) & (longest - gaps.min(1) <= SAME_GAP * longest)
            rows.append(row[same])
    regular = np.zeros(len(code), bool)
    found = np.concatenate(rows) if rows else np.empty((0, PLACES), np.int64)
    if len(found):
        of, gap = text[found[:, 0]], found[:, 1] - found[:, 0]
        pairs, times = np.unique(np.stack([of, gap], 1), axis=0, return_counts=True)
        order = np.lexsort((-pairs[:, 1], times, pairs[:, 0]))  # the last of each text: most rows, the shortest gap on ties
        lag = np.zeros(int(text.max()) + 1)
        lag[pairs[order, 0]] = pairs[order, 1]
        regular[found[np.abs(gap - lag[of]) <= LAG_WINDOW * lag[of]].ravel()] = True
    return near, dense, regular, first


def page_parts(texts: pa.Array, functional: list[str]) -> dict[str, np.ndarray]:
    """Characters of each text in segments of each kind: all, list, links, repeats; 'regular' is a part of 'repeats'."""
    segments, of = _segments(texts)
    n, size = len(texts), pc.utf8_length(segments).to_numpy(zero_copy_only=False).astype(np.float64)
    linked = pc.match_substring_regex(segments, _ADDRESS).to_numpy(zero_copy_only=False)
    unspaced = pc.match_substring_regex(segments, _UNSPACED).to_numpy(zero_copy_only=False)
    flat, offsets = words(pc.replace_substring_regex(pc.replace_substring_regex(segments, _ADDRESS, " "), _LABEL, " "))
    segment = np.repeat(np.arange(len(segments)), np.diff(offsets))
    letters = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    known = pc.is_in(flat, pa.array(functional, pa.large_string())).to_numpy(zero_copy_only=False)
    digits = pc.match_substring_regex(flat, r"\p{Nd}").to_numpy(zero_copy_only=False)
    content = ~known & (letters > 2)
    code = np.where(content, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), -1)
    near, dense, regular, first = recurrences(of[segment], code)

    def per_segment(mask: np.ndarray) -> np.ndarray:
        return np.bincount(segment[mask], minlength=len(segments)).astype(np.float64)

    def around(x: np.ndarray) -> np.ndarray:
        """With the segments before and behind in the same text."""
        out = x.copy()
        joined = of[1:] == of[:-1]
        out[1:] += np.where(joined, x[:-1], 0)
        out[:-1] += np.where(joined, x[1:], 0)
        return out

    count, functions, contents, tiny = per_segment(np.ones(len(code), bool)), per_segment(known), per_segment(content), per_segment((letters <= 3) & ~digits)

    def repeating(mask: np.ndarray, part: float) -> np.ndarray:
        again = per_segment(mask)
        return (again > 0) & (around(again) >= part * around(contents)) & (again >= part / 2 * contents)

    links = linked & (functions <= LINK_PART * count)
    at_lag = repeating(regular, REGULAR_PART) & ~links
    repeats = at_lag | ((repeating(near, NEAR_PART) | repeating(dense, DENSE_PART)) & ~links)
    plain = ~links & ~repeats & ~unspaced & (count > 0) & (functions <= LIST_PART * count) & (around(tiny) < TINY_PART * around(count))
    different = 2 * around(per_segment(first)) >= around(contents)
    kinds = {"list": plain & different, "links": links, "repeats": repeats | (plain & ~different), "regular": at_lag}
    return {"all": np.bincount(of, size, n)} | {k: np.bincount(of[m], size[m], n) for k, m in kinds.items()}


def _scores(functional: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(start, TEXTS)
                parts = page_parts(piece.column("_text"), functional)
                whole = np.maximum(parts["all"], 1)
                shares = [pa.array(parts[k] / whole) for k in ("list", "links", "repeats", "regular")]
                rest = piece.drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, *shares], names=[*rest.schema.names, *_SHARES])

    return run


_SHARES = ("list_share", "link_share", "repeat_share", "regular_share")


def list_scores(pages: DataFrame, *, ids: list[str], text: Column, language: Column, functional: list[str] | None = None) -> DataFrame:
    """(*ids, list_share, link_share, repeat_share, regular_share, score) of every page.

    Each share is the part of the page's characters, white space between segments aside, in segments of that kind; a
    segment has one kind, and regular_share is the part of repeat_share that recurs at one lag. ``score`` is the sum of
    the first three. ``functional`` are the function words, found from ``pages`` themselves if not given; they are all the
    driver holds. A null, empty or blank text scores 0. Every row is scored, repeated ones too; other columns are ignored.
    """
    if functional is None:
        functional = function_words(pages, text=text, language=language)
    base = pages.select(*ids, text.alias("_text"))
    schema = T.StructType([*base.drop("_text").schema, *[T.StructField(n, T.DoubleType()) for n in _SHARES]])
    return base.mapInArrow(_scores(functional), schema).withColumn("score", F.col("list_share") + F.col("link_share") + F.col("repeat_share"))
