"""Lexical retrieval: BM25 for batches of queries over a table of texts.

The index is one written row per text with its counted terms: a text is tokenized once, its terms are counted in the same
Arrow batch, and everything else is read from the index, only the columns needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspaat.functions.text import tokens
from veldspaat.operators.scores import best_scores
from veldspaat.operators.terms import frequencies, terms_asked, with_terms
from veldspaat.plans.joins import sized_join
from veldspaat.plans.shared import written

K1, B = 1.5, 0.75


def term_index(texts: DataFrame, *, item: str, text: Column, part: str | None = None) -> DataFrame:
    """(item, n_tokens, terms, tf): every text with its distinct terms and how often each occurs, packed (``operators/terms.py``),
    written once, nothing shuffled.

    ``part`` names a column, such as the corpus, that is kept. A text without tokens, or null, has no terms and counts as
    one of length 0.
    """
    return written(with_terms(texts, [*([part] if part else []), item], text), "terms")


def document_frequencies(texts: DataFrame, *, text: Column) -> DataFrame:
    """(term, df): the number of texts each term is in, counted without ids: a text's terms are made distinct in place.

    Terms are exploded with explode_outer and a filter behind it: for a plain explode the optimizer adds a test that the
    array isn't empty, and with it a second tokenization of every text.
    """
    return texts.select(F.explode_outer(F.array_distinct(tokens(text))).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def length_statistics(texts: DataFrame, *, text: Column) -> DataFrame:
    """One row (n_docs, n_tokens, average); an empty table counts as one empty text."""
    sizes = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens(text))), F.lit(0)).alias("t"))
    return sizes.select(F.greatest("n", F.lit(1)).alias("n_docs"), F.col("t").alias("n_tokens"), (F.col("t") / F.greatest("n", F.lit(1))).alias("average"))


def bm25_search(
    index: DataFrame, queries: DataFrame, *, item: str, query: str, query_text: Column, k: int, part: str | None = None, asks_part: bool = False, k1: float = K1, b: float = B
) -> DataFrame:
    """(query, item, score, rank): the ``k`` best texts of an index for each query, ties by item.

    With ``part`` the index holds several corpora, each with statistics and ranks of its own, and the result has that
    column; with ``asks_part`` each query has it too and is put to that corpus only. A term that a query has twice counts
    twice. Texts that share no term with a query don't appear, a query without tokens has no rows. Nothing about the texts
    reaches the driver. Scores are added up where a text's terms stand (``best_scores``): the index is not shuffled, and a
    task hands on ``k`` texts per query, not a row per query and text.
    """
    of = (F.col(part) if part else F.lit("")).alias("_p")
    asked = queries.select(F.col(query).alias("_q"), *([of] if asks_part else []), query_text.alias("_asked"))
    asked = written(with_terms(asked, asked.columns[:-1], F.col("_asked")).where("n_tokens > 0").drop("n_tokens"), "terms-asked")
    average = F.when(F.avg("n_tokens") > 0, F.avg("n_tokens")).otherwise(1.0)
    sizes = index.groupBy(of).agg(F.count("*").cast("double").alias("_n"), average.alias("_average"))
    counts = sized_join(frequencies(index.select(of, "terms")), terms_asked(asked), ["term"], "left_semi")
    known = written(counts.groupBy("_p", "term").agg(F.sum("_df").alias("_df")).join(sizes, "_p"), "terms-known")
    scored = best_scores(index.select(of, F.col(item).alias("_d"), "n_tokens", "terms", "tf"), asked, known, k=k, k1=k1, b=b)
    rank = F.row_number().over(Window.partitionBy("_q", "_p").orderBy(F.desc("score"), F.asc("_d")))
    found = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("_q").alias(query), F.col("_d").alias(item), "score", "rank", *([F.col("_p").alias(part)] if part else []))


def bm25(
    texts: DataFrame, queries: DataFrame, *, item: str, text: Column, query: str, query_text: Column, k: int, part: str | None = None, asks_part: bool = False, k1: float = K1, b: float = B
) -> DataFrame:
    """``bm25_search`` over texts that are indexed for this one batch; keep a ``term_index`` to search texts more often."""
    return bm25_search(term_index(texts, item=item, text=text, part=part), queries, item=item, query=query, query_text=query_text, k=k, part=part, asks_part=asks_part, k1=k1, b=b)
