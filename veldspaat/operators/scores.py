"""Adding up scores of many queries over a text index, for the best texts of each, without a row per query and text.

A batch's terms are split by how many sums they take part in. Common ones, asked by many queries and found in many texts,
are added up by a matrix product, once for all queries that have the same of them. The sums of rare ones are added to that
only where a text has one of a query's. A query's best texts are then among the best of its common terms and those that have
a rare one: weights are above 0, so a text without rare terms that isn't among the ``k`` best of the common ones has ``k``
others before it whatever is added to those. Where most queries have common terms of their own, the product is of half the
precision and rare terms are added to it in place; what may be among the best by all that such sums can be wrong is then
added up exactly. Nothing is left out, and ties are by item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspaat.operators.terms import terms_asked, unpacked
from veldspaat.plans import joins
from veldspaat.plans.shared import written

#: A term is common if the share of queries that ask it times that of texts that have it is above this: what a sum by a
#: matrix product takes of the time of one by its place.
COMMON = 0.002
#: Cells of a matrix, and sums by place, that a task holds at once.
CELLS = 1 << 22
#: Texts of a task's first block; later ones double, as fewer and fewer scores are among the best.
FIRST = 64
DIGITS = 6
#: Sums that are added up exactly at once.
EXACT = 1 << 13


@dataclass
class Asked:
    """The distinct queries put to one corpus. ``column`` is a term's place among the common ones, or -1."""

    corpus: object
    average: float
    terms: pa.Array
    column: np.ndarray
    common: tuple[np.ndarray, np.ndarray, np.ndarray]  # column, group and weight
    groups: np.ndarray  # of each query: those with the same common terms are a group
    start: np.ndarray  # of each term in the next two
    query: np.ndarray
    weight: np.ndarray


def _same(keys: list[bytes]) -> np.ndarray:
    """A number for each key, equal for equal ones, from 0 in order of appearance."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(x, len(seen)) for x in keys], np.int64)


def _signs(of: np.ndarray, n: int, terms: np.ndarray, weights: np.ndarray) -> list[bytes]:
    """What tells each of ``n`` queries from others: its terms and weights, which are sorted by query and term."""
    at = np.searchsorted(of, np.arange(n + 1))
    return [terms[a:z].tobytes() + weights[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)]


def asked_of(corpus: object, queries: pa.Table, known: pa.Table) -> tuple[Asked, pa.Table]:
    """The queries put to one corpus, (_q, terms, tf) packed, with its (term, _df, _n, _average), and (_q, _all, _key): each query with
    the number of its own sums (_all) and of its group's. What a query has twice counts twice."""
    rows, words = queries.combine_chunks().to_batches()[0], known["term"].combine_chunks()
    names, (terms, tf) = rows["_q"].dictionary_encode(), unpacked(rows)
    df, n_texts, n_terms, n = known["_df"].to_numpy(), known["_n"][0].as_py(), len(words), len(names.dictionary)
    code = pc.fill_null(pc.index_in(terms.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    q = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    there = code >= 0
    cells, same = np.unique(q[there] * n_terms + code[there], return_inverse=True)
    q, t = np.divmod(cells, n_terms)
    w = np.bincount(same, tf[there], len(cells)) * np.log1p((n_texts - df[t] + 0.5) / (df[t] + 0.5))
    unit = _same(_signs(q, n, t, w))  # equal queries once
    first = np.unique(unit, return_index=True)[1]
    once = np.isin(q, first)
    u, t, w = unit[q[once]], t[once], w[once]  # still sorted: units are numbered in order of appearance
    n_units = len(first)
    work = np.bincount(t, minlength=n_terms) * df / (n_units * max(n_texts, 1))
    chosen = np.argsort(-work, kind="stable")[: max(16, 4 * CELLS // n_units)]
    chosen = chosen[work[chosen] > COMMON]
    column = np.full(n_terms, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    common = column[t] >= 0
    groups = _same(_signs(u[common], n_units, t[common], w[common]))
    if 2 * len(np.unique(groups)) > n_units:
        groups = np.arange(n_units)
    lead = np.isin(u, np.unique(groups, return_index=True)[1]) & common
    rare = np.flatnonzero(~common)
    rare = rare[np.argsort(t[rare], kind="stable")]
    asked = Asked(
        corpus, known["_average"][0].as_py(), words, column, (column[t[lead]].astype(np.int32), groups[u[lead]].astype(np.int32), w[lead]), groups,
        np.searchsorted(t[rare], np.arange(n_terms + 1)), u[rare].astype(np.int32), w[rare],
    )
    keys = [unit] if len(np.unique(groups)) == n_units else [unit, groups[unit]]
    own = np.arange(len(keys) * n) < n
    return asked, pa.table({"_q": pa.concat_arrays([names.dictionary] * len(keys)), "_all": own, "_key": np.concatenate(keys)})


class Best:
    """The ``k`` best (score, text) of each key so far, and what a score must be above to become one. Texts are numbered, and come, in the order of their items."""

    def __init__(self, keys: int, k: int) -> None:
        self.k, self.least, self.waiting = k, np.zeros(keys), 0
        self.rows = [(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32))]

    def add(self, keys: np.ndarray, scores: np.ndarray, texts: np.ndarray) -> None:
        scores = np.round(scores, DIGITS)
        some = scores > 0
        self.rows.append((keys[some].astype(np.int32), scores[some], texts[some].astype(np.int32)))
        self.waiting += len(self.rows[-1][0])
        if self.waiting > max(4096, len(self.rows[0][0])):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, score, text = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((-score, key))  # stable: equal scores stay in the order they came in
        key, score, text = key[order], score[order], text[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        place = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        last, kept = place == self.k - 1, place < self.k
        self.least[key[last]] = np.maximum(score[last] - 0.6 * 10.0**-DIGITS, 0)  # what is rounded up to the same score may come first
        self.rows, self.waiting = [(key[kept], score[kept], text[kept])], 0
        return self.rows[0]


class Scores:
    """The best texts of a task for each query, and for each group by its common terms, block by block."""

    def __init__(self, asked: Asked, k: int, k1: float, b: float, cells: int, first: int) -> None:
        self.items: list[pa.Array] = []
        self.before = 0
        self.asked, self.k1, self.b, self.cells, self.size = asked, k1, b, cells, first
        self.units, self.n_groups = len(asked.groups), int(asked.groups.max()) + 1
        self.single, self.began = self.n_groups == self.units, False
        self.matrix = np.zeros((int(asked.column.max()) + 1, self.n_groups), np.float32 if self.single else np.float64)
        self.matrix[asked.common[0], asked.common[1]] = asked.common[2]
        self.queries, self.grouped = Best(self.units, k), Best(self.n_groups, k)
        if self.single:
            self.exact = np.zeros(self.matrix.shape[::-1])
            self.exact[asked.common[1], asked.common[0]] = asked.common[2]
            rare = np.bincount(asked.query, minlength=1).max()
            self.slack = (len(self.matrix) + rare + 8) * float(np.finfo(np.float32).eps)  # no sum of that many is more wrong

    def add(self, items: pa.Array, sizes: np.ndarray, terms: pa.ListArray, tf: np.ndarray) -> None:
        """Texts, in the order of their items, with their numbers of tokens, their terms and how often each occurs."""
        n, asked = len(items), self.asked
        code = pc.fill_null(pc.index_in(terms.flatten(), value_set=asked.terms), -1).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
        there = np.flatnonzero(code >= 0)
        code, text, tf = code[there], text[there], tf[there]
        gain = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * sizes[text] / asked.average))
        column = asked.column[code]
        common, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        common, rare = (text[common], column[common], gain[common]), (text[rare], code[rare], gain[rare])
        sums = np.concatenate([[0], np.cumsum(np.bincount(rare[0], np.diff(asked.start)[rare[1]], n))])
        begin = 0
        while begin < n:
            most = np.searchsorted(sums, sums[begin] + self.cells // 4, "right") - 1
            end = int(max(begin + 1, min(n, begin + self.size, most)))
            part = [[x[slice(*np.searchsorted(of[0], [begin, end]))] for x in of] for of in (common, rare)]
            self._block(end - begin, part[0], part[1], begin)
            self.size = min(2 * self.size, max(1, self.cells // max(self.matrix.shape)))
            begin = end
        self.items.append(items)
        self.before += n

    def _block(self, n: int, common: list[np.ndarray], rare: list[np.ndarray], begin: int) -> None:
        asked, here = self.asked, self.before + begin
        base = np.zeros((n, len(self.matrix)))
        base[common[0] - begin, common[1]] = common[2]
        if self.single:
            self._single(here, base, *self._rare(rare, begin))
            return
        base = base @ self.matrix
        at, group = np.nonzero(base > self.grouped.least)
        self.grouped.add(group, base[at, group], here + at)
        cell, gain = self._rare(rare, begin)
        if not len(cell):
            return
        if n * self.units <= 4 * len(cell):
            total = np.bincount(cell, gain, n * self.units)
            cell = np.flatnonzero(total)
            total = total[cell]
        else:
            cell, same = np.unique(cell, return_inverse=True)
            total = np.bincount(same, gain)
        at, unit = np.divmod(cell, self.units)
        group = asked.groups[unit]
        total += base[at, group]
        high = np.flatnonzero(total > np.maximum(self.queries.least[unit], self.grouped.least[group]))
        self.queries.add(unit[high], total[high], here + at[high])

    def _rare(self, rare: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
        """The place, by text and query, and the gain of each rare term that a text of a block and a query share."""
        times = np.diff(self.asked.start)[rare[1]]
        ends = np.cumsum(times)
        place = np.arange(times.sum()) + np.repeat(self.asked.start[rare[1]] - ends + times, times)
        return np.repeat((rare[0] - begin) * self.units, times) + self.asked.query[place], np.repeat(rare[2], times) * self.asked.weight[place]

    def _single(self, here: int, gains: np.ndarray, cell: np.ndarray, gain: np.ndarray) -> None:
        """A block of texts where each query is a group: sums that may be wrong by ``slack`` say which are added up exactly."""
        best, n = self.queries, len(gains)
        sums = gains.astype(np.float32) @ self.matrix
        np.add.at(sums.reshape(-1), cell, gain.astype(np.float32))
        least = best.least * (1 - self.slack)
        if not self.began and n > best.k:  # of the first block no more than its own best
            least = np.maximum(least, np.partition(sums, n - best.k, axis=0)[n - best.k] * (1 - 2 * self.slack) - 2 * 10.0**-DIGITS)
        self.began = True
        high = sums > least.astype(np.float32)
        place = np.flatnonzero(high)
        at, unit = np.divmod(place, self.units)
        score = np.zeros(len(place))
        for i in range(0, len(place), EXACT):
            score[i : i + EXACT] = np.einsum("ij,ij->i", gains[at[i : i + EXACT]], self.exact[unit[i : i + EXACT]])
        mine = np.flatnonzero(high.reshape(-1)[cell])
        score += np.bincount(np.searchsorted(place, cell[mine]), gain[mine], len(place))
        best.add(unit, score, here + at)


def _scored(index: DataFrame, shared: Broadcast[list[Asked]], k: int, k1: float, b: float) -> DataFrame:
    """(_p, _all, _key, _d, score): the best texts of each task for each query by all its terms, and for each group by the common ones."""
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}
    cells, first = CELLS, FIRST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[Scores | None] = [None] * len(shared.value)
        kind = {}
        for rows in batches:
            kind = {c: rows.schema.field(c).type for c in ("_p", "_d")}
            for i, asked in enumerate(shared.value):
                mine = rows.filter(pc.equal(rows["_p"], pa.scalar(asked.corpus, kind["_p"])))
                if mine.num_rows:
                    made[i] = made[i] or Scores(asked, k, k1, b, cells, first)
                    made[i].add(mine["_d"], mine["n_tokens"].to_numpy(zero_copy_only=False), *unpacked(mine))
        for scores in filter(None, made):
            items = pa.concat_arrays(scores.items)
            for own, best in ((True, scores.queries), (False, scores.grouped)):
                key, score, text = best.cut()
                corpus = pa.repeat(pa.scalar(scores.asked.corpus, kind["_p"]), len(key))
                found = pa.table({"_p": corpus, "_all": pa.repeat(own, len(key)), "_key": key.astype(np.int64), "_d": items.take(pa.array(text)), "score": score})
                yield from found.to_batches(max_chunksize=1 << 16)

    texts = index.select("_p", "_d", "n_tokens", "terms", "tf").coalesce(index.sparkSession.sparkContext.defaultParallelism)  # each task begins anew
    return texts.sortWithinPartitions("_d").mapInArrow(run, f"_p {kinds['_p']}, _all boolean, _key long, _d {kinds['_d']}, score double")


def best_scores(index: DataFrame, asked: DataFrame, known: DataFrame, *, k: int, k1: float, b: float) -> DataFrame:
    """(_q, _p, _d, score) with the ``k`` best texts of every query in each corpus at least, ties by item.

    ``index``: (_p, _d, n_tokens, terms, tf), each item once in a corpus; written tables: ``asked`` (_q, terms, tf), packed as the
    index, with _p if a query is put to that corpus only, and ``known`` (_p, term, _df, _n, _average). The queries are taken in
    batches of half of BROADCAST_BYTES, each brought to the driver with what is known of its terms and broadcast; nothing of
    the texts is, and the index isn't shuffled.
    """
    spark = index.sparkSession
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")  # tasks share the cores, not a task's threads
    n = max(1, -(-2 * joins.bytes_of(asked) // joins.BROADCAST_BYTES))
    found = known.join(asked.select("_q"), F.lit(False)).join(index.select("_p", "_d"), "_p").select("_q", "_p", "_d", F.lit(0.0).alias("score")).where("false")
    for i in range(n):
        best = _best(index, asked.where(F.pmod(F.xxhash64("_q"), F.lit(n)) == i), known, k, k1, b)
        found = found.unionByName(best) if best else found
    return found.groupBy("_q", "_p", "_d").agg(F.max("score").alias("score"))


def _best(index: DataFrame, asked: DataFrame, known: DataFrame, k: int, k1: float, b: float) -> DataFrame | None:
    """What ``best_scores`` gives for a batch of queries, written; None if nothing is known of their terms."""
    spark = index.sparkSession
    rows, words = asked.toArrow(), joins.sized_join(known, terms_asked(asked), ["term"], "left_semi").toArrow()
    corpora, names = [], []
    for p in words["_p"].unique():
        own = rows.filter(pc.equal(rows["_p"], p)) if "_p" in rows.column_names else rows
        if own.num_rows:
            put, keys = asked_of(p.as_py(), own, words.filter(pc.equal(words["_p"], p)))
            corpora.append(put)
            names.append(keys.append_column("_p", pa.repeat(p, keys.num_rows)))
    if not corpora:
        return None
    shared = spark.sparkContext.broadcast(corpora)
    place = F.row_number().over(Window.partitionBy("_p", "_all", "_key").orderBy(F.desc("score"), F.asc("_d")))
    best = _scored(index, shared, k, k1, b).withColumn("_place", place).where(F.col("_place") <= k)
    best = written(best.join(spark.createDataFrame(pa.concat_tables(names)), ["_p", "_all", "_key"]).select("_q", "_p", "_d", "score"), "best")
    shared.destroy()
    return best
