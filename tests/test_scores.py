"""BM25 for many queries: equal to adding every score up, and no row is made per query and text."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veldspaat.operators import scores
from veldspaat.operators.retrieval import bm25
from veldspaat.plans import joins
from veldspaat.queries import composed, retrieval

FIXED = "uitsluiting dekking eigen risico"


def _most_rows(spark, run):
    """The most rows that any operator of what ``run`` runs gives."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsList().size()
    run()
    bus.waitUntilEmpty(30_000)
    most = 0
    done = store.executionsList()
    for i in range(before, done.size()):
        values, metrics = store.executionMetrics(done.apply(i).executionId()), done.apply(i).metrics()
        for j in range(metrics.size()):
            value = values.get(metrics.apply(j).accumulatorId())
            if metrics.apply(j).name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return most


def _clauses(spark, folder, products, each):
    rows = [(n * each + i, f"Polis {'Ruim' if n % 3 else 'Basis'} N{n}", f"c{i}", "kop", f"{FIXED} woord{i}", "dekking", f"V{n % 4}") for n in range(products) for i in range(each)]
    spark.createDataFrame(rows, "rij_id long, product string, clausule_id string, kop string, tekst string, type string, verzekeraar_of_bron string").write.parquet(f"{folder}/polisvoorwaarden.parquet")


def test_products_are_compared_without_a_row_per_product_and_clause(spark, tmp_path):
    _clauses(spark, str(tmp_path), 300, 4)
    found = []
    assert _most_rows(spark, lambda: found.extend(retrieval.clause_compare(spark, str(tmp_path)).collect())) < 300 * 1200 / 10
    assert len(found) == 300 * 6 and {r.rij_id // 4 for r in found if r["rank"] <= 4 and r.product.endswith(" N123")} == {123}


@pytest.fixture
def words():
    """Texts and queries of words from very common to rare, some of them equal or empty."""
    draw = random.Random(7)

    def text(most):
        return " ".join(f"w{int(60 ** draw.random())}x" for _ in range(draw.randrange(most)))

    texts = [(f"d{n:03d}" if n else None, "ab"[n % 2], text(25)) for n in range(160)]
    queries = [(n, text(9)) for n in range(70)]
    return texts + [(f"e{d}", c, t) for d, c, t in texts[:40]], queries + [(n + 100, t) for n, t in queries[:20]] + [(900, None), (901, "niets")]


def _brute(texts, queries, k):
    out = set()
    for c in "ab":
        own = [(d or "", t.split()) for d, x, t in texts if x == c]
        average = sum(len(t) for _, t in own) / len(own)
        df = {w: sum(w in t for _, t in own) for _, t in own for w in t}
        for q, asked in queries:
            got = []
            for d, t in own:
                s = sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in (asked or "").split() if w in t)
                got += [(-round(s, 6), d)] if s else []
            out |= {(q, c, d, -s, i + 1) for i, (s, d) in enumerate(sorted(got)[:k])}
    return out


@pytest.mark.parametrize(("limits", "batch"), [({}, 32 << 20), ({"CELLS": 200, "FIRST": 1, "COMMON": 0.05}, 4000), ({"COMMON": 2}, 32 << 20), ({"COMMON": 0, "CELLS": 5000}, 32 << 20)])
def test_best_scores_equal_all_scores(spark, monkeypatch, words, limits, batch):
    """Whatever is taken for common, in blocks and batches of any size, ties by item."""
    for name, value in limits.items():
        monkeypatch.setattr(scores, name, value)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", batch)
    texts, queries = (spark.createDataFrame(rows, s) for rows, s in zip(words, ("d string, c string, t string", "q int, t string"), strict=True))
    got = bm25(texts.repartition(3, "d"), queries, item="d", text=F.col("t"), query="q", query_text=F.col("t"), k=5, part="c").collect()
    assert {(r.q, r.c, r.d or "", r.score, r["rank"]) for r in got} == _brute(*words, 5) and len(got) == len(_brute(*words, 5))


def test_sides_are_found_without_a_row_per_product_and_clause(spark, tmp_path):
    _clauses(spark, str(tmp_path), 300, 4)
    found = []
    assert _most_rows(spark, lambda: found.extend(composed.clause_sides(spark, str(tmp_path)).collect())) < 300 * 1200 / 10
    assert len(found) == 2 * 6 * (300 - 4) and {r.kant for r in found} == {"A", "B"}


def test_tasks_search_without_a_row_per_complaint_and_text(spark, tmp_path):
    _clauses(spark, str(tmp_path), 50, 6)
    texts = [(100 * n, f"klacht over {FIXED} a{n} b{n % 7}") for n in range(300)]
    for name, whole in (("kifid", "kern_klacht"), ("wetgeving", "tekst")):
        empty = [F.lit(None).cast("string").alias(c) for c in (*retrieval.FIELDS[name], "audit_bevinding") if c != whole]
        spark.createDataFrame(texts, f"rij_id long, {whole} string").select("*", *empty, F.lit(True).alias("bron_geverifieerd")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = []
    assert _most_rows(spark, lambda: found.extend(retrieval.task_sources(spark, str(tmp_path)).collect())) < 300 * 300
    first = {(r.functie, r.req.rpartition("-")[2], r.rij_id) for r in found if r["rank"] == 1 and r.corpus == "kifid" and "-" in r.req}
    assert first == {(t, str(100 * n), 100 * n) for t in ("precedentzoeker", "afwijzingsanalyse", "begripsuitleg") for n in range(300)}


def test_tasks_make_no_row_per_text_and_term(spark, tmp_path):
    _clauses(spark, str(tmp_path), 50, 6)
    texts = [(n, " ".join(f"w{i}x" for i in range(n % 5, 60))) for n in range(300)]
    for name, whole in (("kifid", "kern_klacht"), ("wetgeving", "tekst")):
        empty = [F.lit(None).cast("string").alias(c) for c in (*retrieval.FIELDS[name], "audit_bevinding") if c != whole]
        spark.createDataFrame(texts, f"rij_id long, {whole} string").select("*", *empty, F.lit(True).alias("bron_geverifieerd")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = []
    assert _most_rows(spark, lambda: found.extend(retrieval.task_sources(spark, str(tmp_path)).collect())) < 2 * 300 * 58 / 10
    best = [(r.req, r.rij_id) for r in found if r["rank"] == 1 and r.corpus == "kifid" and r.functie == "precedentzoeker"]
    assert sorted(best) == [(f"precedentzoeker-{n}", 0) for n in (0, 100, 200)]


def test_every_complaint_is_put_to_every_task(spark, tmp_path):
    """Whatever its id; equal complaints are searched once and answered each."""
    _clauses(spark, str(tmp_path), 5, 2)
    texts = [(n, f"klacht{n % 150}x over {FIXED} b{n % 7}" if n else None) for n in range(301)]
    for name, whole in (("kifid", "kern_klacht"), ("wetgeving", "tekst")):
        empty = [F.lit(None).cast("string").alias(c) for c in (*retrieval.FIELDS[name], "audit_bevinding") if c != whole]
        spark.createDataFrame(texts, f"rij_id long, {whole} string").select("*", *empty, F.lit(True).alias("bron_geverifieerd")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = retrieval.task_sources(spark, str(tmp_path)).collect()
    own = ("dekkingscheck", "precedentzoeker", "polisvergelijker", "afwijzingsanalyse", "begripsuitleg")
    assert {r.req for r in found if "-" in r.req} == {f"{t}-{n}" for t in own for n in range(1, 301)}
    assert len(found) == len({(r.req, r.corpus, r["rank"]) for r in found}) and {r.req for r in found if "-" not in r.req} <= {"dossiercheck", "klachtroute", "adviesnotitie"}
    best = {int(r.req.rpartition("-")[2]): r.rij_id for r in found if r["rank"] == 1 and r.functie == "precedentzoeker"}
    assert all((best[n] - n) % 150 == 0 for n in range(1, 301))


def test_all_tasks_make_no_row_per_text_and_term(spark, tmp_path):
    """With every complaint asked: 300, of which 5 differ."""
    _clauses(spark, str(tmp_path), 50, 6)
    texts = [(n, " ".join(f"w{i}x" for i in range(n % 5, 600))) for n in range(300)]
    for name, whole in (("kifid", "kern_klacht"), ("wetgeving", "tekst")):
        empty = [F.lit(None).cast("string").alias(c) for c in (*retrieval.FIELDS[name], "audit_bevinding") if c != whole]
        spark.createDataFrame(texts, f"rij_id long, {whole} string").select("*", *empty, F.lit(True).alias("bron_geverifieerd")).write.parquet(f"{tmp_path}/{name}.parquet")
    found = []
    assert _most_rows(spark, lambda: found.extend(retrieval.task_sources(spark, str(tmp_path)).collect())) < 2 * 300 * 598 / 10
    assert len([r for r in found if r["rank"] == 1 and r.corpus == "kifid" and r.functie == "precedentzoeker"]) == 300
