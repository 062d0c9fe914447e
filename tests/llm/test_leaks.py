import random
import re

import pytest

from veldspaat.llm.leaks import leaked_passages
from veldspaat.plans import joins


def brute(items, docs, n):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    windows = {}
    for i, t in items:
        v = w(t)
        for k in range(len(v) - n + 1):
            windows.setdefault(tuple(v[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        v = w(t)
        for k in range(len(v) - n + 1):
            out |= {(i, d) for i in windows.get(tuple(v[k : k + n]), ()) if d is not None}
    return out


def run(spark, items, docs, n, **more):
    a = spark.createDataFrame([(*x, 1) for x in items], "item long, tekst string, term int")
    b = spark.createDataFrame([(*x, "c") for x in docs], "doc long, text string, term string")
    return leaked_passages(a, b, item="item", item_text="tekst", doc="doc", text="text", length=n, **more)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(12)] + [(90, None), (91, ""), (92, "te kort")]
    docs = []
    for d in range(150):
        w = rng.choices(vocabulary, k=60)
        if rng.random() < 0.5:
            src = items[rng.randrange(12)][1].split()
            at, size = rng.randint(0, 15), rng.randint(3, 15)
            w[20 : 20 + size] = src[at : at + size]
        docs.append((d, rng.choice([", ", "\n", " — "]).join(w).upper()))
    docs += [(900, None), (901, ""), (None, items[0][1]), docs[0], (902, items[3][1] + " x " + items[3][1])]
    if seed == 2:  # everything shuffled, hot terms and items spread
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_ROWS", 3)
    got = run(spark, items, docs, 6)
    assert {(r.item, r.doc) for r in got.where("kind = 'exact'").collect()} == brute(items, docs, 6)


def test_places_and_near(spark):
    words = [f"woord{i}" for i in range(30)]
    changed = [*words[:8], "anders", *words[9:16], "weer", *words[17:25]]
    got = {(r.item, r.doc): r for r in run(spark, [(1, " ".join(words))], [(1, "kop " + " ".join(words)), (2, " ".join(changed))], 13).collect()}
    assert (got[1, 1].kind, got[1, 1].item_start, got[1, 1].doc_start, got[1, 1].n_words) == ("exact", 0, 1, 30)
    assert (got[1, 2].kind, got[1, 2].n_words) == ("near", 15)


def test_one_item_in_a_third_of_the_documents(spark, monkeypatch):
    """The hot item and its terms are spread, and every document is found."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    hot, other = " ".join(f"heet{i}" for i in range(20)), " ".join(f"koud{i}" for i in range(20))
    docs = [(d, f"begin{d} {hot if d % 3 == 0 else other if d % 50 == 1 else ''} eind{d}") for d in range(900)]
    got = run(spark, [(1, hot), (2, other)], docs, 13)
    assert {(r.item, r.doc) for r in got.collect()} == brute([(1, hot), (2, other)], docs, 13)


def test_empty(spark):
    assert run(spark, [], [(1, "a b c")], 3).count() == 0
    assert run(spark, [(1, "a b c d")], [], 3).count() == 0
