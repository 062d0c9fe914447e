import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspaat.llm.charhash import code_points, prime_hashes, sliding, word_hashes
from veldspaat.llm.spans import shared_spans, winnowed

SCHEMA = "bron string, id long, zaak string, tekst string, _hash int, share string"


def spans(spark, rows, length):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    out = shared_spans(df, ids=["bron", "id"], owner=F.col("zaak"), text=F.col("tekst"), length=length)
    return {(r.bron, r.id): [(s.start, s.stop) for s in r.spans] for r in out.collect()}


def brute(rows, length):
    texts = {(b, i): (t or "", z if z is not None else (b, i)) for b, i, z, t in rows}
    owners = {}
    for t, z in texts.values():
        for s in range(len(t) - length + 1):
            owners.setdefault(t[s : s + length], set()).add(z)
    out = {}
    for key, (t, _) in texts.items():
        merged = []
        for s in range(len(t) - length + 1):
            if len(owners[t[s : s + length]]) > 1:
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], s + length)
                else:
                    merged.append((s, s + length))
        if merged:
            out[key] = merged
    return out


def test_rolling_equals_direct():
    text = code_points("abé\U0001f600" * 50 + "x" * 30)
    for f in (prime_hashes, word_hashes):
        h = f(text, 7)
        assert len(h) == len(text) - 6
        assert all(h[i] == f(text[i : i + 7], 7)[0] for i in range(len(h)))
    v = np.array([5, 3, 8, 1, 9, 9])
    assert sliding(v, 3, np.minimum).tolist() == [3, 1, 1, 1]


def test_equal_spans_keep_equal_windows():
    rng = random.Random(1)
    for _ in range(50):
        span = "".join(rng.choices("ab ", k=40))
        texts = ["".join(rng.choices("ab ", k=rng.randint(0, 30))) + span + "".join(rng.choices("ab ", k=5)) for _ in range(2)]
        kept = [set(winnowed(code_points(t), np.array([len(t)]), 40)[1].tolist()) for t in texts]
        assert kept[0] & kept[1]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    block = ["".join(rng.choices("abcd é", k=60)) for _ in range(4)]
    rows = []
    for i in range(40):
        text = "".join(rng.choice(block)[rng.randint(0, 30) :] if rng.random() < 0.5 else "".join(rng.choices("abcd ", k=25)) for _ in range(4))
        rows.append((rng.choice("pk"), i, rng.choice([None, "z1", "z2"]), text))
    rows += [("p", 100, None, None), ("p", 101, None, ""), ("p", 102, None, "kort"), rows[0]]
    assert spans(spark, rows, 20) == brute(rows, 20)


def test_copies_repeats_and_long_texts(spark):
    text = "woord " * 40
    rows = [("p", i, None, "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(60)) + text) for i in range(30)]  # a span that all share
    rows += [("k", 1, "zelfde", "q" * 300), ("k", 2, "zelfde", "q" * 300), ("k", None, None, text), ("x", 9, None, "y" * 50_000)]
    assert spans(spark, rows, 160) == brute(rows, 160)
    assert spans(spark, [rows[0], rows[0]], 160) == {}
    assert spans(spark, [], 160) == {}
