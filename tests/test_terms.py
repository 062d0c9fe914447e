"""Terms counted in Arrow batches: equal to ``tokens``, and no row is made per text and term."""

import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veldspaat.functions.text import STOPWORDS, tokens
from veldspaat.operators import terms
from veldspaat.operators.retrieval import term_index

ODD = [None, "", " ", ":", "a", "é", "ab", "4:22a", "art. 4:22ab:3 b", "1:2:3a:4", "1:2a:3bc:d4", "a:1:", ":1:2", "x:é1", "x:1é:2", "ÀÉ÷ÿ×ß", "é" * 6, "é" * 5 + "en", "bevindingen", "gezinsheden",
       "kosten", "kostenen", "leners", "123456789", "12:345678s", "Het een VAN", "İstanbul Kelvin Ångström", "ΑΣ ς 漢字ab😀cd", "ab́cd", "x\ny\r\nzz", "\x00ab\x00"]


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_terms_equal_tokens(spark, monkeypatch, piece):
    """For odd texts, alone and next to each other in pieces of any size."""
    monkeypatch.setattr(terms, "PIECE", piece)
    draw = random.Random(5)
    signs = ["a", "b", "z", "1", "23", ":", ":", " ", ".", "é", "÷", "×", "S", "EN", "ingen", "heden", *STOPWORDS[:3], "ς", "漢", "-"]
    texts = ODD + ["".join(draw.choices(signs, k=draw.randrange(14))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "d int, t string").repartition(2, "d")
    want = {r.d: r.t for r in rows.select("d", tokens(F.col("t")).alias("t")).collect()}
    got = term_index(rows, item="d", text=F.col("t")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, list(zip(r.terms.split(), struct.unpack(f"<{len(r.tf) // 4}i", r.tf), strict=True))) == (len(want[r.d]), sorted(Counter(want[r.d]).items())), texts[r.d]
