import os

import pytest
from pyspark.sql import functions as F

from veldspaat.llm.mixture import PATTERN, TOKENIZER, _encodings, count_tokens, mixture, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the tokenizer file")
RECIPES = "recept string, source string, gewicht double, keer int, deel double, tokens string"


def run(spark, docs, recipes, seed=0):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc long, source string, text string, tokens int")
    r = spark.createDataFrame([(*x, "c") for x in recipes], RECIPES)
    return mixture(d, r, doc="doc", source="source", text="text", recipe="recept", weight="gewicht", repeats="keer", budget="deel", seed=seed)


def test_counts(spark):
    encode = _encodings(TOKENIZER)[0].encode_ordinary
    texts = [None, "", "Een polis dekt schade.", "x" * 1000, " " * 5000, "één\n\n<|endoftext|> twee", "woord " * 60_000, "a," * 75_000, "x" * 250_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.tokens for r in token_counts(df, ids=["id"], text=F.col("t")).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def test_long_white_space_is_split_as_the_pattern_says():
    import regex

    encode = _encodings(TOKENIZER)[0].encode_ordinary
    piece = _encodings(TOKENIZER)[1].encode_ordinary
    for run in (" " * 10_000, "\n" * 12_000, " \n\t" * 4_000, "\u2003" * 10_001, " " * 9_999):
        for text in (run, f"een{run}", f"{run}twee", f"een{run}twee", f"een {run}. {run}drie"):
            assert count_tokens(text, TOKENIZER) == sum(len(piece(p)) for p in regex.findall(PATTERN, text))
    short = "een" + " " * 300 + "twee"
    assert len(encode(short)) == sum(len(piece(p)) for p in regex.findall(PATTERN, short))


def test_shares_and_caps(spark):
    docs = [(i, "groot", f"tekst nummer {i} over schade en dekking") for i in range(2000)]
    docs += [(10_000 + i, "klein", f"klein stuk {i} over premie") for i in range(40)] + [(20_000, None, "zonder bron"), (20_001, "leeg", ""), (20_002, "leeg", None), (20_003, "anders", "telt mee")]
    recipes = [("a", "groot", 3.0, 1, 0.5), ("a", "klein", 1.0, 4, 0.5), ("a", "weg", 1.0, None, 0.5), ("a", "leeg", None, 2, 0.5), ("b", "klein", 1.0, None, 5.0), ("b", None, 1.0, 1, 5.0)]
    uses, shares = run(spark, docs, recipes)
    rows = {(r.recipe, r.source): r for r in shares.collect()}
    assert set(rows) == {("a", "groot"), ("a", "klein"), ("a", "weg"), ("a", "leeg"), ("b", "klein")}
    assert rows["a", "klein"].rate == 4.0 and rows["a", "weg"].actual_tokens == 0 == rows["a", "leeg"].actual_share
    assert rows["b", "klein"].rate == 1.0 and rows["b", "klein"].actual_share == 1.0
    assert abs(rows["a", "groot"].actual_tokens / rows["a", "groot"].wanted_tokens - 1) < 0.1
    assert abs(sum(r.actual_share for r in rows.values() if r.recipe == "a") - 1) < 1e-9
    drawn = uses.collect()
    assert {r.uses for r in drawn if r.recipe == "a" and r.source == "klein"} == {4} and {r.uses for r in drawn if r.source == "groot"} == {1}
    assert {r.source for r in drawn} == {"groot", "klein"}
    again = run(spark, docs[::-1], recipes)[0].collect()
    assert {(r.recipe, r.doc, r.uses) for r in drawn} == {(r.recipe, r.doc, r.uses) for r in again}
    assert {r.doc for r in run(spark, docs, recipes, seed=1)[0].collect() if r.recipe == "a"} != {r.doc for r in drawn if r.recipe == "a"}


def test_empty(spark):
    uses, shares = run(spark, [], [("a", "x", 1.0, 1, 0.5)])
    assert uses.count() == 0 and shares.first().actual_tokens == 0
    uses, shares = run(spark, [(1, "x", "tekst")], [])
    assert uses.count() == shares.count() == 0
