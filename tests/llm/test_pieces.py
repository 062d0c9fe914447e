import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspaat.llm.pieces import cut, longest_stretch, split_texts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\r;!é\U0001f600\xa0", max_size=400), st.integers(4, 60), st.data())
def test_pieces_lose_nothing(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    parts = cut(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and parts[-1][2] == "end"
    assert all(b - a <= limit for a, b, _ in parts)
    assert all(c == b - overlap and d > b for (a, b, _), (c, d, _) in zip(parts, parts[1:], strict=False))
    for _, stop, kind in parts[:-1]:
        if kind == "line":
            assert text[stop - 1] in "\r\n"
        if kind == "sentence":
            assert text[stop - 1].isspace() and text[stop - 2] in ".!?;"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n;\xa0", max_size=200))
def test_longest_stretch(text):
    assert longest_stretch(text) == max(map(len, re.split(r"[\r\n]|(?<=[.!?;])\s", text)))


def test_natural_ends_where_there_are_some():
    text = "Een zin van redelijke lengte staat hier. " * 100
    parts = cut(text, 200, 20)
    assert all(kind == "sentence" for _, _, kind in parts[:-1])
    assert max(b - a for a, b, _ in parts) - min(b - a for a, b, _ in parts[:-1]) <= 90
    assert {kind for _, _, kind in cut("woord " * 100, 200, 20)[:-1]} == {"space"}
    assert {kind for _, _, kind in cut("x" * 1000, 200, 20)[:-1]} == {"inside"}


def test_table(spark):
    rows = [(1, "kort", 5), (2, None, 5), (3, "", 5), (4, "zin. " * 500, 5), (4, "zin. " * 500, 5), (5, "y" * 100_000, 5)]
    df = spark.createDataFrame(rows, "id int, tekst string, piece int")
    out = split_texts(df, ids=["id"], text=F.col("tekst"), limit=1500, overlap=150)
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {1, 3, 4, 5} and len(got[1]) == len(got[3]) == 1 and got[3][0].text == ""
    assert len(got[4]) == 2 * got[4][0].pieces and got[5][0].longest_stretch == 100_000
    whole = sorted(got[5], key=lambda r: r.piece)
    assert whole[0].text + "".join(r.text[150:] for r in whole[1:]) == "y" * 100_000
    assert split_texts(df.where("id > 9"), ids=["id"], text=F.col("tekst")).count() == 0
