import datetime as dt

from pyspark.sql import functions as F

from veldspaat.functions import rulings as r
from veldspaat.operators.clauses import cut_clauses, foreign_stretches
from veldspaat.operators.gate import print_check
from veldspaat.operators.passages import NOTHING, prompt

FWD = (
    "Uitspraak 2024-0001 Datum uitspraak 3 maart 2024 Aard uitspraak Niet-bindend advies Uitkomst Vordering afgewezen Relevante bepalingen geen Bijlage\n"
    "1. De kern De consument wil dat de verzekeraar de schade aan zijn dak alsnog vergoedt.\n2. Procedure Conclusie " + "De vordering slaagt niet omdat de schade niet onder de dekking valt en de termijn verstreken is. " + "3/7\n"
    "3. De beslissing De Commissie wijst de vordering af. 4/7 Deze uitspraak is definitief."
)
REV = "3 maart 2024 Datum uitspraak Bindend advies Aard uitspraak Vordering toegewezen Uitkomst"


def read(spark, text):
    c = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(
        r.layout(c).alias("layout"), r.nature(c).alias("n"), r.printed_date(c).alias("date"), r.printed_outcome(c).alias("out"), r.complaint(c).alias("kern"), r.decision(c).alias("dec"), r.conclusion(c).alias("con")
    )
    return row.first()


def test_both_layouts_and_neither(spark):
    a = read(spark, FWD)
    assert (a.layout, a.n.aard, a.n.bindend, a.date, a.out) == ("fwd", "Niet-bindend advies", False, dt.date(2024, 3, 3), "Vordering afgewezen")
    assert a.kern.startswith("De consument wil") and a.dec == "De Commissie wijst de vordering af." and a.con.endswith("verstreken is.")
    b = read(spark, REV)
    assert (b.layout, b.n.aard, b.n.bindend, b.date, b.out) == ("rev", "Bindend advies", True, dt.date(2024, 3, 3), "Vordering toegewezen")
    assert b.kern is None and b.dec is None and b.con is None
    for text in ("niets", "", None):
        c = read(spark, text)
        assert (c.layout, c.n.aard, c.n.bindend, c.date, c.out, c.kern, c.dec, c.con) == (None,) * 8


def test_cut_clauses(spark):
    docs = spark.createDataFrame([("d", "Art. 1 Dekking\nWij dekken schade.\nArt. 2 Uitsluiting"), ("e", None)], "doc string, body string")
    specs = spark.createDataFrame([("d", "1", "Art. 1", "Art. 2"), ("d", "2", "Art.", "Art. 2"), ("x", "3", "a", "b")], "doc string, id string, van string, tot string")
    got = {x.id: (x.cut, x.error) for x in cut_clauses(docs, specs, on="doc", text="body", start="van", end="tot").collect()}
    assert got == {"1": ("Art. 1 Dekking Wij dekken schade.", None), "2": (None, "start 2x")}


def test_foreign_stretches(spark):
    a, b = "de eerste lange gemeenschappelijke zin ", "en een tweede lange gemeenschappelijke zin"
    df = spark.createDataFrame([(a + "INGEVOEGD " + b, a + b), (None, a), ("", a)], "p string, w string")
    assert [[y.strip() for y in x.g] for x in df.select(foreign_stretches(F.col("p"), F.col("w")).alias("g")).collect()] == [["INGEVOEGD"], [], []]


def test_print_check(spark):
    rows = [("u", 200, "%PDF", "nr 1 ja", "1", None), ("u", 200, "%PDF", "leeg", "1", None), ("u", 404, None, None, "1", None), (None, 200, "%PDF", "1", "1", None), ("u", 200, "%PDF", "1", "1", "fout"), ("u", 200, "%PDF", "1", None, None)]
    df = spark.createDataFrame(rows, "a string, s int, m string, t string, n string, au string")
    got = df.select(print_check(*[F.col(c) for c in ("a", "s", "m", "t", "n", "au")]).alias("c")).select("c.verified").collect()
    assert [x.verified for x in got] == [True, False, False, False, False, False]


def test_prompt(spark):
    texts = [x.p for x in spark.createDataFrame([("CTX",), ("",), (None,)], "c string").select(prompt(F.col("c")).alias("p")).collect()]
    assert texts[0].endswith("BRONNEN\nCTX") and texts[1] == texts[2] and texts[1].endswith(NOTHING)
