"""Records composed from prints, pages and manifests; events; corpora that can't be read."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veldspaat.functions import addresses as a
from veldspaat.functions import rulings as r
from veldspaat.functions.citations import basis_parts, starts
from veldspaat.functions.text import clause_between, cleaned
from veldspaat.operators.events import REFUSAL, REFUSED, answer_events
from veldspaat.operators.records import described, in_order, joined_pages, live, merged_sets, ruling_records, united, with_parts
from veldspaat.sources.corpora import load_status, read_corpus, schema_of

TICKS = (dt.date(2020, 3, 3) - dt.date(1, 1, 1)).days * 86_400 * 10_000_000
ITEM = "title string, text string, ticks long, url string, category string, summary string, authority string, defendant string, tags string, pdf_url string, thema string, extra int"
PRINT = """Uitspraak Aard uitspraak Bindend advies Datum uitspraak 3 maart 2020 Uitkomst Vordering afgewezen Bijlage 1
1. De kern De consument vindt dat zijn verzekeraar de schade aan het dak had moeten vergoeden, ook na de storm.
2. Procedure Er was een zitting.
Conclusie De verzekeraar hoeft niet te betalen, omdat de termijn om de schade te melden al maanden verstreken was. Conclusie En dat blijft zo.
3. De beslissing De Commissie wijst de vordering af. Deze uitspraak is bindend."""


def test_ruling_record(spark):
    rows = [
        ("Uitspraak  2020-123", PRINT, TICKS, "https://u", " dak ", "<p>kort &amp; goed</p>", "Kifid", "X", "a, b,", "https://p", "storm", 1),
        ("zonder", "tekst nr. 2021-4567 Deze uitspraak is bindend", None, "https://v", None, None, None, None, None, None, None, 1),
        ("2020-123", None, None, "https://u", None, None, None, None, None, None, None, 1),
        ("geen nummer", PRINT, None, "https://u", None, None, None, None, None, None, None, 1),
        ("2020-124", PRINT, None, None, None, None, None, None, None, None, None, 1),
        (None, "", None, "", None, None, None, None, None, None, None, None),
    ]
    found = ruling_records(spark.createDataFrame(rows, ITEM), theme=F.col("thema"), fetched=F.lit("2024-01-01"))
    assert len(found.columns) == 24
    by = {x.uitspraaknummer: x for x in found.collect()}
    assert set(by) == {"2020-123", "2021-4567"}
    x, y = by["2020-123"], by["2021-4567"]
    assert (x.titel, x.datum, x.datum_uit_api, x.categorie, x.samenvatting, x.kifid_onderwerp_tags) == ("Uitspraak 2020-123", "2020-03-03", "2020-03-03", "dak", "kort & goed", ["a", "b"])
    assert (x.oordeel, x.bindend, x.aard_uitspraak_letterlijk, x.uitkomst_letterlijk, x.kop_layout) == ("ongegrond", True, "Bindend advies", "Vordering afgewezen", "fwd")
    assert x.kernoverweging.startswith("De verzekeraar hoeft") and x.kernoverweging.endswith("blijft zo.") and x.kernoverweging_bron.startswith("Conclusie")
    assert (y.bindend, y.aard_uitspraak_letterlijk, y.datum, y.kern_klacht, y.kernoverweging, y.thema) == (True, "Deze uitspraak is bindend", None, None, None, None)
    assert found.where("false").count() == 0


def test_conclusion_runs_over_its_own_heading(spark):
    text = "Conclusie eerst " + "woord " * 20 + "Conclusie daarna " + "tekst " * 20 + "De beslissing x"
    got = spark.createDataFrame([(text,)], "t string").select(r.conclusion(F.col("t"))).first()[0]
    assert got.startswith("eerst") and got.endswith("tekst") and "daarna" in got


def test_live_and_print_checks(spark):
    df = spark.createDataFrame([(1, 200), (2, 206), (3, 404), (4, None)], "id int, s int")
    assert [x.id for x in live(df, F.col("s")).collect()] == [1]
    assert [x[0] for x in df.select(a.reachable(F.col("s"))).collect()] == [True, True, False, False]
    kept = spark.createDataFrame([(1025, "%PDF-1"), (1024, "%PDF-1"), (9999, "<html"), (None, None)], "n int, h string").select(a.print_kept(F.col("n"), F.col("h")))
    assert [x[0] for x in kept.collect()] == [True, False, False, False]
    assert spark.range(1).select(a.print_key(F.lit("a")), a.file_name(F.lit("x/y.pdf?z=1"))).first()[:] == ("86f7e437faa5a7fce15d1ddcb9eaeaea377667b8.pdf", "y.pdf")


def test_blocked_pages(spark):
    texts = ["een gewone pagina", "ACCESS DENIED", "Even geduld, uw browser", "x" * 3000 + "access denied", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(a.captured(F.lit(6000), F.col("t"))).collect()
    assert [x[0] for x in got] == [True, False, False, True, True]


@pytest.mark.parametrize("basis,want", [("BW:7:958:5", ("BW:7:958", "5")), ("BW:7:955", ("BW:7:955", None)), ("BGfo:86c", ("BGfo:86c", None)), ("Wft:4:23", ("Wft:4", "23")), (None, (None, None))])
def test_basis_parts(spark, basis, want):
    got = spark.createDataFrame([(basis,)], "b string").select(basis_parts(F.col("b")).alias("p")).first().p
    assert (got.key, got.member) == want


def test_starts_of_many_matches(spark):
    text = "".join(f"é{i} x " for i in range(400))
    got = spark.createDataFrame([(text,), ("",), (None,), ("x",)], "t string").select(starts(F.col("t"), "x")).collect()
    assert got[0][0] == [i for i, c in enumerate(text) if c == "x"] and got[1][0] == [] and got[2][0] is None and got[3][0] == [0]


def test_pages_are_joined_in_order_and_cleaned(spark):
    rows = [("d", 2, "twee-\nde café"), ("d", 1, "een \t \n12\nslot­"), ("d", 3, None), ("e", 1, ""), (None, 1, "los")]
    got = {x.doc: (x.n_pages, x.text) for x in joined_pages(spark.createDataFrame(rows, "doc string, nr int, t string"), document=["doc"], page=["nr"], text="t").collect()}
    assert got == {"d": (3, "een\nslot\ntweede café\n"), "e": (1, ""), None: (1, "los")}


def test_clause_with_lead_and_paragraphs(spark):
    text = "Voor  af\nArt. 1 Dekking Wij\nvergoeden\n• brand\n• storm\nArt. 2 Slot\nArt. 3 a Art. 3 b"
    rows = [("Art. 1", "Art. 2", None), ("Art. 1", "Art. 2", "Art. 1  Dekking"), ("Art. 1", "Art. 2", "Anders"), ("Art. 3", None, None), ("Art. 2", None, None), ("Art. 9", "Art. 2", None), ("Art. 2", "Art. 1", None)]
    got = spark.createDataFrame([(text, *x) for x in rows], "t string, a string, b string, k string").select(clause_between(F.col("t"), F.col("a"), F.col("b"), F.col("k")).alias("c")).collect()
    assert [x.c[:] for x in got] == [
        ("Art. 1 Dekking Wij vergoeden\n• brand\n• storm", None),
        ("Wij vergoeden\n• brand\n• storm", None),
        (None, "lead not at the beginning"),
        (None, "start 2x"),
        ("Art. 2 Slot Art. 3 a Art. 3 b", None),
        (None, "start 0x"),
        (None, "end before start"),
    ]


def test_composed_characters(spark):
    got = spark.createDataFrame([("één",), (None,), ("",)], "t string").select(cleaned(F.col("t"))).collect()
    assert [x[0] for x in got] == ["één", None, ""]


def test_files_and_manifests(spark):
    files = spark.createDataFrame([("a.png",), ("b.c.jpg",), ("a.png",), (None,)], "file string")
    manifest = spark.createDataFrame([("a.png", "Naam", None), ("z.png", "Z", "z")], "file string, naam string, tekst string")
    got = [tuple(x) for x in described(files, manifest, file="file", name="naam", description="tekst").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [("a.png", "Naam", ""), ("b.c.jpg", "b.c", ""), ("a.png", "Naam", ""), (None, None, "")]))
    parts = spark.createDataFrame([("a.png", 2), ("a.png", 1), ("a.png", 2)], "file string, deel int")
    assert {(x.file, tuple(x.delen)) for x in with_parts(files, parts, file="file", part="deel", name="delen").collect()} == {("a.png", (1, 2)), ("b.c.jpg", ()), (None, ())}
    place = spark.createDataFrame([("a.png", 3)], "file string, plaats int")
    ordered = in_order(files, place, key="file", place="plaats", first=F.col("file").contains("b")).where("file is not null").distinct().orderBy("plaats").collect()
    assert [(x.file, *x.plaats) for x in ordered] == [("a.png", 3, 1), ("b.c.jpg", 999, 0)]


def test_sets(spark):
    one, two = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(1,), (1,)], "a int")
    assert sorted(map(repr, united({"een": one, "twee": two}, kind="soort").collect())) == sorted(map(repr, [*united({"een": one}, kind="soort").collect()])) + ["Row(a=1, b=None, soort='twee')"] * 2
    sets = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    kept, out = merged_sets(sets("a", "b"), sets("b", "c"), key=["k"], left_out=sets("c", "d", "e"), newly_left_out=sets("e", "a", "f"))
    assert sorted(x.k for x in kept.collect()) == ["a", "b", "c"] and sorted(x.k for x in out.collect()) == ["d", "e", "f"]


def test_events(spark):
    rows = [(1, "x" * 30, None, ["wet 1"], "x" * 30), (2, "abc", "kapot", ["wet 1"], "abc!"), (3, "niet te dragen", "kapot", [], "weg"), (4, None, None, None, None)]
    answers = spark.createDataFrame(rows, "id int, answer string, error string, sources array<string>, masked string")
    verdicts = spark.createDataFrame([(1, "GEFUNDEERD"), (2, "ONGEFUNDEERD"), (3, "ONGEFUNDEERD")], "id int, oordeel string")
    got = {}
    for x in answer_events(answers, verdicts, item="id").orderBy("id", "phase", "place").collect():
        got.setdefault(x.id, []).append((x.event, x.data))
    assert got[1] == [("bronnen", '["wet 1"]'), ("tekst", "x" * 24), ("tekst", "x" * 6), ("controle", "GEFUNDEERD"), ("einde", "[DONE]")]
    assert got[2] == [("bronnen", '["wet 1"]'), ("tekst", "abc"), ("fout", "kapot"), ("controle", "ONGEFUNDEERD"), ("gemaskeerd", "abc!"), ("einde", "[DONE]")]
    assert got[3] == got[4] == [("bronnen", "[]"), ("tekst", REFUSAL), ("controle", REFUSED), ("einde", "[DONE]")]
    assert answer_events(answers.where("id > 9"), verdicts, item="id").count() == 0


def test_files_that_are_no_json_are_told(spark, tmp_path):
    good = [{"artikel": "4:9", "bron_geverifieerd": False}, {"artikel": "5", "bron_geverifieerd": None}, 3, "x", None, [1]]
    texts = {"good": json.dumps(good), "wrapped": json.dumps({"records": good}), "single": json.dumps(good[0]), "cut": json.dumps(good)[:40], "none": "dit is geen json", "empty": "", "lines": '{"artikel": "1"}\n{"artikel":', "number": "[1, 2]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    status = {n: load_status(spark, {"wetgeving": str(tmp_path / f"{n}.json")}, lines=n == "lines").first() for n in texts}
    for n in ("good", "wrapped"):
        assert (status[n].geladen, status[n].records, status[n].geweigerd, status[n].geweigerde_ids, status[n].fout) == (True, 1, 1, "4:9", None)
    for n in ("single", "number"):
        assert status[n].geladen and status[n].records == 0
    for n in ("cut", "none", "empty", "lines"):
        assert not status[n].geladen and status[n].records == 0 and status[n].fout
    assert read_corpus(spark, str(tmp_path / "good.json"), schema_of("wetgeving")).columns[:3] == ["wet", "bwb_id", "artikel"]
