"""Queries that do the whole job: nothing is cut before it is searched, ordered, folded or named."""

import datetime as dt

from pyspark.sql import functions as F

from veldspaat.functions.text import without_furniture
from veldspaat.operators.ranking import label
from veldspaat.plans.tasks import TASKS, planned
from veldspaat.queries import maintenance, retrieval


def test_tasks_search_whole_complaints(spark, tmp_path):
    text = "woord " * 150 + "zeldzaam"
    spark.createDataFrame([(n, text) for n in (5, 100, 1200)], "rij_id long, kern_klacht string").write.parquet(f"{tmp_path}/kifid.parquet")
    requests = retrieval._requests(spark, str(tmp_path))
    assert {r.req for r in requests.collect()} == {f"{t}-{n}" for t, spec in TASKS.items() for n in (100, 1200) if spec[3] != 0} | {t for t, spec in TASKS.items() if spec[3] == 0}
    asked = {r.functie: r.question for r in planned(requests, task="functie", text="vraag").collect()}
    assert asked["dekkingscheck"] == asked["precedentzoeker"] == asked["begripsuitleg"] == text
    assert asked["polisvergelijker"].startswith(text) and asked["afwijzingsanalyse"].startswith(text[:600] + " afwijzing")


def test_tasks_search_all_fixed_words(spark):
    """All words of each task."""
    asked = spark.createDataFrame([(t, "brief") for t in ("dossiercheck", "klachtroute", "afwijzingsanalyse", "adviesnotitie")], "taak string, vraag string")
    assert {r.taak: r.question for r in planned(asked, task="taak", text="vraag").collect()} == {
        "dossiercheck": "passend advies klantprofiel zorgplicht informatieverstrekking kennis ervaring doelstelling risicobereidheid financiele positie",
        "klachtroute": "klachtprocedure Kifid ontvankelijkheid termijn bindend advies geschilleninstantie interne klachtbehandeling",
        "afwijzingsanalyse": "brief afwijzing dekking uitsluiting mededelingsplicht opzet eigen gebrek",
        "adviesnotitie": "passend advies vastlegging dossier informatieverstrekking klantprofiel motivering",
    }


def test_every_ruling_is_ordered(spark, tmp_path):
    days = [f"20{n % 25:02d}-01-01" if n % 9 else None for n in range(250)]
    rows = [(n, f"2020-{n % 40:03d}" if n % 7 else None, d) for n, d in enumerate(days)]
    spark.createDataFrame(rows, "rij_id long, uitspraaknummer string, datum string").write.parquet(f"{tmp_path}/kifid.parquet")
    want = sorted(sorted(rows), key=lambda r: (r[2] or "", r[1] or ""), reverse=True)
    assert list(map(tuple, maintenance.result_order(spark, str(tmp_path)).collect())) == want


def test_upsert_folds_every_delivery(spark, tmp_path):
    d, t = dt.date, dt.datetime
    rows = [("P", "1", "oud", d(2020, 1, 1), t(2020, 1, 2)), ("P", "1", "nieuw", d(2023, 1, 1), t(2023, 1, 2)), ("P", "2", "eerst", d(2020, 1, 1), t(2020, 1, 2)), ("P", "2", None, d(2020, 1, 1), t(2020, 1, 9))]
    rows += [("P", "3", "vier", d(2021, 1, 1), t(2021, 1, 2)), ("P", "4", "x", d(2022, 1, 1), t(2022, 1, 2)), ("Q", "1", "laat", d(2021, 1, 1), t(2024, 1, 1)), ("Q", "1", "einde", d(2022, 1, 1), t(2022, 1, 1))]
    spark.createDataFrame(rows, "product string, clausule_id string, tekst string, opgehaald_op date, ingelezen_op timestamp").write.parquet(f"{tmp_path}/polis_levering.parquet")
    got = {tuple(r) for r in maintenance.upsert_lastwins(spark, str(tmp_path)).collect()}
    assert got == {("2020-01-01", 1, 0), ("2021-01-01", 1, 4), ("2022-01-01", 2, 6), ("2023-01-01", 1, 5)}


def test_labels_of_any_length(spark):
    def name(n):
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    places = [1, 26, 27, 702, 703, 18278, 18279, 18280, 475254, 475255, 12356630, 12356631, 2**53 + 1, *range(18200, 18400), 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in places], "n long").select("n", label(F.col("n")).alias("y")).collect()
    assert [r.y for r in got] == [name(r.n) for r in got]


def test_every_ruling_is_labelled(spark, tmp_path):
    spark.range(18300).select(F.col("id").alias("rij_id")).write.parquet(f"{tmp_path}/kifid.parquet")
    got = maintenance.blind_labels(spark, str(tmp_path)).toPandas()
    assert len(got) == got.label.nunique() == 18300 and dict(zip(got.n, got.label))[18279] == "AAAA"


def test_all_furniture_goes(spark):
    heads = ["Voorwaarden arbeidsongeschiktheidsverzekering model 12  3/40", " Voorwaarden Woonverzekering ", "2. Wettelijke Aansprakelijkheid (WA)", "3. Volledig Casco", "4. Beperkt Casco"]
    kept = ["Schade door Terrorisme", "Totale schade", "Teruggevonden auto", "Voorwaarden Woonverzekering gelden", "3. Volledig Casco dekt"]
    raw = "\n".join(x for pair in zip(heads, kept) for x in pair)
    for word in ("errorisme", "otale", "eruggevonden"):
        raw = raw.replace("T" + word, "T " + word)
    got = spark.createDataFrame([(raw,)], "t string").select(without_furniture(F.col("t")).alias("t")).first().t
    assert got == "\n".join(kept)
