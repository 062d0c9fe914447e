import datetime as dt
import json
import math
import re

from pyspark.sql import functions as F

from veldspaat.functions.text import STOPWORDS
from veldspaat.operators.gate import audited, gate_status, redirect_verified, usable
from veldspaat.operators.grounding import checked, cited, judged, key_table, marked
from veldspaat.operators.passages import contexts, verdicts
from veldspaat.operators.profiles import runs, steepest, trailing_and_following
from veldspaat.operators.quality import containment, covered, mixed_hashes, report, row_violations
from veldspaat.operators.ranking import capped, first_per_key, label, last_per_key, numbered, top_per_group, viewport, words_in
from veldspaat.operators.retrieval import bm25
from veldspaat.operators.versions import version_on
from veldspaat.plans.tasks import TASKS, planned
from veldspaat.sources.corpora import load_status, read_corpus, schema_of, write_form, write_json
from veldspaat.sources.lawxml import articles, read_articles
from veldspaat.sources.manifests import read_manifests, upserted
from veldspaat.streaming.checks import arriving, checked_stream, gated, landed, masked_stream


def test_gate_three_values(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, None), (3, None, None), (4, True, "fout"), (4, True, "fout")], "id int, ok boolean, audit string")
    v = audited(F.col("ok"), F.col("audit"))
    assert sorted(r.id for r in df.where(usable(v)).collect()) == [1, 3]
    status = gate_status(df, verified=v, names=[F.col("id")]).first()
    assert (status.records, status.usable, status.refused, status.refused_ids) == (5, 2, 3, "2,4,4")
    assert gate_status(df.where("id > 9"), verified=v, names=[F.col("id")]).first().refused_ids == ""
    seen = spark.createDataFrame([(302, "u#a"), (302, "u#b"), (None, None), (404, None)], "s int, l string").select(redirect_verified(F.col("s"), F.col("l"), F.lit("a")).alias("v"))
    assert [r.v for r in seen.collect()] == [True, False, None, False]


def tokenize(text):
    out = []
    for w in re.findall("[a-zà-ÿ0-9]+(?::[0-9]+[a-z]?)*", (text or "").lower()):
        if w not in STOPWORDS and len(w) > 1:
            out.append(re.sub("(ingen|heden|en|er|s)$", "", w) if len(w) > 6 else w)
    return out


def test_bm25_against_brute_force(spark):
    texts = [(1, "brand in de schuur brand"), (2, "schade door water"), (3, ""), (4, None), (5, "water water in het huis en de schuur"), (6, "schade door water")]
    queries = [("a", "schuur schuur brand"), ("b", "water schade"), ("c", "de het"), ("d", None)]
    docs = {i: tokenize(t) for i, t in texts}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    want = set()
    for q, text in queries:
        scores = []
        for i, toks in docs.items():
            s = 0.0
            for w in tokenize(text):
                f, df = toks.count(w), sum(w in t for t in docs.values())
                if f:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(toks) / avg))
            if s > 0:
                scores.append((-round(s, 6), i))
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:2], 1)}
    got = bm25(spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(queries, "q string, t string"), item="d", text=F.col("t"), query="q", query_text=F.col("t"), k=2)
    assert set(map(tuple, got.select("q", "d", "score", "rank").collect())) == want
    empty = spark.createDataFrame([], "d int, t string")
    assert bm25(empty, spark.createDataFrame(queries, "q string, t string"), item="d", text=F.col("t"), query="q", query_text=F.col("t"), k=2).count() == 0


def test_grounding(spark):
    texts = spark.createDataFrame([(1, "art. 4:23 en 2024-00012"), (2, "art. 9:99, nogmaals art. 9:99, 86c"), (3, "niets"), (4, None)], "id int, t string")
    laws = spark.createDataFrame([("4:23",), (None,), ("",)], "artikel string")
    rulings = spark.createDataFrame([("2024-00012",), (None,)], "uitspraaknummer string")
    keys = key_table(laws, rulings)
    checks = checked(cited(texts, item="id", text=F.col("t")), keys)
    assert {tuple(r) for r in judged(texts, checks, item="id").collect()} == {(1, "GEFUNDEERD", 2, 0), (2, "ONGEFUNDEERD", 0, 1), (3, "GEEN_VERWIJZINGEN", 0, 0), (4, "GEEN_VERWIJZINGEN", 0, 0)}
    out = {r.id: r.gemaskeerd for r in marked(texts, checks, item="id", text="t").collect()}
    assert out[1] == "art. 4:23 en 2024-00012" and out[2].count("⚠️") == 1 and out[4] is None


def test_stream_equals_batch(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"art. {i % 4}:23 en 2024-000{i % 3}1", i % 3 != 0) for i in range(40)], "id int, t string, ok boolean")
    texts.repartition(6).write.parquet(str(tmp_path / "in"))
    keys = key_table(spark.createDataFrame([("1:23",), ("2:23",)], "artikel string"))
    stream = gated(arriving(spark, str(tmp_path / "in"), texts.schema, files_per_batch=2), verified=F.col("ok"))
    query = landed(checked_stream(stream, keys, item="id", text="t"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    batch = checked_stream(gated(texts, verified=F.col("ok")), keys, item="id", text="t")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    known = [("wetsartikel", "1:23"), ("wetsartikel", "2:23")]
    lines = masked_stream(texts, item="id", text="t", known=known).collect()
    assert all(("⚠️" in r.gemaskeerd) for r in lines) and len(lines) == 40


def test_ranking(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5), (None, 7), (None, 8)], "g string, v int")
    assert {(r.g, r.v) for r in top_per_group(df, ["g"], [F.asc("v")], 2).collect()} == {("a", 1), ("a", 2), ("b", 5), (None, 7), (None, 8)}
    once = first_per_key(df, ["g"], [F.asc("v")])
    assert sorted(map(str, once.collect())) == sorted(map(str, first_per_key(once, ["g"], [F.asc("v")]).collect()))
    assert {(r.g, r.v) for r in capped(df, ["g"], [F.asc("v")], 1, F.col("v") >= 5).collect()} == {("a", 1), ("b", 5), (None, 7), (None, 8)}
    new = spark.createDataFrame([("a", 9), (None, 10)], "g string, v int")
    assert sorted((r.g or "", r.v) for r in last_per_key(df.where("v in (1, 5, 7)"), new, ["g"]).collect()) == [("", 10), ("a", 9), ("b", 5)]
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    assert all(r.n == r.x + 1 for r in numbered(rows, ["x"]).collect())
    names = [r.y for r in spark.createDataFrame([(n,) for n in (1, 26, 27, 28, 702, 703)], "n long").select(label(F.col("n")).alias("y")).collect()]
    assert names == ["A", "Z", "AA", "AB", "ZZ", "AAA"]
    seen = spark.createDataFrame([("X_Mobile_1440.png",), ("a-1440.png",), ("b",)], "f string").select(viewport(F.col("f")).alias("v"), words_in(F.col("f"), ["mob", "png"]).alias("w"))
    assert [(r.v, r.w) for r in seen.collect()] == [("mobile", ["mob", "png"]), ("desktop", ["png"]), ("onbekend", [])]


def test_versions(spark):
    d = dt.date
    rows = [("x", d(2000, 1, 1), d(2009, 12, 31), 1), ("x", d(2010, 1, 1), None, 2), ("x", d(2010, 1, 1), None, 3), ("y", None, None, 4), ("z", d(2030, 1, 1), None, 5)]
    df = spark.createDataFrame(rows, "k string, a date, b date, n int")
    pick = lambda day: [r.n for r in version_on(df, key=["k"], day=F.lit(day).cast("date"), start="a", end="b", order=["n"]).collect()]
    assert pick("2009-12-31") == [1] and pick("2010-01-01") == [3] and pick("1990-01-01") == []


def test_quality(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "goed", " "), (3, "raar", None)], "id int, type string, t string")
    bad = row_violations(df, item="id", required=["type", "t"], allowed={"type": ("goed",)}, not_blank=["t"])
    assert {tuple(r) for r in bad.collect()} == {(1, "missing", "type"), (3, "missing", "t"), (3, "not allowed", "type"), (2, "blank", "t")}
    assert {tuple(r) for r in report(bad, bad).collect()} == {("missing", "type", 2), ("missing", "t", 2), ("not allowed", "type", 2), ("blank", "t", 2)}
    h = spark.createDataFrame([("u", "A"), ("u", "b"), ("v", "A"), ("v", None)], "u string, h string")
    assert [tuple(r) for r in mixed_hashes(h, source="u", digest=F.lower("h")).collect()] == [("u", 2)]
    a, b = spark.createDataFrame([("k", "Een  twee!")], "k string, p string"), spark.createDataFrame([("k", "nul een-twee drie")], "k string, w string")
    assert containment(a, b, on=["k"], part="p", whole="w").first().verbatim
    refs = spark.createDataFrame([("1:1", "2"), ("1:1", "9"), ("1:1", None), ("8:8", "1")], "artikel string, lid string")
    laws = spark.createDataFrame([("1:1", ["1. a", " 2. b"])], "artikel string, leden array<string>")
    state = {(r.artikel, r.lid): r.covered for r in covered(refs, laws, key="artikel", member="lid", members="leden").collect()}
    assert state == {("1:1", "2"): "covered", ("1:1", "9"): "no member", ("1:1", None): "covered", ("8:8", "1"): "no record"}


def test_profiles(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 1.0, 5.0, 5.0, 5.0, 1.0])], "g int, i int, v double")
    assert sorted((r.state, r.start, r.n) for r in runs(df, group=["g"], order=["i"], state=F.col("v") > 3).collect()) == [(False, 0, 2), (False, 5, 1), (True, 2, 3)]
    r = trailing_and_following(df, group=["g"], order=["i"], value="v", back=2).where("i = 2").first()
    assert (r.before, r.after) == (1.0, 4.0)
    assert [(x.at, x.step) for x in steepest(df, group=["g"], order=["i"], value="v").collect()] == [(2, 4.0)]


def test_passages(spark):
    rows = [("q", "kifid", 1, "K1"), ("q", "wetgeving", 2, "W2"), ("q", "wetgeving", 1, "W1")]
    text = contexts(spark.createDataFrame(rows, "q string, corpus string, rank int, passage string"), query="q").first().context
    assert text == "=== WETGEVING ===\nW1\n\nW2\n\n=== KIFID-UITSPRAKEN ===\nK1"
    ranked = spark.createDataFrame([("q", 1, "Gegrond"), ("q", 2, None), ("q", 3, "gegrond"), ("q", 4, "")], "q string, rank int, v string")
    assert tuple(verdicts(ranked, query="q", verdict="v").first()) == ("q", 4, "2x gegrond, 2x onbekend")


def test_tasks(spark):
    asked = spark.createDataFrame([(1, "begripsuitleg", "eigen risico"), (2, "klachtroute", "weg"), (3, "onbekend", "x")], "id int, taak string, vraag string")
    out = planned(asked, task="taak", text="vraag").collect()
    assert {(r.id, r.corpus) for r in out} == {(1, c) for c in TASKS["begripsuitleg"][0]} | {(2, c) for c in TASKS["klachtroute"][0]}
    assert all(r.question == ("eigen risico" if r.id == 1 else TASKS["klachtroute"][2]) for r in out)


def test_corpora(spark, tmp_path):
    one = {"wet": "W", "artikel": "4:9", "leden": ["1. a"], "geldig_op": "2020-01-01", "bron_geverifieerd": None, "extra": 1}
    (tmp_path / "a.json").write_text(json.dumps([one, one]))
    (tmp_path / "b.json").write_text(json.dumps({"records": [one, {"wet": None}]}))
    (tmp_path / "c.json").write_text("geen json")
    schema = schema_of("wetgeving")
    a, b = read_corpus(spark, str(tmp_path / "a.json"), schema), read_corpus(spark, str(tmp_path / "b.json"), schema)
    assert a.count() == 2 and a.first().artikel == "4:9" and a.first().geldig_op == dt.date(2020, 1, 1)
    assert [r.wet for r in b.where("wet is not null").collect()] == ["W"]
    status = {r.corpus: r for r in load_status(spark, {"wetgeving": str(tmp_path / "a.json"), "kifid": str(tmp_path / "none.json")}).collect()}
    assert status["wetgeving"].records == 2 and not status["kifid"].geladen and status["kifid"].fout
    write_json(a, str(tmp_path / "out"))
    assert sorted(map(str, read_corpus(spark, str(tmp_path / "out"), schema, lines=True).collect())) == sorted(map(str, a.collect()))
    write_form(a.select("artikel"), str(tmp_path / "form"), label="artikel", questions=["q1"])
    assert spark.read.option("header", True).csv(str(tmp_path / "form")).columns == ["artikel", "q1"]


XML = """<wet><hoofdstuk><kop><label>Hoofdstuk</label><nr>1</nr><titel>Begin</titel></kop>
<artikel><kop><label>Artikel</label><nr>4:9</nr><titel>Kop</titel></kop><lid><lidnr>1.</lidnr><al>Eerste <nadruk>lid</nadruk> tekst.</al>
<lijst><li><li.nr>a.</li.nr><al>punt</al></li></lijst></lid><lid><lidnr>2.</lidnr><al>Tweede.<noot>weg</noot></al></lid></artikel>
<artikel><kop><nr>5</nr></kop><al>Los.</al><table><row><entry>x</entry><entry/></row></table></artikel></hoofdstuk></wet>"""


def test_law_xml(spark):
    a, b = articles(XML)
    assert a == {"artikel": "4:9", "titel": "Kop", "tekst": "1. Eerste lid tekst.\na. punt\n2. Tweede.", "leden": ["1. Eerste lid tekst.\na. punt", "2. Tweede."], "structuur": ["Hoofdstuk 1 - Begin"]}
    assert (b["artikel"], b["tekst"], b["leden"]) == ("5", "Los.\nx | ", None)
    rows = read_articles(spark.createDataFrame([("a", XML), ("b", "<x"), ("c", None)], "path string, xml string")).collect()
    assert sorted((r.path, r.artikel or "", r.error is None) for r in rows) == [("a", "4:9", True), ("a", "5", True), ("b", "", False), ("c", "", False)]


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"file": "x.png", "name": "X", "omschrijving": "d"}]))
    (tmp_path / "b.json").write_text(json.dumps({"comps": [{"naam": "Y", "omschrijving": None, "bestanden": {"desktop": "y1.png", "mobile": "y2.png"}}]}))
    (tmp_path / "c.json").write_text("kapot")
    rows = read_manifests(spark, str(tmp_path))
    assert sorted((r.file, r.name) for r in rows.collect()) == [("x.png", "X"), ("y1.png", "Y"), ("y2.png", "Y")]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "file string, v int")
    new = spark.createDataFrame([("b", 3)], "file string, v int")
    assert sorted(map(tuple, upserted(old, new, key=["file"], files=new.select("file")).collect())) == [("b", 3)]


def test_bm25_in_parts_is_bm25_of_each_part(spark):
    rows = [("a", i, f"dak storm {'schade ' * (i % 4)} woord{i % 5}") for i in range(30)] + [("b", i, f"dak water {'kelder ' * (i % 3)} woord{i % 7}") for i in range(20)] + [("c", 1, None)]
    texts = spark.createDataFrame(rows, "c string, id int, t string")
    asked = spark.createDataFrame([(1, "a", "storm dak schade schade"), (2, "b", "kelder woord3"), (3, "b", "niets"), (4, "c", "dak"), (5, "a", None)], "q int, c string, t string")
    both = bm25(texts, asked, item="id", text=F.col("t"), query="q", query_text=F.col("t"), k=4, part="c")
    own = bm25(texts, asked, item="id", text=F.col("t"), query="q", query_text=F.col("t"), k=4, part="c", asks_part=True)
    want = {}
    for c in "abc":
        for r in bm25(texts.where(F.col("c") == c), asked, item="id", text=F.col("t"), query="q", query_text=F.col("t"), k=4).collect():
            want[c, r.q, r["rank"]] = (r.id, r.score)
    assert {(r.c, r.q, r["rank"]): (r.id, r.score) for r in both.collect()} == want
    to = {1: "a", 2: "b", 3: "b", 4: "c"}
    assert {(r.c, r.q, r["rank"]): (r.id, r.score) for r in own.collect()} == {k: v for k, v in want.items() if to[k[1]] == k[0]}
