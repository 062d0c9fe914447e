from veldspaat.llm.truncation import judged_values, truncation_rates

SCHEMA = "id long, bron string, klacht string, uitkomst string, field int, value string"
WORDS = "de verzekeraar heeft de schade aan het dak na de storm van maart niet vergoed en de consument wil betaling".split()


def sentence(i, n=14):
    return "De " + " ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % len(WORDS)] for k in range(n)) + "."


def judge(spark, rows):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    return judged_values(df, item="id", source="bron", fields=["klacht", "uitkomst"])


def test_cut_and_whole(spark):
    rows = [(i, "pdf", " ".join(sentence(i + k, 8 + (i + k) % 9) for k in range(1 + i % 6)), ["Klacht gegrond", "Klacht gegrond.", "Vordering afgewezen", "Vordering afgewezen."][i % 4]) for i in range(300)]
    rows += [(1000 + i, "api", " ".join(sentence(i + k, 9 + (i + k) % 11) for k in range(12))[:120], None) for i in range(60)]
    whole = {2000: "Hij wil betaling. 3/7", 2001: "Hij wil betaling.2", 2002: "Hij wil betaling. [Bijlage 2.]", 2003: "Dat kost € 235,-.", 2004: "Hij (…) wil betaling.", 2005: "Hij wil betaling. Consument: ‘Nee.’"}
    cut = {3000: "De schade aan het da", 3001: "De schade aan-", 3002: "De schade [...]", 3003: "De schade is d&#8", 3004: "De schade van €", 3005: "Op grond van art.", 3006: "Hij wil dat de…", 3007: "De schade, [lees verder]"}
    rows += [(i, "html", t, None) for i, t in {**whole, **cut}.items()]
    rows += [(4000, "pdf", None, "Klacht geg"), (4001, "pdf", None, "Vordering afge-"), (4002, None, "  ", "Klacht gegrond "), (4003, None, None, None), (3000, "html", cut[3000], None)]
    judged = judge(spark, rows)
    reason = {(r.id, r.field): r.reason for r in judged.collect()}
    assert not [i for i in whole if reason[i, "klacht"]] and not [i for i in cut if not reason[i, "klacht"]]
    assert not [i for i in range(300) if reason[i, "klacht"] or reason[i, "uitkomst"]]
    assert reason[4000, "uitkomst"] == "phrase" and reason[4001, "uitkomst"] == "open" and reason[4002, "uitkomst"] is None
    assert (4002, "klacht") not in reason and (4003, "klacht") not in reason
    limited = [r for r in judged.where("id between 1000 and 1059").collect()]
    assert sum(r.reason is not None for r in limited) >= 55 and any(r.reason == "limit" for r in limited)
    assert {r.shown_by for r in limited if r.reason} == {"length"} and {r.shown_by for r in judged.where("id between 3000 and 3007").collect()} == {"ending"}
    assert all((r.shown_by is None) == (r.reason is None) for r in judged.collect())
    rates = {(r.bron, r.field): (r.n_values, r.n_cut) if r.bron != "api" else (r.n_cut, r.n_by_length) for r in truncation_rates(judged, item="id", source="bron").collect()}
    assert rates["html", "klacht"] == (14, 8) and rates[None, "uitkomst"] == (1, 0) and rates["api", "klacht"][0] == rates["api", "klacht"][1] >= 55


def test_empty(spark):
    assert judge(spark, []).count() == 0
    assert truncation_rates(judge(spark, []), item="id", source="bron").count() == 0


def test_very_long(spark):
    assert judge(spark, [(1, "a", "zin over schade. " * 20_000, None)]).first().reason is None
