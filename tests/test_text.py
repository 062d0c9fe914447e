import datetime as dt

from pyspark.sql import functions as F

from veldspaat.functions import text as t
from veldspaat.functions.citations import clause_keys, law_keys, masked, outcome, references


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert one(spark, "De Verzekeringen en verzekering, art. 4:22a: NIET gedekt! a", t.tokens) == ["verzeker", "verzekering", "art", "4:22a", "niet", "gedekt"]
    assert one(spark, None, t.tokens) == [] and one(spark, "", t.tokens) == []


def test_white_space(spark):
    assert one(spark, "  a\r\n\tb c ", t.collapse) == "a b c"
    assert one(spark, "", t.normal) is None and one(spark, " \n", t.normal) == "" and one(spark, None, t.normal) is None


def test_tags_entities_letters(spark):
    assert one(spark, "<p>a&nbsp;&amp; <b>b</b></p>", t.without_tags) == "a & b"
    assert one(spark, "<br>", t.without_tags) is None
    assert one(spark, "Reeën! 5% van € 3,-", t.letters) == "reeën5%van€3"
    assert one(spark, " a, ,b ,", t.tags) == ["a", "b"] and one(spark, " , ", t.tags) is None


def test_clip(spark):
    clip = lambda c: t.clipped(c, 20)
    assert one(spark, "Kort.", clip) == "Kort."
    assert one(spark, "Een zin hier. En dan nog een lange staart", clip) == "Een zin hier."
    assert one(spark, "A. en dan een heel lange staart", clip) == "A. en dan een heel [...]"
    assert one(spark, "x" * 30, clip) == "x" * 20 + " [...]" and one(spark, None, clip) is None


def test_chunks(spark):
    assert one(spark, "abcde", lambda c: t.chunks(c, 2)) == ["ab", "cd", "e"]
    assert one(spark, "", lambda c: t.chunks(c, 2)) == []


def test_lines(spark):
    raw = "Kop\n 12 \nPagina 3/4\neen verzeke-\nring  met\n• punt\nslot\n\n\n\nEinde"
    clean = one(spark, raw, t.without_furniture)
    assert clean == "Kop\neen verzekering met\n• punt\nslot\n\nEinde"
    assert one(spark, clean, t.rejoined) == "Kop een verzekering met\n• punt slot Einde"
    contents = "Inhoud\nArtikel over dekking ..... 3\nArtikel over premie ...... 9\n" + "tekst van de polis\n" * 20
    assert one(spark, contents, t.after_contents).startswith("tekst van de polis")
    assert one(spark, "Artikel over dekking ..... 3\nkort", t.after_contents) is None
    assert one(spark, "geen inhoud", t.after_contents) == "geen inhoud"


def test_marker_cut(spark):
    cut = lambda a, b: lambda c: t.between(c, F.lit(a), F.lit(b))
    assert tuple(one(spark, "x begin  midden eind y", cut("begin", "eind"))) == ("begin midden", None)
    assert one(spark, "begin begin eind", cut("begin", "eind")).error == "start 2x"
    assert one(spark, "begin", cut("begin", "eind")).error == "end 0x"
    assert one(spark, "eind begin", cut("begin", "eind")).error == "end before start"
    assert one(spark, "x begin rest", cut("begin", None)).cut == "begin rest"


def test_dates(spark):
    assert one(spark, "op 3 maart 2020 en 31 februari 2021", t.dates) == [dt.date(2020, 3, 3), None]
    assert one(spark, "637000000000000000", t.ticks_date) == dt.date(2019, 7, 29)


def test_references_and_keys(spark):
    text = "Zie art. 4:23 lid 2, uitspraak 2024-00012, art. 5.2 en 86c om 22:00."
    found = [tuple(r) for r in one(spark, text, references)]
    assert found == [("kifid", "2024-00012", text.index("2024")), ("wetsartikel", "4:23", 4), ("wetsartikel", "86c", text.index("86c")), ("wetsartikel", "22:00", text.index("22:00")), ("polisclausule", "5.2", text.index("art. 5.2"))]
    assert one(spark, None, references) == []
    assert sorted(one(spark, " Art. 4:23 ", law_keys)) == ["4:23", "art. 4:23"]
    assert sorted(one(spark, "Art. 5.2", clause_keys)) == ["5.2", "art. 5.2"] and one(spark, "Woonhuis art. 2.2", clause_keys) == ["woonhuis art. 2.2"]


def test_mask(spark):
    mask = lambda c: masked(c, F.slice(references(c), 1, 1))
    assert one(spark, "x4:23 en art. 4:23, 4:23", mask).count("⚠️") == 1
    assert one(spark, "art. 4:23.", mask) == "art. 4:23 ⚠️[niet in corpus]."
    assert one(spark, "geen $1 verwijzing", mask) == "geen $1 verwijzing"


def test_outcome(spark):
    def verdict(heading, decision):
        return tuple(spark.createDataFrame([(heading, decision)], "h string, b string").select(outcome(F.col("h"), F.col("b")).alias("o")).first().o)

    assert verdict("Vorderingen toegewezen.", None) == ("gegrond", "kopregel Uitkomst")
    assert verdict("Vordering toegewezen", "verklaart de klacht ongegrond") == ("ongegrond", "expliciet in beslissing")
    assert verdict("iets anders", "De Commissie wijst de vordering af.") == (None, None)
    assert verdict(None, "De Commissie wijst de vordering af.") == ("ongegrond", "letterlijke beslissing")
    assert verdict("deels niet-behandelbaar", None) == (None, None) and verdict(None, None) == (None, None)
