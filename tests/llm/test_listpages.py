import pyarrow as pa
from pyspark.sql import functions as F

from veldspaat.llm.listpages import function_words, list_scores, page_parts

#: Function words as a corpus of these languages gives them.
KNOWN = "de het een en of in op te dat die deze dit is zijn wordt heeft voor met na niet zonder door maar tot naar aan wij bij om eerst wie vraagt the that was and to of by".split()
PROSE = """De verzekeraar betwist dat het dak door de storm is beschadigd en verwijst naar het rapport van zijn expert. De bewoner
meldde de lekkage op maandag, maar liet de goot pas een week later herstellen. Volgens de voorwaarden wordt gevolgschade alleen vergoed
als zij binnen drie dagen is gemeld. De commissie vindt dat de melding tijdig was, omdat de makelaar al eerder foto's had gestuurd. Wat
de schilder daarna aan kosten maakte, komt niet voor rekening van de maatschappij. Wel krijgt de bewoner de noodreparatie terug."""
SPANISH = """El asegurador debe pagar la indemnización dentro de los treinta días siguientes a la fecha en que reciba la declaración del siniestro
y los documentos que la acompañan. Si no lo hace, el tomador puede pedir los intereses de demora desde ese día. La póliza cubre los daños
que el agua cause en la vivienda, pero no los que vengan de un mal uso de las tuberías. Quien haya sufrido un robo tiene que denunciarlo
ante la policía y conservar una copia del escrito."""
ITALIAN = """L'assicuratore paga l'indennizzo entro trenta giorni dalla data in cui riceve la denuncia del sinistro e i documenti che la
accompagnano. Se non lo fa, il contraente può chiedere gli interessi di mora da quel giorno. La polizza copre i danni che l'acqua
provoca nella casa, ma non quelli che vengono da un cattivo uso delle tubature."""
PRODUCTS = "autopolis reispolis woonpolis bootpolis dakpolis zorgpolis fietspolis tuinpolis glaspolis brandpolis".split()
CITIES = "Amsterdam Rotterdam Utrecht Eindhoven Groningen Tilburg Almere Breda Nijmegen Apeldoorn".split()
LISTED = {
    "keywords": "autopolis goedkoop, autopolis vergelijken, polis snel, autopolis beste, " * 6,
    "lines": "autopolis goedkoop\nreispolis online\nbootpolis snel\n" * 8,
    "links": "\n".join(f"Polis {i} - https://gids{i}.example/premie/{i}" for i in range(12)),
    "labels": "tag: 1234 | merk: polis | SKU: premie | label: 99 | " * 6,
    "hashtags": "#autopolis #reispolis #bootpolis " * 8,
    "dressed": "Zoekt u dakpolis? Dan is dakpolis onze dakpolis. Waarom dakpolis? Omdat dakpolis goed is. Alles over dakpolis, dakpolis en dakpolis. " * 3,
    "slogan of 17 words": "Wie een goedkope autoverzekering in deze stad wil afsluiten vraagt bij ons om de voordeligste premie online. " * 30,
    "period of 12": " ".join(f"zoek de {p} in {c} en vergelijk hem met ons aanbod of bel" for p, c in zip(PRODUCTS * 2, CITIES * 2)),
    "prices": "\n".join(f"{p} {kind} € {i},95" for i, p in enumerate(PRODUCTS) for kind in ("basis", "plus", "totaal")),
    "period of 40": " ".join([*PRODUCTS, *CITIES, *[f"term{i} met" for i in range(10)]] * 5),
    "different words": " ".join(f"{p}{c.lower()}" for p in PRODUCTS for c in CITIES),
}
ORDINARY = {
    "text": PROSE,
    "glossary": "Eigen risico – het bedrag dat de verzekerde zelf draagt.\nDagwaarde – de nieuwwaarde met een aftrek voor slijtage.\nHerbouwwaarde – wat het kost om het huis op dezelfde plek te zetten.\nMolest – geweld door oorlog of opstand.\nPolis – het papier waarop de afspraken staan.",
    "term": "De dakpolis vergoedt in beginsel alle schade door storm. Wie een nieuw huis koopt vraagt om een dakpolis bij zijn adviseur. " + PROSE,
    "some": PROSE + LISTED["keywords"][:200],
    "twice": PROSE + "\n" + PROSE,
    "english": "The insurer holds that the roof was damaged before the policy began and refers to the report of its own expert. The owner says that the storm of March did it, and has photos to show for that.",
    "spanish": SPANISH,
    "italian": ITALIAN,
    "chinese": "保险人应当在收到索赔请求后三十日内作出核定。对不属于保险责任的，应当说明理由。投保人可以解除合同。",
}


def test_lists_and_ordinary_pages(spark):
    rows = [*{**LISTED, **ORDINARY}.items(), ("null", None), ("empty", ""), ("blank", " \n "), ("long", LISTED["slogan of 17 words"] * 500), ("text", ORDINARY["text"])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "id string, text string, list_share int")
    scores = list_scores(df, ids=["id"], text=F.col("text"), language=F.lit(None).cast("string"), functional=KNOWN).collect()
    assert len(scores) == len(rows)
    by = {r.id: r.score for r in scores}
    assert {k for k, v in by.items() if v > 0.5} == {*LISTED, "long"}
    assert by["null"] == by["empty"] == by["blank"] == 0
    assert all(0 <= v <= 1 + 1e-9 for v in by.values())
    regular = {r.id: r.regular_share for r in scores}
    assert regular["slogan of 17 words"] > 0.9 and regular["period of 40"] > 0.9 and regular["text"] == 0


def test_function_words_come_from_the_pages(spark):
    texts = [("nl", f"De woning {i} van het kantoor en de bewoner{i}") for i in range(60)] + [("xx", f"Ku pala{i} mi ku{i} tere ku sano{i} mi") for i in range(30)] + [("zz", "zo weinig")] * 4 + [(None, None), ("nl", None)]
    found = function_words(spark.createDataFrame(texts, "l string, t string"), text=F.col("t"), language=F.col("l"))
    assert found == ["de", "en", "het", "ku", "mi", "tere", "van", "woning"]


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string, lang string")
    assert list_scores(df, ids=["id"], text=F.col("text"), language=F.col("lang")).count() == 0


def test_a_page_is_judged_alone():
    texts = [*LISTED.values(), *ORDINARY.values()]
    together = page_parts(pa.array(texts), KNOWN)
    for i, t in enumerate(texts):
        alone = page_parts(pa.array([t]), KNOWN)
        assert all(abs(alone[k][0] - together[k][i]) < 1e-9 for k in alone)
