"""From ranked records to context blocks and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLES = {"wetgeving": "WETGEVING", "kifid": "KIFID-UITSPRAKEN", "polisvoorwaarden": "POLISVOORWAARDEN"}
NOTHING = "(geen bronnen gevonden)"


def _said(c: str) -> Column:
    """A value inside a text; a null reads None."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _first(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def block(corpus: str) -> Column:
    """A record of a corpus as a passage for a context: label, title, the beginning of its text, source."""
    source = F.concat(F.lit("\nBron: "), _said("bron_url"))
    if corpus == "wetgeving":
        return F.concat(F.lit("["), _said("wet"), F.lit(" art. "), _said("artikel"), F.lit("] "), _or_empty("titel"), F.lit("\n"), F.left(_or_empty("tekst"), F.lit(1200)), source)
    if corpus == "kifid":
        verdict = F.coalesce(F.nullif("oordeel", F.lit("")), F.lit("niet vastgesteld"))
        text = F.left(_first("samenvatting", "kern_klacht"), F.lit(900))
        return F.concat(F.lit("[Kifid "), _said("uitspraaknummer"), F.lit("] "), _or_empty("titel"), F.lit("\nOordeel: "), verdict, F.lit("\n"), text, source)
    label = F.concat(F.lit("["), _said("product"), F.lit(" "), _said("clausule_id"), F.lit(" - "), _said("type"), F.lit("] "))
    return F.concat(label, _or_empty("kop"), F.lit("\n"), F.left(_or_empty("tekst"), F.lit(900)), source)


def listed(corpus: str) -> list[Column]:
    """A record as a line of a source list: soort, label, titel, url, fragment."""
    spec = {
        "wetgeving": ("wetgeving", F.concat(_said("wet"), F.lit(" art. "), _said("artikel")), "titel", "tekst"),
        "kifid": ("kifid", F.concat(F.lit("Kifid "), _said("uitspraaknummer")), "titel", "samenvatting"),
        "polisvoorwaarden": ("polis", F.concat(_said("product"), F.lit(" "), _said("clausule_id")), "kop", "tekst"),
    }
    kind, label, title, text = spec[corpus]
    return [F.lit(kind).alias("soort"), label.alias("label"), F.col(title).alias("titel"), F.col("bron_url").alias("url"), F.left(_or_empty(text), F.lit(300)).alias("fragment")]


def contexts(passages: DataFrame, *, query: str) -> DataFrame:
    """(query, context) from (query, corpus, rank, passage): titled sections in the order of TITLES, passages by rank.

    The passages of a query are few: they come from a top-k.
    """
    place = F.create_map(*[F.lit(x) for i, t in enumerate(TITLES) for x in (t, i)])
    title = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    section = passages.groupBy(query, "corpus").agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("_p"))
    text = F.concat(F.lit("=== "), title[F.col("corpus")], F.lit(" ===\n"), F.array_join(F.transform("_p", lambda p: p["passage"]), "\n\n"))
    section = section.select(query, F.struct(place[F.col("corpus")].alias("place"), text.alias("text")).alias("_s"))
    whole = section.groupBy(query).agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    return whole.select(query, F.array_join(F.transform("_s", lambda s: s["text"]), "\n\n").alias("context"))


def verdicts(ranked: DataFrame, *, query: str, verdict: str) -> DataFrame:
    """(query, n, summary): how the verdicts of a query's records are spread, as '5x gegrond, 2x onbekend'.

    By count, then by the best rank at which a verdict stands.
    """
    value = F.lower(F.coalesce(F.nullif(F.col(verdict), F.lit("")), F.lit("onbekend")))
    counts = ranked.groupBy(query, value.alias("_v")).agg(F.count("*").alias("_n"), F.min("rank").alias("_r"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_r").alias("r"), F.col("_v").alias("v"))))
    summary = F.array_join(F.transform(ordered, lambda s: F.concat((-s["n"]).cast("string"), F.lit("x "), s["v"])), ", ")
    return counts.groupBy(query).agg(F.sum("_n").alias("n"), summary.alias("summary"))


#: What an answer must keep to, in words of our own; the context follows.
RULES = """Beantwoord de vraag alleen met de bronnen hieronder.
1. Noem bij elke bewering de bron waar zij op rust.
2. Noem geen artikel, uitspraak of clausule die niet hieronder staat.
3. Staat het antwoord niet in de bronnen, zeg dat dan.
4. Reken niets zelf uit; gegeven uitkomsten gelden.
5. Houd onzekerheid zichtbaar.
6. Schrijf kort en in gewoon Nederlands.

BRONNEN
"""


def prompt(context: Column, rules: str = RULES) -> Column:
    """The instructions for an answer with its context; without any, the context says that nothing was found."""
    return F.concat(F.lit(rules), F.coalesce(F.nullif(context, F.lit("")), F.lit(NOTHING)))
