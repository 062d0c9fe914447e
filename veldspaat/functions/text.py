"""Column functions on text: white space, case, letters, tags, clipping.

All are built-in expressions, null in gives null out unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, no-break spaces included, as a character class that Java and RE2 both read. Fixed values.
SPACE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it: expressions stay small."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


#: White space other than the space itself. Fixed values.
OTHER_SPACE = SPACE.replace(r"\x{20}", "")


def collapse(text: Column) -> Column:
    """Every run of Unicode white space made one space, ends trimmed.

    Printable ASCII is told by one test, and single spaces are passed over, not replaced.
    """
    return F.trim(F.regexp_replace(text, f"(?![!-~])(?: {SPACE}+|{OTHER_SPACE}{SPACE}*)", " "))


#: Dutch words that carry no content in retrieval; niet and geen are kept, as they decide questions of cover. Fixed values.
STOPWORDS = tuple(
    """de het een en of van in op te dat die deze dit is zijn was waren wordt worden
    werd als bij voor met aan er om ook naar uit over door tot dan maar nog al we ze je u hij zij
    men hun haar hem ons onze mijn heeft hebben had hadden kan kunnen kon zou zouden moet moeten
    mag mogen wel dus want omdat indien""".split()
)
#: A retrieval token: letters and digits, with article numbers such as 4:22a kept whole. Fixed values.
TOKEN = "[a-zà-ÿ0-9]+(?::[0-9]+[a-z]?)*"
#: Endings of which one is cut from words of more than six letters. Fixed values.
ENDING = "(ingen|heden|en|er|s)$"
LONG = 6


def tokens(text: Column) -> Column:
    """Retrieval tokens in order: lower case, no stopwords or single letters, one ending cut. Null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    return F.transform(kept, lambda w: F.when(F.length(w) > LONG, F.regexp_replace(w, ENDING, "")).otherwise(w))


def joined(*fields: Column) -> Column:
    """Fields joined by a space, a null as an empty one."""
    return F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def letters(text: Column) -> Column:
    """Only digits, Latin letters, the euro and the percent sign, in lower case: two prints of one wording are equal."""
    return F.lower(F.regexp_replace(text, "[^0-9a-zA-Zà-öø-ÿ€%]", ""))


def normal(text: Column) -> Column:
    """White space collapsed; an empty text is null, one of white space empty."""
    return collapse(F.nullif(text, F.lit("")))


#: Entities resolved in built-in expressions; others are left as they stand. Fixed values.
ENTITIES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&euro;": "€", "&eacute;": "é", "&euml;": "ë", "&iuml;": "ï", "&ndash;": "–", "&amp;": "&"}


def without_tags(html: Column) -> Column:
    """Tags made spaces, common entities resolved, white space collapsed; nothing left gives null."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.nullif(collapse(out), F.lit(""))


def clipped(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after a sentence if one ends beyond 0.4 of them, else after a word with a mark."""
    return let(text, lambda whole: F.when(F.length(whole) <= limit, whole).otherwise(let(F.left(whole, F.lit(limit)), lambda cut: _shortened(cut, limit))))


def _shortened(cut: Column, limit: int) -> Column:
    def after(mark: str) -> Column:
        """Characters before the last mark, -1 if there is none."""
        return F.when(F.contains(cut, F.lit(mark)), F.length(cut) - F.length(F.substring_index(cut, mark, -1)) - 2).otherwise(F.lit(-1))

    word = F.rtrim(F.when(F.contains(cut, F.lit(" ")), F.left(cut, F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1)).otherwise(cut))
    out = F.when(cut.isNull(), cut)
    for mark in (". ", "! ", "? "):
        out = out.when(after(mark) > 0.4 * limit, F.left(cut, after(mark) + 1))
    return out.otherwise(F.concat(word, F.lit(" [...]")))


def tags(text: Column) -> Column:
    """A comma list as an array, trimmed, without empty entries; null if none is left."""
    parts = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(parts) > 0, parts)


def chunks(text: Column, width: int) -> Column:
    """The text in pieces of ``width`` characters, for sending it bit by bit; an empty text gives none."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int")), lambda i: F.substring(text, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


#: Lines that a printed page adds: bare page numbers, page marks, links back, running heads, glyphs. Fixed values.
FURNITURE = (
    r"^\s*(\d{1,3}|\*\s*Zie Begrippen|terug naar inhoud\s*>|Algemene voorwaarden|Voorwaarden Woonverzekering|Pagina \d+/\d+|\d+ van\s?\d+ (Verzekeringsvoorwaarden|Algemene voorwaarden) .*|°"
    r"|Voorwaarden arbeidsongeschiktheidsverzekering model \d+\s+\d+/\d+|\d+\. (Wettelijke Aansprakelijkheid \(WA\)|Volledig Casco|Beperkt Casco))\s*$"
)
#: Words whose first letter a print sets apart. Fixed values.
SPLIT_WORDS = {"T errorisme": "Terrorisme", "T otale": "Totale", "T eruggevonden": "Teruggevonden"}


def without_furniture(text: Column) -> Column:
    """Page furniture lines dropped, split words and hyphenation at line ends undone, soft hyphens removed, spaces and blank lines reduced."""
    bare = F.regexp_replace(text, "[­﻿]", "")
    for apart, word in SPLIT_WORDS.items():
        bare = F.replace(bare, F.lit(apart), F.lit(word))
    lines = F.transform(F.filter(F.split(bare, "\n"), lambda r: ~r.rlike(FURNITURE)), lambda r: F.regexp_replace(r, f"{SPACE}+$", ""))
    out = F.regexp_replace(F.array_join(lines, "\n"), "(?<=[a-zà-öø-ÿ])-\n(?=[a-zà-öø-ÿ])", "")
    return F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")


def composed(text: Column) -> Column:
    """Letters and their marks as single characters (NFC), by whole Arrow batches: Spark has no expression for it."""

    @F.arrow_udf("string")
    def nfc(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())

    return nfc(text)


def cleaned(text: Column) -> Column:
    """A printed text made readable without changing its wording: composed characters, no furniture, no hyphenation."""
    return without_furniture(composed(text))


#: Starts of a line that opens an item of its own. Fixed values.
ITEM = r"^(?:[•·–]|-\s|[a-z]\.\s|\d+\.\s|\d+(?:\.\d+)+\s|Artikel \d+)"


def rejoined(text: Column) -> Column:
    """Wrapped lines joined to their paragraph; lines that open a list item or member stay on their own."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda r: F.trim(F.regexp_replace(r, "[ \t\r]+", " "))), lambda r: r != "")
    return F.array_join(F.transform(lines, lambda r, i: F.concat(F.when(i == 0, "").when(r.rlike(ITEM), "\n").otherwise(" "), r)), "")


def after_contents(text: Column, scan: int = 220) -> Column:
    """The text after its table of contents: after the last of the first ``scan`` lines that ends in a page number.

    Null if that would drop more than half of the text, so a wrong guess can't pass as a body.
    """
    lines = F.split(text, "\n")
    listed = F.transform(F.slice(lines, 1, scan), lambda r, i: F.when((F.length(F.trim(r)) > 15) & F.trim(r).rlike(r"^\S.*\s\d{1,3}\s*$"), i))
    last = F.array_max(listed)
    body = F.array_join(F.slice(lines, last + 2, F.greatest(F.size(lines), F.lit(1))), "\n")
    return F.when(last.isNull(), text).when(F.length(body) >= 0.5 * F.length(text), body)


def times(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def between(text: Column, start: Column, end: Column) -> Column:
    """struct(cut, error): the text from marker ``start`` up to marker ``end``, white space collapsed in all three.

    Both markers must occur exactly once and in order, else ``cut`` is null and ``error`` says why. A null end takes the
    rest of the text.
    """
    flat, a, b = collapse(text), collapse(start), collapse(end)
    at, to = F.instr(flat, a), F.instr(flat, b)
    error = (
        F.when(times(flat, a) != 1, F.concat(F.lit("start "), times(flat, a), F.lit("x")))
        .when(b.isNotNull() & (times(flat, b) != 1), F.concat(F.lit("end "), times(flat, b), F.lit("x")))
        .when(to <= at, "end before start")
    )
    cut = F.when(b.isNull(), F.substring(flat, at, F.length(flat))).otherwise(F.substring(flat, at, to - at))
    return F.struct(F.when(error.isNull(), F.trim(cut)).alias("cut"), error.alias("error"))


def _spelt(marker: Column) -> Column:
    """A pattern for a marker, whatever white space stands between its words."""
    return F.array_join(F.transform(F.split(collapse(marker), " "), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), f"{SPACE}+")


def clause_between(text: Column, start: Column, end: Column, lead: Column) -> Column:
    """struct(cut, error): the text from ``start`` up to ``end`` as ``between`` finds it, with its lines kept.

    Wrapped lines are joined to their paragraph. A ``lead`` that isn't null is cut off the beginning of the piece, and
    must stand there, else that is the error.
    """
    found = between(text, start, end)["error"]
    until = F.when(end.isNull(), F.lit("$")).otherwise(F.concat(F.lit("(?="), _spelt(end), F.lit(")")))
    raw = F.call_function("regexp_extract", text, F.concat(F.lit("(?s)("), _spelt(start), F.lit(".*?)"), until), F.lit(1))
    piece = rejoined(raw)
    kept = F.when(lead.isNull(), piece).otherwise(F.regexp_replace(piece, F.concat(F.lit("^"), F.coalesce(_spelt(lead), F.lit("")), F.lit(f"{SPACE}*")), F.lit("")))
    error = F.coalesce(found, F.when(lead.isNotNull() & ~F.startswith(collapse(piece), collapse(lead)), "lead not at the beginning"))
    return F.struct(F.when(error.isNull(), kept).alias("cut"), error.alias("error"))


#: Dutch month names in order. Fixed values.
MONTHS = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
DATE = r"\b(\d{1,2}) (" + "|".join(MONTHS) + r") (\d{4})\b"


def dates(text: Column) -> Column:
    """All dates written as day, Dutch month and year, in order; days that don't exist are null."""
    found = F.regexp_extract_all(text, F.lit(DATE), F.lit(0))
    number = F.map_from_arrays(F.array(*map(F.lit, MONTHS)), F.array(*[F.lit(i + 1) for i in range(12)]))

    def date(d: Column) -> Column:
        part = F.split(d, " ")
        iso = F.concat_ws("-", part[2], F.lpad(F.element_at(number, part[1]).cast("string"), 2, "0"), F.lpad(part[0], 2, "0"))
        return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")

    return F.transform(found, date)


def ticks_date(ticks: Column) -> Column:
    """The UTC date of a count of 100 ns since year 1; null outside the range of dates."""
    return F.timestamp_seconds(ticks.cast("double") / 10_000_000 - 62_135_596_800).cast("date")
