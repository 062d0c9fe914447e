"""Column functions that find and check references to articles, rulings and clauses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of a reference, group 1 the key. Fixed values.
ARTICLE = r"(?i)\b(?:art(?:ikel)?\.?\s*)?(\d+:\d+[a-z]?|\d+[a-z])\b(?:\s*lid\s*(\d+))?"
RULING = r"\b(20\d{2}-\d{3,5})\b"
CLAUSE = r"(?i)\b(?:art(?:ikel)?\.?\s*)(\d+(?:\.\d+){1,3})\b"
#: kind, pattern; in the order in which kinds are reported.
KINDS = (("kifid", RULING), ("wetsartikel", ARTICLE), ("polisclausule", CLAUSE))
MARK = " ⚠️[niet in corpus]"


def starts(text: Column, pattern: str) -> Column:
    """Character offsets of all matches, by one running sum over the gaps between matches and the matches themselves."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    widths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(widths)), widths, lambda gap, width: F.struct(gap.alias("gap"), width.alias("width")))
    none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end"))

    def step(done: Column, s: Column) -> Column:
        return F.struct(F.array_append(done["at"], done["end"] + s["gap"]).alias("at"), (done["end"] + s["gap"] + s["width"]).alias("end"))

    return F.aggregate(steps, none, step, lambda done: done["at"])


def references(text: Column) -> Column:
    """array(kind, key, position) of all references, by kind and then in order of the text; a null text has none.

    A number with a letter but no colon, such as 86c, is an article too; whether it is meant as one only a match tells.
    """
    text = F.coalesce(text, F.lit(""))

    def found(kind: str, pattern: str) -> Column:
        keys = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)
        return F.zip_with(keys, starts(text, pattern), lambda k, p: F.struct(F.lit(kind).alias("soort"), k.alias("verwijzing"), p.cast("int").alias("positie")))

    return F.concat(*[found(kind, pattern) for kind, pattern in KINDS])


def basis_parts(basis: Column) -> Column:
    """struct(key, member) of a basis such as BW:7:958:5: a book of the BW belongs to the key, elsewhere the key has two parts."""
    part = F.split(basis, ":")
    book = F.get(part, F.lit(0)) == "BW"
    size = F.when(book, 3).otherwise(2)
    return F.struct(F.array_join(F.slice(part, 1, size), ":").alias("key"), F.get(part, size).alias("member"))


def law_keys(article: Column) -> Column:
    """Spellings under which an article can be cited."""
    key = F.lower(F.trim(article))
    bare = F.trim(F.replace(F.replace(key, F.lit("art."), F.lit("")), F.lit("artikel"), F.lit("")))
    return F.filter(F.array_distinct(F.array(key, bare)), lambda k: k.isNotNull() & (k != ""))


def clause_keys(clause: Column) -> Column:
    """Spellings under which a clause can be cited. A leading word other than art. stays, so such clauses don't match."""
    key = F.lower(F.trim(clause))
    return F.filter(F.array_distinct(F.array(key, F.trim(F.regexp_replace(key, r"^art(?:ikel)?\.?\s*", "")))), lambda k: k.isNotNull() & (k != ""))


def ruling_keys(number: Column) -> Column:
    return F.filter(F.array(F.trim(number)), lambda k: k.isNotNull() & (k != ""))


def masked(text: Column, references: Column) -> Column:
    """The text with a mark behind the first free-standing occurrence of each reference, the last position first.

    Without references the text is unchanged.
    """
    ordered = F.reverse(F.array_sort(F.transform(references, lambda r: F.struct(r["positie"], r["verwijzing"]))))

    def mark(done: Column, r: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)^(?s)(.*?)(?<![\w>])(\Q"), r["verwijzing"], F.lit(r"\E)(?![\w<])"))
        return F.regexp_replace(done, pattern, F.lit("$1$2" + MARK))

    return F.aggregate(ordered, text, mark)


#: A finding on the complaint, in the decision itself. Fixed values, tried in order.
DECIDED = (
    (r"klacht (?:is |wordt )?(?:deels|gedeeltelijk) gegrond|verklaart de klacht (?:deels|gedeeltelijk) gegrond", "gedeeltelijk gegrond"),
    (r"klacht (?:is|wordt)? ?ongegrond|verklaart de klacht ongegrond", "ongegrond"),
    (r"verklaart de klacht gegrond|\bklacht is gegrond\b", "gegrond"),
    (r"^\s*de commissie verklaart de (?:klacht niet[- ]behandelbaar|consument niet[- ]ontvankelijk)\.?\s*$", "niet-ontvankelijk"),
)
#: What a heading says, as far as it is unambiguous. Fixed values.
HEADED = {
    "ongegrond": ("vordering afgewezen", "vordering geheel afgewezen"),
    "gegrond": ("vordering toegewezen", "vordering geheel toegewezen"),
    "gedeeltelijk gegrond": ("vordering gedeeltelijk toegewezen", "vordering (gedeeltelijk) toegewezen", "vordering deels toegewezen", "vordering gedeeltelijk afgewezen"),
}
DISMISSED = r"^\s*de commissie wijst de vordering(?:en)?(?: van de consument)? af\.?\s*$"


def outcome(heading: Column, decision: Column) -> Column:
    """struct(oordeel, herkomst) from the wording of a decision and its heading, null if neither is explicit."""
    b = F.lower(F.coalesce(decision, F.lit("")))
    u = F.replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(heading, F.lit(""))), r"\s+", " "), r"^[ .:]+|[ .:]+$", ""), F.lit("vorderingen"), F.lit("vordering"))

    def found(verdict: str | None, source: str | None) -> Column:
        return F.struct(F.lit(verdict).cast("string").alias("oordeel"), F.lit(source).cast("string").alias("herkomst"))

    out = F.when(F.lit(False), found(None, None))
    for pattern, verdict in DECIDED:
        out = out.when(b.rlike(pattern), found(verdict, "expliciet in beslissing"))
    out = out.when(u.rlike("niet[- ]ontvankelijk"), found("niet-ontvankelijk", "kopregel Uitkomst"))
    out = out.when(u.rlike("niet[- ]behandelbaar"), F.when(u.rlike("gedeeltelijk|deels"), found(None, None)).otherwise(found("niet-ontvankelijk", "kopregel Uitkomst")))
    for verdict, words in HEADED.items():
        out = out.when(u.isin(*words), found(verdict, "kopregel Uitkomst"))
    out = out.when(u != "", found(None, None))
    return out.when(b.rlike(DISMISSED), found("ongegrond", "letterlijke beslissing")).otherwise(found(None, None))
