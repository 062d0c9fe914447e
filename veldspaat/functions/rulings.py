"""Column functions that read the fields of a ruling out of its printed text.

The head of a ruling comes in two layouts: labels before their values ('fwd') or behind them ('rev').
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspaat.functions.text import MONTHS, clipped, collapse, dates

# What printed rulings say, in Java's syntax.
_MONTH = "|".join(MONTHS)
_DAY = rf"\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}"
_NATURE = r"(?:Niet-)?[Bb]indend advies"
LAYOUTS = (
    (rf"Aard\s+uitspraak\s+{_NATURE}", "fwd"),
    (rf"{_NATURE}\s+Aard\s+uitspraak", "rev"),
    (rf"Datum\s+uitspraak\s+{_DAY}", "fwd"),
    (rf"{_DAY}\s+Datum\s+uitspraak", "rev"),
)
NATURE = {"fwd": rf"Aard\s+uitspraak\s+({_NATURE})", "rev": rf"({_NATURE})\s+Aard\s+uitspraak"}
DATE = {"fwd": rf"Datum\s+uitspraak\s+({_DAY})", "rev": rf"({_DAY})\s+Datum\s+uitspraak"}
OUTCOME = {
    "fwd": r"\bUitkomst\s+(.{3,160}?)\s*(?=Bijlage\b|Samenvatting\b|Relevante bepaling|\d\s*\.\s*Procedure\b|\d\s*\.\s*Het procesverloop\b)",
    "rev": r"Aard\s+uitspraak\s+(.{3,160}?)\s+Uitkomst\b",
}
COMPLAINT = tuple(rf"(?s)\b\d\s*\.\s*{title}\b\s*(.*?)(?=\b\d\s*\.\s*[A-Z])" for title in ("De kern", "Het geschil", "De klacht")) + (
    r"(?s)\bSamenvatting\b\s*(.*?)(?=\b\d\s*\.\s*(?:Procedure|Het procesverloop|Procesverloop)\b)",
)
_AFTER = r"(?=Deze uitspraak is|Of u tegen deze uitspraak|Binnen 2 weken|{}In artikel \d+ van het Reglement|U kunt|$)"
DECISION = (r"(?s)(?:\b\d\s*\.\s*)?\bDe beslissing\b\s*(.*?)" + _AFTER.format("Bij deze uitspraak|"), r"(?s)\bBeslissing\b\s*(.*?)" + _AFTER.format(""))
CONCLUSION = r"(?s)\bConclusie\b\s*(.*?)(?=(?:\b\d\s*\.\s*)?\bDe beslissing\b|$)"
NOTES = r"(?s)\s+\d+\s+(?:Artikel|HR |Hoge Raad|Zie ook|Verordening|Dit volgt).*$"
PAGE = r"\s*\d{1,2}\s*/\s*\d{1,3}\s*$"


def _found(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _by_layout(text: Column, patterns: dict[str, str]) -> Column:
    out = None
    for name, pattern in patterns.items():
        hit = _found(text, pattern)
        out = F.when(layout(text) == name, hit) if out is None else out.when(layout(text) == name, hit)
    return out


def layout(text: Column) -> Column:
    """fwd, rev or null, by the first label that is recognised."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in LAYOUTS:
        out = out.when(text.rlike(pattern), name)
    return out


def nature(text: Column) -> Column:
    """struct(aard, bindend): the kind of ruling as printed, and whether it binds; nulls if it isn't printed."""
    kind = collapse(_by_layout(text, NATURE))
    return F.struct(kind.alias("aard"), (~F.startswith(F.lower(kind), F.lit("niet"))).alias("bindend"))


def number_of(title: Column, text: Column) -> Column:
    """The ruling number in the title, else behind "nr" in the text; null if neither has one."""
    return F.coalesce(_found(collapse(title), r"(\d{4}-\d{3,5})"), _found(text, r"\bnr\.?\s*(\d{4}-\d{3,5})"))


def printed_date(text: Column) -> Column:
    """The date of the ruling as printed; null for a day that doesn't exist."""
    return F.get(dates(collapse(_by_layout(text, DATE))), F.lit(0))


def printed_outcome(text: Column) -> Column:
    """The outcome line of the head, without the provisions that may follow it."""
    return F.nullif(F.trim(F.regexp_replace(collapse(_by_layout(text, OUTCOME)), r"\s*Relevante bepaling.*$", "")), F.lit(""))


def complaint(text: Column) -> Column:
    """The section that sums up the complaint: the first of four titles with at least 60 characters, at most 2,500."""
    tried = [collapse(_found(text, p)) for p in COMPLAINT]
    return F.coalesce(*[F.when(F.length(t) >= 60, clipped(t, 2500)) for t in tried])


def decision(text: Column) -> Column:
    """The decision, without footnotes and page numbers, at most 900 characters; null up to ten characters."""
    raw = F.coalesce(*[_found(text, p) for p in DECISION])
    t = F.trim(F.regexp_replace(F.regexp_replace(collapse(raw), NOTES, ""), PAGE, ""))
    return F.when(F.length(t) > 10, clipped(t, 900))


def conclusion(text: Column) -> Column:
    """The last conclusion of more than 60 and fewer than 2,500 characters, at most 1,200 of them.

    A conclusion runs on to the decision or the end, over further headings of its kind.
    """
    all_of_them = F.transform(F.regexp_extract_all(text, F.lit(CONCLUSION), F.lit(1)), lambda t: F.trim(F.regexp_replace(collapse(t), PAGE, "")))
    fit = F.filter(all_of_them, lambda t: (F.length(t) > 60) & (F.length(t) < 2500))
    return clipped(F.when(F.size(fit) > 0, F.element_at(fit, -1)), 1200)
