"""Column functions on addresses, captures and dates as they are delivered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a page says instead of its content when it keeps a reader out. Fixed values.
BLOCKED = ("Werk aan de winkel", "even niet bereikbaar", "Access Denied", "Pardon Our Interruption", "Even geduld", "verify you are human", "Je browser wordt gecontroleerd")
LEAST_BYTES, HEAD = 5000, 3000


def anchor(path: Column) -> Column:
    """The anchor of a part of a law: its path without a leading slash, separators made underscores."""
    return F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "[/:]", "_")


def article_address(base: Column, day: Column, part: Column) -> Column:
    """The address of a part of a law as it held on a day."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit("#"), anchor(part))


def bound(number: Column, title: Column, address: Column, expected: Column) -> Column:
    """Whether a search result is the ruling at the address it should have; null if nothing was found to compare.

    The number is looked for in the title without its white space; a slash at the end of an address doesn't matter.
    """
    bare = F.regexp_replace(title, r"(?U)\s+", "")
    same = F.regexp_replace(address, "/+$", "") == F.regexp_replace(expected, "/+$", "")
    return F.when(title.isNotNull() & address.isNotNull(), F.contains(bare, number) & same)


def captured(size: Column, text: Column) -> Column:
    """Whether a capture shows its page: large enough, and none of the phrases that keep readers out at its beginning."""
    head = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(HEAD)))
    kept_out = F.lit(False)
    for phrase in BLOCKED:
        kept_out = kept_out | F.contains(head, F.lit(phrase.lower()))
    return (F.coalesce(size, F.lit(0)) > LEAST_BYTES) & ~kept_out


#: A landed print that is smaller than this isn't one.
LEAST_PRINT = 1024


def reachable(status: Column) -> Column:
    """Whether an address answered with its content, whole (200) or in part (206); no answer is none."""
    return F.coalesce(status.isin(200, 206), F.lit(False))


def print_key(address: Column) -> Column:
    """The file name under which the print of an address is kept."""
    return F.concat(F.sha1(address), F.lit(".pdf"))


def print_kept(size: Column, head: Column | None = None) -> Column:
    """Whether a kept file can be the print: over 1,024 bytes and, where its first bytes are given, a PDF."""
    large = F.coalesce(size, F.lit(0)) > LEAST_PRINT
    return large if head is None else large & F.startswith(F.coalesce(head, F.lit("")), F.lit("%PDF"))


def file_name(path: Column) -> Column:
    """The part of a path or address behind the last slash, without what follows a question mark."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[?#].*$", "")


def iso_date(text: Column) -> Column:
    """struct(date, error): a date written yyyy-mm-dd. Nothing gives neither, anything else an error."""
    written = F.nullif(F.trim(text), F.lit(""))
    date = F.when(written.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date"))
    return F.struct(date.alias("date"), F.when(written.isNotNull() & date.isNull(), F.concat(F.lit("no date: "), written)).alias("error"))
