"""Text values that were cut off by a field limit or in transfer.

Two findings, told apart in the result:

* by length: per source and field, length histograms in characters and bytes are searched for spikes, lengths that far
  more different values have than their neighbours; a value at a spike without terminal punctuation is cut. A source may
  hold longer values than its limit, kept from before the limit came or after it went, so a spike is looked for at every
  length, not just at the greatest.
* by ending: cuts elsewhere show at the end of the value itself: a continuation mark, half an entity or tag, a hyphen, a
  comma, or no end of sentence in a field whose values end with one. In a field of phrases that may lack a full stop, the
  field's own finished values tell which words can come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspaat.plans.joins import BROADCAST_BYTES, bytes_of, salted_join, sized_join
from veldspaat.plans.shared import written

#: A spike has at least so many different values, that part of the values of its source's and field's commonest length,
#: and so many times the mean of the lengths around it.
SPIKE_VALUES, SPIKE_TOP, SPIKE_TIMES, AROUND = 5, 0.5, 8.0, 50
#: A value this much shorter than a spike counts as at it: white space trimmed, or half a character dropped, after the cut.
SLACK = 3
#: Part of the values off spikes that end as sentences, from which on an open end is a cut.
CONVENTION = 0.8
#: A last word that so many times as often has a full stop as not makes an open end a cut.
FULL_STOPS = 4

# Fixed patterns, in Java's syntax.
#: Marks that say the text goes on.
CONTINUES = r"(?i)(?:[\[(]\s*(?:\.{2,}|…)\s*[\])]|[\[(]?\s*(?:lees (?:verder|meer)|verder lezen|read more)\s*(?:\.{2,}|…)?\s*[\])]?|…|\.{3,})$"
#: The beginning of an entity, a tag or an escape.
BROKEN = r"(?:&(?:#?\w{0,7})?|</?\w{0,6}|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?)$"
#: What may stand behind a finished text: page numbers, a footnote mark, a bracketed note, a quoted remark.
BEHIND = r"(?:\s+\d{1,4}\s*/\s*\d{1,4}|(?<=[.!?])\d|(?<=[^\d\s][.!?])\d{1,2}|\s*[\[(][^\[\]()…]*[\])]|\s*\p{L}+: ?[‘“\"'][^’”\"']*[’”\"'])$"
#: A finished sentence.
TERMINAL = r"[.!?][’”\"')\]]*$"
#: A short form before a full stop, after which a sentence goes on.
SHORT = r"(?i)(?:^|[\s(])(?:art|artt|nr|nrs|par|blz|ca|dhr|mevr|mr|dr|bijv|resp|jo|vgl|o\.a|d\.w\.z|m\.b\.t|t\.a\.v|i\.v\.m|e\.d)\.$|(?:^|[\s(])(?:\p{Ll}\.){2,}$"
#: An amount whose thousands may follow: the currency, at most three digits and the separator.
THOUSANDS = r"€\s?\d{1,3}\.\d{0,2}$"
OPEN = r"(?:[,;:€(\[/&+=–—]|\p{L}-)$"
LAST = r"(\S+?)[.!?]*$"


def _shape(word: Column) -> Column:
    """A word in lower case, its digits made 9: amounts of one form are one word."""
    return F.regexp_replace(F.lower(word), r"\d", "9")


def spikes(values: DataFrame) -> DataFrame:
    """(source, field, unit, length) of the spikes among rows (source, field, value); unit is 'chars' or 'bytes'.

    Different values are counted, not rows: a phrase that many records share makes no spike. Lengths are counted before
    anything is ordered, so windows run over histograms, never over rows.
    """
    different = values.select("source", "field", F.xxhash64("value").alias("h"), F.length("value").alias("chars"), F.octet_length("value").alias("bytes")).distinct()
    lengths = different.unpivot(["source", "field"], ["chars", "bytes"], "unit", "length")
    histogram = lengths.groupBy("source", "field", "unit", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "field", "unit").orderBy("length").rangeBetween(-AROUND, AROUND)
    mean = (F.sum("n").over(near) - F.col("n")) / (2 * AROUND)
    rated = histogram.select("*", mean.alias("_mean"), F.max("n").over(Window.partitionBy("source", "field", "unit")).alias("_top"))
    least = F.greatest(F.lit(float(SPIKE_VALUES)), SPIKE_TOP * F.col("_top"), SPIKE_TIMES * F.col("_mean"))
    return rated.where(F.col("n") >= least).select("source", "field", "unit", "length")


def judged_values(records: DataFrame, *, item: str, source: str, fields: list[str]) -> DataFrame:
    """(item, source, field, n_chars, n_bytes, at_limit, shown_by, reason) of every value that isn't null or blank.

    shown_by is 'length' for a value at a spike of its source's and field's lengths that doesn't end as a whole one,
    'ending' for a cut that only the end of the value shows, null for a whole value. reason, null if whole, is 'mark' (a mark says the text goes on), 'broken' (half an entity, tag or escape), 'open' (hyphen, comma,
    colon, currency sign or the like at the end), 'limit' (at a spike length, no end of sentence), 'number' (at a spike
    length, within the thousands of an amount), 'short' (a short form such as art. at the end), 'sentence' (no end of
    sentence, in a field where whole values have one) or 'phrase' (the field's values never end on this word with a full
    stop, or hardly ever without one). White space at the end and what stands behind a finished text are looked past. Rows with equal item and
    field are one value; null and blank values are none; a null source is a source of its own. No table of any size is
    collected: spikes and finishing words are joined, broadcast only if their bytes allow it; else rows of a hot last
    word are spread. Texts are read twice and never shuffled.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    rows = records.select(F.col(item).alias("item"), F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("source"), pairs.alias("p"))
    values = rows.select("item", "source", "p.field", F.regexp_replace("p.value", r"(?U)\s+$", "").alias("value")).where("value <> ''")
    body = F.regexp_replace(F.regexp_replace("value", BEHIND, ""), r"(?U)\s+$", "")
    ends = values.select("item", "source", "field", "value", body.alias("body"), F.length("value").alias("n_chars"), F.octet_length("value").alias("n_bytes"))

    found = written(spikes(values), "truncation-spikes")
    limits = found.groupBy("source", "field").agg(*[F.collect_list(F.when(F.col("unit") == u, F.col("length"))).alias(f"_{u}") for u in ("chars", "bytes")])

    near = F.exists("_chars", lambda n: F.col("n_chars").between(n - SLACK, n)) | F.exists("_bytes", lambda n: F.col("n_bytes").between(n - SLACK, n))
    placed = sized_join(ends, written(limits, "truncation-limits"), ["source", "field"], "left").withColumn("at_limit", F.coalesce(near, F.lit(False))).drop("_chars", "_bytes")
    value, body = F.col("value"), F.col("body")
    whole = body.rlike(TERMINAL) & ~body.rlike(SHORT)
    shown = (
        F.when(value.rlike(CONTINUES), "mark")
        .when(value.rlike(BROKEN), "broken")
        .when(F.col("at_limit") & value.rlike(THOUSANDS), "number")
        .when(body.rlike(SHORT), "short")
        .when(F.col("_whole"), None)
        .when(body.rlike(OPEN), "open")
        .when(F.col("at_limit"), "limit")
    )
    placed = placed.withColumn("_whole", whole).withColumn("last", _shape(F.regexp_extract("body", LAST, 1))).withColumn("_shown", shown).drop("value", "body")
    placed = written(placed, "truncation-values")
    words = placed.where(~F.col("at_limit")).groupBy("field", "last").agg(F.count_if("_whole").alias("_closed"), F.count_if(~F.col("_whole")).alias("_left_open"), F.count("*").alias("_n"))
    words = written(words, "truncation-words")
    custom = words.groupBy("field").agg((F.sum("_closed") >= CONVENTION * F.sum(F.col("_closed") + F.col("_left_open"))).alias("_sentences"))
    placed = sized_join(placed, written(custom, "truncation-custom"), ["field"], "left")
    if bytes_of(words) <= BROADCAST_BYTES:
        placed = placed.join(F.broadcast(words), ["field", "last"], "left")
    else:
        placed = salted_join(placed, words, ["field", "last"], "_n", placed.count(), "item", "left")
    odd = F.coalesce((F.col("_closed") == 0) | ((F.col("_closed") >= FULL_STOPS) & (F.col("_closed") >= FULL_STOPS * F.col("_left_open"))), F.lit(True))
    left_open = F.when(F.col("_whole"), None).when(F.col("_sentences"), "sentence").when(odd, "phrase")
    reason = F.coalesce("_shown", left_open)
    by = F.when(reason.isNotNull(), F.when(F.col("at_limit") & (~F.col("_whole") | (F.col("_shown") == "number")), "length").otherwise("ending"))
    return placed.select(F.col("item").alias(item), F.nullif("source", F.lit("\x00")).alias(source), "field", "n_chars", "n_bytes", "at_limit", by.alias("shown_by"), reason.alias("reason"))


def truncation_rates(judged: DataFrame, *, item: str, source: str) -> DataFrame:
    """(source, field, n_values, n_cut, rate, n_by_length, rate_by_length), each item counted once.

    n_by_length and rate_by_length are the part that the length histograms show.
    """
    cut, length = F.col("reason").isNotNull().cast("int"), F.coalesce(F.col("shown_by") == "length", F.lit(False)).cast("int")
    once = judged.groupBy(item, source, "field").agg(F.max(cut).alias("_cut"), F.max(length).alias("_length"))
    sums = [F.sum("_cut").alias("n_cut"), F.avg("_cut").alias("rate"), F.sum("_length").alias("n_by_length"), F.avg("_length").alias("rate_by_length")]
    return once.groupBy(source, "field").agg(F.count("*").alias("n_values"), *sums)
