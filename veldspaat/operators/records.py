"""Composing records from what was landed: rulings from prints, texts from pages, files from manifests, sets from parts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspaat.functions.addresses import file_name
from veldspaat.functions.citations import outcome
from veldspaat.functions.rulings import complaint, conclusion, decision, layout, nature, number_of, printed_date, printed_outcome
from veldspaat.functions.text import cleaned, normal, tags, ticks_date, without_tags
from veldspaat.plans.joins import sized_join
from veldspaat.plans.shared import written


def ruling_records(items: DataFrame, *, theme: Column, fetched: Column) -> DataFrame:
    """The record of each ruling, 24 columns, from search results (title, text, ticks, url, category, summary, authority,
    defendant, tags, pdf_url), ``text`` being the print's.

    A result without a print, a number or an address gives no record. Nothing is guessed: what a print doesn't say is null.
    The reasons are the conclusion, else the decision, and a column says which.
    """
    text = F.col("text")
    read = items.where("text <> '' and url <> ''").select("*", number_of(F.col("title"), text).alias("_number")).where("_number is not null")
    parts = read.select(
        "*",
        layout(text).alias("_layout"),
        nature(text).alias("_nature"),
        printed_outcome(text).alias("_outcome"),
        decision(text).alias("_decision"),
        conclusion(text).alias("_conclusion"),
        F.date_format(printed_date(text), "yyyy-MM-dd").alias("_printed"),
        F.date_format(ticks_date(F.col("ticks")), "yyyy-MM-dd").alias("_listed"),
    )
    binding = F.col("_nature.bindend").isNull() & text.rlike("Deze uitspraak is bindend")
    verdict = outcome(F.col("_outcome"), F.col("_decision"))
    source = F.when(F.col("_conclusion").isNotNull(), "Conclusie-paragraaf uit de uitspraak").when(F.col("_decision").isNotNull(), "Sectie 'De beslissing' uit de uitspraak")
    return parts.select(
        F.col("_number").alias("uitspraaknummer"),
        F.coalesce("_printed", "_listed").alias("datum"),
        F.nullif(normal(F.col("title")), F.lit("")).alias("titel"),
        normal(F.col("category")).alias("categorie"),
        complaint(text).alias("kern_klacht"),
        verdict["oordeel"].alias("oordeel"),
        F.when(binding, True).otherwise(F.col("_nature.bindend")).alias("bindend"),
        without_tags(F.col("summary")).alias("samenvatting"),
        F.coalesce("_conclusion", "_decision").alias("kernoverweging"),
        source.alias("kernoverweging_bron"),
        F.col("url").alias("bron_url"),
        fetched.alias("opgehaald_op"),
        F.col("_outcome").alias("uitkomst_letterlijk"),
        F.col("_decision").alias("beslissing_letterlijk"),
        F.when(binding, F.coalesce("_nature.aard", F.lit("Deze uitspraak is bindend"))).otherwise(F.col("_nature.aard")).alias("aard_uitspraak_letterlijk"),
        verdict["herkomst"].alias("oordeel_herkomst"),
        normal(F.col("authority")).alias("instantie"),
        normal(F.col("defendant")).alias("verweerder"),
        tags(F.col("tags")).alias("kifid_onderwerp_tags"),
        "pdf_url",
        theme.alias("thema"),
        F.col("_printed").alias("datum_uit_uitspraaktekst"),
        F.col("_listed").alias("datum_uit_api"),
        F.col("_layout").alias("kop_layout"),
    )


def live(records: DataFrame, status: Column) -> DataFrame:
    """The records whose address answered with 200; no answer is none."""
    return records.where(F.coalesce(status == 200, F.lit(False)))


def joined_pages(pages: DataFrame, *, document: list[str], page: list[str], text: str) -> DataFrame:
    """(*document, n_pages, text): the pages of each document in order, a line each, cleaned; a null page is empty.

    The pages gathered are those of one document.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*page, F.coalesce(text, F.lit("")).alias("_text"))))
    whole = pages.groupBy(*document).agg(ordered.alias("_pages")).select(*document, F.size("_pages").alias("n_pages"), F.array_join(F.transform("_pages", lambda p: p["_text"]), "\n").alias("_raw"))
    return whole.select(*document, "n_pages", cleaned(F.col("_raw")).alias("text"))


def described(files: DataFrame, manifest: DataFrame, *, file: str, name: str, description: str) -> DataFrame:
    """``files`` with ``name`` and ``description`` of their manifest, by file name; the manifest must have a file once.

    A file that isn't in the manifest is called by its own name without its ending, and has an empty description.
    """
    known = written(manifest.select(F.col(file).alias("_file"), F.col(name).alias("_name"), F.col(description).alias("_description")), "manifest")
    found = sized_join(files.withColumn("_file", F.col(file)), known, ["_file"], "left")
    own = F.regexp_replace(F.col(file), r"\.[^.]*$", "")
    return found.select(*files.columns, F.coalesce(F.nullif("_name", F.lit("")), own).alias(name), F.coalesce("_description", F.lit("")).alias(description))


def with_parts(files: DataFrame, parts: DataFrame, *, file: str, part: str, name: str) -> DataFrame:
    """``files`` with an array ``name`` of what is known of each, in order and without repeats, empty for a file of which nothing is.

    For areas to be masked in an image, or whatever else is listed by file; a file has few.
    """
    lists = written(parts.groupBy(F.col(file).alias("_file")).agg(F.array_sort(F.collect_set(part)).alias("_parts")), "parts")
    found = sized_join(files.withColumn("_file", F.col(file)), lists, ["_file"], "left")
    return found.select(*files.columns, F.coalesce("_parts", F.array()).alias(name))


def united(sets: Mapping[str, DataFrame], *, kind: str) -> DataFrame:
    """All rows of several sets, repeats kept, with the name of the set; a column that a set lacks is null there."""
    parts = [df.select("*", F.lit(name).alias(kind)) for name, df in sets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged_sets(old: DataFrame, new: DataFrame, *, key: list[str], left_out: DataFrame, newly_left_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, left out) after a further run: new sets replace old ones of the same key.

    A set left out before stays so unless it is there now or failed again; one that failed now is left out unless a set of
    its key is there.
    """
    kept = old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
    there = kept.select(*key).distinct()
    before = left_out.join(newly_left_out.select(*key).distinct(), key, "left_anti").join(there, key, "left_anti")
    return kept, before.unionByName(newly_left_out.join(there, key, "left_anti"))


def in_order(rows: DataFrame, catalogue: DataFrame, *, key: str, place: str, first: Column, unknown: int = 999) -> DataFrame:
    """``rows`` with ``place``: the place of their key in the catalogue, ``unknown`` for one that isn't there, then whether ``first`` holds."""
    known = written(catalogue.select(key, F.col(place).alias("_place")), "catalogue")
    return sized_join(rows, known, [key], "left").select(*rows.columns, F.struct(F.coalesce("_place", F.lit(unknown)).alias("n"), F.when(first, 0).otherwise(1).alias("m")).alias(place))


def file_of(address: Column) -> Column:
    """The file name of an address; null for an empty one."""
    return F.nullif(file_name(address), F.lit(""))
