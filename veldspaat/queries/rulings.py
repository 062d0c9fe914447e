"""Queries that read rulings back from a print, and compare wordings with their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.functions.rulings import complaint, decision, layout, nature, printed_outcome
from veldspaat.functions.text import clipped, collapse, letters
from veldspaat.operators.clauses import cut_clauses, foreign_stretches
from veldspaat.operators.gate import print_check
from veldspaat.operators.ranking import first_per_key
from veldspaat.queries.sqltext import collapse as squash
from veldspaat.sources.tables import table


def _printed(spark: SparkSession, folder: str) -> DataFrame:
    """Rulings set as a print, every other one with its labels behind the values."""
    rows = first_per_key(table(spark, folder, "kifid").where("kern_klacht is not null and uitkomst_letterlijk is not null"), ["rij_id"], [F.col("rij_id")])
    head = F.when(
        F.col("rij_id") % 2 == 0, F.concat(F.lit("Aard uitspraak Bindend advies Uitkomst "), "uitkomst_letterlijk", F.lit(" Bijlage ")),
    ).otherwise(F.concat(F.lit("Bindend advies Aard uitspraak "), "uitkomst_letterlijk", F.lit(" Uitkomst ")))
    body = F.concat(F.lit("\n1. De kern "), "kern_klacht", F.lit("\n2. Procedure\n3. De beslissing "), F.coalesce("beslissing_letterlijk", F.lit("")), F.lit(" Deze uitspraak is bindend."))
    return rows.withColumn("print", F.concat(head, body))


def rulings_read_back(spark: SparkSession, folder: str) -> DataFrame:
    """How many rulings come back from their print as they went in, by layout and field."""
    rows = _printed(spark, folder)
    shown = F.col("print")
    same = {
        "aard": nature(shown)["aard"] == "Bindend advies",
        "uitkomst": printed_outcome(shown) == collapse(F.col("uitkomst_letterlijk")),
        "kern": complaint(shown) == clipped(collapse(F.col("kern_klacht")), 2500),
        "beslissing": decision(shown).eqNullSafe(clipped(collapse(F.col("beslissing_letterlijk")), 900)),
    }
    read = rows.select(layout(shown).alias("layout"), *[F.coalesce(v, F.lit(False)).alias(k) for k, v in same.items()])
    return read.unpivot(["layout"], list(same), "veld", "gelijk").groupBy("layout", "veld", "gelijk").agg(F.count("*").alias("n"))


def print_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Rulings by what their print says of them."""
    rows = table(spark, folder, "kifid")
    text = F.when(F.col("nummer_in_pdf"), F.concat(F.lit("Uitspraak "), "uitspraaknummer"))
    magic = F.when(F.col("pdf_leesfout").isNull(), F.lit("%PDF"))
    check = print_check(F.col("pdf_url"), F.col("pdf_http_status"), magic, text, F.col("uitspraaknummer"), F.col("audit_bevinding"))
    return rows.select(check.alias("c")).groupBy(F.col("c.verified").alias("verified"), F.regexp_replace("c.note", "^audit: .*", "audit").alias("note")).agg(F.count("*").alias("n"))


def member_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The first member of each article cut out by the beginnings of the first two, against the member itself."""
    laws = first_per_key(table(spark, folder, "wetgeving").where("size(leden) > 1"), ["rij_id"], [F.col("rij_id")])
    specs = laws.select("rij_id", F.left(F.get("leden", F.lit(0)), F.lit(40)).alias("van"), F.left(F.get("leden", F.lit(1)), F.lit(40)).alias("tot"))
    cut = cut_clauses(laws, specs, on="rij_id", text="tekst", start="van", end="tot")
    state = F.coalesce("error", F.when(collapse(F.col("cut")) == collapse(F.get("leden", F.lit(0))), "equal").otherwise("other"))
    return cut.join(laws.select("rij_id", "leden"), "rij_id").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def nonverbatim_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses that differ from the last delivery of the same clause, with up to three stretches that only they have."""
    now = table(spark, folder, "polisvoorwaarden").where("tekst <> ''").select("rij_id", "product", collapse(F.col("clausule_id")).alias("clausule_id"), "tekst").distinct()
    rows = table(spark, folder, "polis_levering").where("tekst is not null")
    last = rows.groupBy("product", collapse(F.col("clausule_id")).alias("clausule_id")).agg(F.max_by("tekst", F.struct("opgehaald_op", "ingelezen_op", "tekst")).alias("geleverd"))
    both = now.join(last, ["product", "clausule_id"]).where(~F.contains(letters(F.col("geleverd")), letters(F.col("tekst"))))
    return both.select("rij_id", F.array_join(foreign_stretches(collapse(F.col("tekst")), collapse(F.col("geleverd"))), " | ").alias("gaps"))


QUERIES = {f.__name__: f for f in (rulings_read_back, print_checks, member_cut, nonverbatim_gaps)}
SQL = {
    "member_cut": f"""
with t as (select rij_id, {squash("tekst")} as t, {squash("left(leden[1], 40)")} as a, {squash("left(leden[2], 40)")} as b, {squash("leden[1]")} as lid from wetgeving where len(leden) > 1 qualify row_number() over (partition by rij_id) = 1),
n as (select *, (length(t) - length(replace(t, a, ''))) // length(a) as na, (length(t) - length(replace(t, b, ''))) // length(b) as nb from t)
select case when na <> 1 then 'start ' || na || 'x' when nb <> 1 then 'end ' || nb || 'x' when strpos(t, b) <= strpos(t, a) then 'end before start'
  when trim(substr(t, strpos(t, a), strpos(t, b) - strpos(t, a))) = lid then 'equal' else 'other' end as state, count(*) as n from n group by 1""",
    "print_checks": """select verified, note, count(*) as n from (select
  coalesce(audit_bevinding, '') = '' and coalesce(pdf_url, '') <> '' and coalesce(pdf_http_status = 200, false) and pdf_leesfout is null and coalesce(nummer_in_pdf and uitspraaknummer <> '', false) as verified,
  case when coalesce(audit_bevinding, '') <> '' then 'audit' when coalesce(pdf_url, '') = '' then 'no address'
    when pdf_http_status is distinct from 200 or pdf_leesfout is not null then 'HTTP ' || coalesce(cast(pdf_http_status as varchar), '-') || ', no PDF'
    when coalesce(nummer_in_pdf and uitspraaknummer <> '', false) then 'number read back from the print' else 'number not in the print' end as note from kifid) group by all""",
}
