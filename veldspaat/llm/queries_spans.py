"""Problem 1: passages that stand in more than one clause or complaint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.functions.text import SPACE, collapse
from veldspaat.llm.spans import shared_spans
from veldspaat.sources.tables import table


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    clauses = table(spark, folder, "polisvoorwaarden").select(F.lit("polisvoorwaarden").alias("bron"), "rij_id", F.lit(None).cast("string").alias("zaak"), "tekst")
    rulings = table(spark, folder, "kifid").select(F.lit("kifid").alias("bron"), "rij_id", F.col("uitspraaknummer").alias("zaak"), F.col("kern_klacht").alias("tekst"))
    return shared_spans(clauses.unionByName(rulings), ids=["bron", "rij_id"], owner=F.col("zaak"), text=collapse(F.col("tekst")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a span of 160 characters or more that stands in another record."""
    return _spans(spark, folder).select("bron", "rij_id")


def p1_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each shared passage, and the share of the record's characters that stands elsewhere."""
    return _spans(spark, folder).select("bron", "rij_id", "n_chars", "n_shared", F.round("share", 6).alias("share"), F.inline("spans"))


_FOUND = f"""
with texts as (
  select distinct 'polisvoorwaarden' as bron, rij_id, 'r' || rij_id as eigenaar, trim(regexp_replace(tekst, '{SPACE}+', ' ', 'g')) as t from polisvoorwaarden
  union select distinct 'kifid', rij_id, coalesce('z' || uitspraaknummer, 'k' || rij_id), trim(regexp_replace(kern_klacht, '{SPACE}+', ' ', 'g')) from kifid
), vensters as (
  select bron, rij_id, eigenaar, md5(substr(t, i, 160)) as h from (select *, unnest(range(1, length(t) - 158)) as i from texts where length(t) >= 160)
)
select distinct bron, rij_id from vensters where h in (select h from vensters group by h having min(eigenaar) <> max(eigenaar))
"""

_SPANS = _FOUND.replace("eigenaar, md5(", "eigenaar, i, md5(").replace("select distinct bron, rij_id from vensters", """, herhaald as (select distinct bron, rij_id, i from vensters""") + """),
stukken as (select bron, rij_id, i, sum(nieuw) over (partition by bron, rij_id order by i) as stuk from (
  select *, case when i - lag(i) over (partition by bron, rij_id order by i) <= 160 then 0 else 1 end as nieuw from herhaald)),
delen as (select bron, rij_id, (min(i) - 1)::int as start, (max(i) + 159)::int as stop from stukken group by bron, rij_id, stuk),
gedeeld as (select bron, rij_id, sum(stop - start)::int as n_shared from delen group by all)
select d.bron, d.rij_id, length(t)::int as n_chars, n_shared, round(n_shared / length(t), 6) as share, start, stop
from delen d join gedeeld g on d.bron = g.bron and d.rij_id = g.rij_id join (select distinct bron, rij_id, t from texts) x on x.bron = d.bron and x.rij_id = d.rij_id
"""

QUERIES = {"p1_found": p1_found, "p1_spans": p1_spans}
SQL = {"p1_found": _FOUND, "p1_spans": _SPANS}
