"""Queries on the archive of full deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.functions.text import SPACE, collapse
from veldspaat.operators.snapshots import snapshot_changes
from veldspaat.sources.tables import table

KINDS = ("toegevoegd", "verwijderd", "gewijzigd", "herdrukt")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(
        table(spark, folder, "polis_levering"),
        keys={"product": F.col("product"), "clausule_id": collapse(F.col("clausule_id"))},
        snapshot="opgehaald_op",
        version="ingelezen_op",
        content=[collapse(F.col("kop")), collapse(F.col("tekst")), F.col("type")],
        imprint=[F.lower("bron_pdf_sha256")],
        kinds=KINDS,
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses added, removed, changed or reprinted in each delivery against the one before."""
    return _changes(spark, folder).select("product", "clausule_id", F.date_format("opgehaald_op", "yyyy-MM-dd").alias("opgehaald_op"), F.col("kind").alias("soort"))


def p2_per_levering(spark: SparkSession, folder: str) -> DataFrame:
    """Number of changes of each kind in each delivery."""
    return p2_found(spark, folder).groupBy("opgehaald_op", "soort").agg(F.count("*").alias("aantal"))


def _squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}+', ' ', 'g'))"


_FOUND = f"""
with raw as (
  select product, {_squash("clausule_id")} as clausule_id, opgehaald_op, {_squash("kop")} as kop, {_squash("tekst")} as tekst, type,
         lower(bron_pdf_sha256) as sha, ingelezen_op
  from polis_levering where opgehaald_op is not null
), state as (
  select * from raw
  qualify row_number() over (partition by product, clausule_id, opgehaald_op order by ingelezen_op desc nulls last) = 1
), calendar as (
  select opgehaald_op as dag, lead(opgehaald_op) over (order by opgehaald_op) as later from (select distinct opgehaald_op from raw)
), after as (
  select s.*, s.opgehaald_op as dag from state s where s.opgehaald_op > (select min(dag) from calendar)
), before as (
  select s.*, c.later as dag from state s join calendar c on c.dag = s.opgehaald_op where c.later is not null
), paired as (
  select coalesce(a.product, b.product) as product, coalesce(a.clausule_id, b.clausule_id) as clausule_id, coalesce(a.dag, b.dag) as dag,
    case when b.dag is null then 'toegevoegd' when a.dag is null then 'verwijderd'
         when a.kop is distinct from b.kop or a.tekst is distinct from b.tekst or a.type is distinct from b.type then 'gewijzigd'
         when a.sha is distinct from b.sha then 'herdrukt' end as soort
  from after a full outer join before b
    on a.dag = b.dag and a.product is not distinct from b.product and a.clausule_id is not distinct from b.clausule_id
)
select product, clausule_id, strftime(dag, '%Y-%m-%d') as opgehaald_op, soort from paired where soort is not null
"""

QUERIES = {"p2_found": p2_found, "p2_per_levering": p2_per_levering}
SQL = {"p2_found": _FOUND, "p2_per_levering": f"select opgehaald_op, soort, count(*) as aantal from ({_FOUND}) group by all"}
