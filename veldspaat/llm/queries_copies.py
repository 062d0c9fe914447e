"""Problem 3: clauses that are versions of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.llm.nearcopies import groups, item_pairs, near_copies
from veldspaat.sources.tables import table

#: What TESTDATA.md asks of this table, instead of five words and 0.8.
WIDTH, SIMILARITY, LEAST_WORDS = 3, 0.6, 20
WORD = r"[\p{L}\p{Nd}]+"


def _copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    clauses = table(spark, folder, "polisvoorwaarden").select("rij_id", "kop", "tekst").where(F.regexp_count("tekst", F.lit(WORD)) >= LEAST_WORDS)
    text = F.concat(F.coalesce("kop", F.lit("")), F.lit(" "), F.col("tekst"))
    return near_copies(clauses, item="rij_id", text=text, width=WIDTH, similarity=SIMILARITY)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of clauses with a similarity of at least 0.6."""
    return item_pairs(*_copies(spark, folder), item="rij_id").select(F.col("a").alias("rij_a"), F.col("b").alias("rij_b"))


def p3_groepen(spark: SparkSession, folder: str) -> DataFrame:
    """Each clause with its class of equal texts, its number of links and its group of versions."""
    found = groups(*_copies(spark, folder), item="rij_id")
    return found.select("rij_id", F.col("class").alias("klasse"), F.col("copies").alias("exemplaren"), F.col("n_links").alias("verbanden"), F.col("group").alias("groep"))


_FOUND = r"""
with texts as (
  select distinct rij_id, regexp_extract_all(lower(coalesce(kop, '') || ' ' || tekst), '[\p{L}\p{Nd}]+') as w from polisvoorwaarden
  where len(regexp_extract_all(tekst, '[\p{L}\p{Nd}]+')) >= 20
), reeksen as (
  select rij_id, s from (select rij_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s from texts)
), maten as (select rij_id, count(*) as n from reeksen group by 1),
samen as (select a.rij_id as rij_a, b.rij_id as rij_b, count(*) as c from reeksen a join reeksen b on a.s = b.s and a.rij_id < b.rij_id group by all)
select rij_a, rij_b from samen join maten x on x.rij_id = rij_a join maten y on y.rij_id = rij_b where c * 10 >= 6 * (x.n + y.n - c)
"""

_GROUPS = r"""
with recursive texts as (
  select distinct rij_id, regexp_extract_all(lower(coalesce(kop, '') || ' ' || tekst), '[\p{L}\p{Nd}]+') as w from polisvoorwaarden
  where len(regexp_extract_all(tekst, '[\p{L}\p{Nd}]+')) >= 20
), verzamelingen as (select rij_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s from texts),
klassen as (select s, min(rij_id) as klasse, count(*) as exemplaren from verzamelingen group by s),
reeksen as (select klasse, len(s) as n, unnest(s) as r from klassen),
paren as (select a.klasse as a, b.klasse as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from reeksen a join reeksen b on a.r = b.r and a.klasse <> b.klasse group by 1, 2),
randen as (select a, b from paren where c * 10 >= 6 * (na + nb - c)),
bereik as (select klasse as a, klasse as b from klassen union select bereik.a, randen.b from bereik join randen on bereik.b = randen.a),
groepen as (select a as klasse, min(b) as groep from bereik group by 1)
select rij_id, k.klasse, exemplaren, (select count(*) from randen where randen.a = k.klasse) as verbanden, groep
from verzamelingen v join klassen k on v.s = k.s join groepen g on g.klasse = k.klasse
"""

QUERIES = {"p3_found": p3_found, "p3_groepen": p3_groepen}
SQL = {"p3_found": _FOUND, "p3_groepen": _GROUPS}
