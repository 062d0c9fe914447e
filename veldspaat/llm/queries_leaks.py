"""Problem 6: test items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.llm.leaks import leaked_passages
from veldspaat.sources.tables import table


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "toetsitems"), table(spark, folder, "documents"), item="item_id", item_text="tekst", doc="doc_id", text="text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a run of at least 13 words of an item."""
    return _passages(spark, folder).where("kind = 'exact'").select("item_id", "doc_id").distinct()


def p6_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Each passage found, exact or with words replaced."""
    return _passages(spark, folder)


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item the documents it stands in and its longest passage."""
    return _passages(spark, folder).where("kind = 'exact'").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


_FOUND = r"""
with stukken as (select item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as s
  from (select item_id, regexp_extract_all(lower(tekst), '[\p{L}\p{Nd}]+') as w from toetsitems)),
reeksen as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as s
  from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as w from documents))
select distinct item_id, doc_id from stukken join reeksen using (s)
"""

_ITEMS = r"""
with stukken as (select item_id, i, array_to_string(w[i:i + 12], ' ') as s from (select *, unnest(range(1, len(w) - 11)) as i
  from (select distinct item_id, regexp_extract_all(lower(tekst), '[\p{L}\p{Nd}]+') as w from toetsitems))),
reeksen as (select doc_id, j, array_to_string(w[j:j + 12], ' ') as s from (select *, unnest(range(1, len(w) - 11)) as j
  from (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as w from documents))),
raak as (select item_id, doc_id, j - i as schuif, i, i - row_number() over (partition by item_id, doc_id, j - i order by i) as loop from stukken join reeksen using (s)),
lopen as (select item_id, doc_id, count(*) + 12 as n from raak group by item_id, doc_id, schuif, loop)
select item_id, count(distinct doc_id) as n_docs, max(n)::int as longest from lopen group by item_id
"""

QUERIES = {"p6_found": p6_found, "p6_passages": p6_passages, "p6_items": p6_items}
SQL = {"p6_found": _FOUND, "p6_items": _ITEMS}
