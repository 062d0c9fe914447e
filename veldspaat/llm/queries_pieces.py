"""Problem 4: articles, summaries and clauses over the size limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.llm.pieces import LIMIT, OVERLAP, split_texts
from veldspaat.sources.tables import table

FIELDS = {"wetgeving": "tekst", "kifid": "samenvatting", "polisvoorwaarden": "tekst"}


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit(t).alias("bron"), "rij_id", F.col(f).alias("tekst")).where(F.length("tekst") > LIMIT) for t, f in FIELDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["bron", "rij_id"])


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every text over the limit."""
    return split_texts(_texts(spark, folder), ids=["bron", "rij_id"], text=F.col("tekst"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts over the limit, and whether natural boundaries suffice to cut them."""
    first = p4_pieces(spark, folder).where("piece = 1")
    return first.select("bron", "rij_id", F.when(F.col("longest_stretch") > LIMIT, "ondeelbaar").otherwise("deelbaar").alias("soort"))


def p4_controle(spark: SparkSession, folder: str) -> DataFrame:
    """Every text over the limit put together again from its pieces: its digest, its longest piece, and whether all overlaps are as wanted."""
    pieces = p4_pieces(spark, folder).select("bron", "rij_id", "piece", "start", "stop", "text")
    parts = pieces.groupBy("bron", "rij_id").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "stop", "text"))).alias("p"), F.max(F.length("text")).alias("langste"))
    whole = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substr(x["text"], F.lit(OVERLAP + 1)))), "")
    laps = F.forall(F.transform("p", lambda x, i: (i == 0) | ((F.get("p", i - 1)["stop"] - x["start"] == OVERLAP) & (F.right(F.get("p", i - 1)["text"], F.lit(OVERLAP)) == F.left(x["text"], F.lit(OVERLAP))))), lambda ok: F.coalesce(ok, F.lit(False)))
    return parts.select("bron", "rij_id", F.md5(whole).alias("geheel"), (F.col("langste") <= LIMIT).alias("past"), laps.alias("overlapt"))


_SPACE = "\\x{09}-\\x{0D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_FOUND = " union ".join(
    f"""
select '{t}' as bron, rij_id, case when list_max(list_transform(regexp_split_to_array(regexp_replace({f}, '([.!?;])[{_SPACE}]', '\\1' || chr(10), 'g'),
  '[\\r\\n]'), lambda x: length(x))) > {LIMIT} then 'ondeelbaar' else 'deelbaar' end as soort from {t} where length({f}) > {LIMIT}"""
    for t, f in FIELDS.items()
)

_CHECKED = " union ".join(f"select '{t}' as bron, rij_id, md5({f}) as geheel, true as past, true as overlapt from {t} where length({f}) > {LIMIT}" for t, f in FIELDS.items())

QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_controle": p4_controle}
SQL = {"p4_found": _FOUND, "p4_controle": _CHECKED}
