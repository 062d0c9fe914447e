"""Which references of a text are among the records that were really retrieved for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspaat.functions.citations import clause_keys, law_keys, masked, references, ruling_keys
from veldspaat.plans.joins import sized_join
from veldspaat.plans.shared import written


def key_table(laws: DataFrame | None = None, rulings: DataFrame | None = None, clauses: DataFrame | None = None, *, by: list[str] | None = None) -> DataFrame:
    """(*by, soort, verwijzing): distinct keys under which the given records can be cited.

    ``by`` names columns, such as a request, that the keys hold for; without it they hold for all texts. The name of the
    law and the product of a clause are not part of a key.
    """
    by = by or []
    parts = [
        df.select(*by, F.lit(kind).alias("soort"), F.explode(keys).alias("verwijzing"))
        for df, kind, keys in (
            (laws, "wetsartikel", law_keys(F.col("artikel"))),
            (rulings, "kifid", ruling_keys(F.col("uitspraaknummer"))),
            (clauses, "polisclausule", clause_keys(F.col("clausule_id"))),
        )
        if df is not None
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def cited(texts: DataFrame, *, item: str, text: Column, by: list[str] | None = None) -> DataFrame:
    """(item, *by, soort, verwijzing, positie): each reference of each text once, at its first place."""
    by = by or []
    found = texts.select(item, *by, F.inline(references(text)))
    return found.groupBy(item, *by, "soort", "verwijzing").agg(F.min("positie").alias("positie"))


def checked(references: DataFrame, keys: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """``references`` with column gefundeerd. References without a colon count as articles only if they are grounded."""
    on = [*(by or []), "soort", "verwijzing"]
    joined = sized_join(references, written(keys.withColumn("_known", F.lit(True)), "keys"), on, "left")
    grounded = F.coalesce("_known", F.lit(False))
    silent = (F.col("soort") == "wetsartikel") & ~F.contains("verwijzing", F.lit(":")) & ~grounded
    return joined.where(~silent).withColumn("gefundeerd", grounded).drop("_known")


def judged(texts: DataFrame, checks: DataFrame, *, item: str) -> DataFrame:
    """(item, oordeel, n_gefundeerd, n_ongefundeerd) of every text: any ungrounded reference decides."""
    counts = checks.groupBy(item).agg(F.count_if("gefundeerd").alias("n_gefundeerd"), F.count_if(~F.col("gefundeerd")).alias("n_ongefundeerd"))
    verdict = F.when(F.col("n_ongefundeerd") > 0, "ONGEFUNDEERD").when(F.col("n_gefundeerd") > 0, "GEFUNDEERD").otherwise("GEEN_VERWIJZINGEN")
    filled = texts.select(item).join(counts, item, "left").fillna(0, ["n_gefundeerd", "n_ongefundeerd"])
    return filled.select(item, verdict.alias("oordeel"), "n_gefundeerd", "n_ongefundeerd")


def marked(texts: DataFrame, checks: DataFrame, *, item: str, text: str) -> DataFrame:
    """(item, text, gemaskeerd): every text, with its ungrounded references marked; unchanged if there are none.

    The references gathered per text are at most as many as the text has.
    """
    wrong = checks.where(~F.col("gefundeerd")).groupBy(item).agg(F.collect_list(F.struct("soort", "verwijzing", "positie")).alias("_wrong"))
    out = F.when(F.col("_wrong").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("_wrong")))
    return texts.select(item, text).join(wrong, item, "left").select(item, text, out.alias("gemaskeerd"))
