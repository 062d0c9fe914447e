"""The events by which answers are sent: sources first, then text bit by bit, the check, the marked text, the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspaat.functions.text import chunks

REFUSAL = "Ik kan dit niet beantwoorden: er zijn geen bronnen gevonden die de vraag dragen."
REFUSED = "GEWEIGERD_GEEN_BRONNEN"


def answer_events(answers: DataFrame, verdicts: DataFrame, *, item: str, width: int = 24) -> DataFrame:
    """(item, phase, place, event, data) of answers (item, answer, error, sources, masked) and verdicts (item, oordeel).

    Phases in order: 0 'bronnen', the sources as a JSON array; 1 'tekst', the answer in pieces of ``width``; 2 'fout', an
    error on the way, after what was already said; 3 'controle', the verdict; 4 'gemaskeerd', the answer with its
    ungrounded references marked, if it has any; 5 'einde'. An answer without sources is not sent: a refusal and the verdict
    GEWEIGERD_GEEN_BRONNEN stand in its place, with no error and nothing marked. Null answers are empty, null sources none.
    """
    rows = answers.join(verdicts.select(item, "oordeel"), item, "left").select(
        item,
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        "error",
        "masked",
        "oordeel",
    )
    refused = F.size("sources") == 0
    text = F.when(refused, F.array(F.lit(REFUSAL))).otherwise(chunks(F.col("answer"), width))

    def one(phase: int, event: str, data, when=None):
        event = F.struct(F.lit(phase).alias("phase"), F.lit(0).alias("place"), F.lit(event).alias("event"), data.cast("string").alias("data"))
        return F.array(event) if when is None else F.when(when, F.array(event)).otherwise(F.array().cast("array<struct<phase:int,place:int,event:string,data:string>>"))

    said = F.transform(text, lambda t, i: F.struct(F.lit(1).alias("phase"), i.cast("int").alias("place"), F.lit("tekst").alias("event"), t.alias("data")))
    events = F.concat(
        one(0, "bronnen", F.to_json("sources")),
        said,
        one(2, "fout", F.col("error"), ~refused & F.col("error").isNotNull()),
        one(3, "controle", F.when(refused, F.lit(REFUSED)).otherwise(F.col("oordeel"))),
        one(4, "gemaskeerd", F.col("masked"), ~refused & F.coalesce(F.col("masked") != F.col("answer"), F.lit(False))),
        one(5, "einde", F.lit("[DONE]")),
    )
    return rows.select(item, F.inline(events))
