"""Drawing a training mixture from sources to target weights."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.plans.joins import matched
from veldspaat.plans.shared import written

#: A public byte-level BPE vocabulary as ranks; the same path must exist on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's texts are split before merging. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern means it, in runs too long for the tokenizer's pattern matcher. Fixed values.
_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


@lru_cache(maxsize=2)
def _encodings(path: str):
    """The tokenizer, and the same for a text that is one piece."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return [tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, r"(?s).+")]


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text of any length, exactly as the vocabulary's pattern splits it.

    Only a run of 10,000 or more white-space characters is handled apart, since the pattern matcher can't backtrack over
    it: the pattern takes such a run as one piece, without its last character if text follows.
    """
    whole, piece = _encodings(path)
    total = start = 0
    for run in _BLANK.finditer(text):
        stop = run.end() - (run.end() < len(text))
        total += len(whole.encode_ordinary(text[start : run.start()])) + len(piece.encode_ordinary(text[run.start() : stop]))
        start = stop
    return total + len(whole.encode_ordinary(text[start:]))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [0 if t is None else count_tokens(t, path) for t in batch.column("_text").to_pylist()]
            rest = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(counts, pa.int64())], names=[*rest.schema.names, "tokens"])

    return run


def token_counts(records: DataFrame, *, ids: list[str], text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """(*ids, tokens): tokens of each text under a public tokenizer; a null or empty text has 0."""
    base = records.select(*ids, text.alias("_text"))
    schema = T.StructType([*base.drop("_text").schema, T.StructField("tokens", T.LongType())])
    return base.mapInArrow(_count(tokenizer), schema)


def _uniform(seed: int, *values: str) -> Column:
    """A number in [0, 1) from the hash of the values and the seed: the upper 53 bits, all that a double holds."""
    hashed = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def mixture(
    documents: DataFrame, recipes: DataFrame, *, doc: str, source: str, text: str, recipe: str, weight: str, repeats: str, budget: str, tokenizer: str = TOKENIZER, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Mixtures drawn from ``documents`` by ``recipes``: (uses, shares).

    uses is (recipe, doc, source, tokens, uses), the documents chosen at least once. shares is (recipe, source,
    wanted_share, wanted_tokens, source_tokens, rate, max_uses, actual_tokens, actual_share), a row per row of the recipe.

    The wanted size is ``budget`` times the tokens of all documents; wanted_share is the weight over the sum of the
    recipe's weights (null and negative weights count as 0). A source's rate is wanted over available tokens, at most its
    cap; each document is used floor(rate) times, and once more if the hash of recipe, document and seed falls below the
    fraction, so a draw is the same in any order and on any cluster. What a capped, small or missing source lacks isn't
    made up by others: actual_share, over the tokens really drawn, tells. A null cap means once, a cap below 0 means 0.
    Sources without a row, documents without a source and empty documents are not drawn, but count in the total. A source
    named twice in a recipe counts once, with its weights added and its caps' maximum. Empty tables give no uses.

    Texts are tokenized once, where they are read; only one row per document and task-wise sums are left after that.
    """
    counted = written(token_counts(documents.where(F.col(doc).isNotNull()), ids=[doc, source], text=F.col(text), tokenizer=tokenizer), "mixture-tokens")
    available = counted.groupBy(F.col(source).alias("source")).agg(F.sum("tokens").alias("source_tokens"))
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]

    rows = recipes.where(F.col(source).isNotNull()).groupBy(F.col(recipe).alias("recipe"), F.col(source).alias("source"))
    rows = rows.agg(
        F.sum(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce(repeats, F.lit(1)), F.lit(0))).alias("max_uses"),
        F.max(F.coalesce(budget, F.lit(0.0))).alias("budget"),
    )
    sums = rows.groupBy("recipe").agg(F.sum("weight").alias("_sum"), F.max("budget").alias("_budget"))
    rows = rows.drop("budget").join(sums.withColumnRenamed("recipe", "_recipe"), F.col("recipe").eqNullSafe(F.col("_recipe")))
    share = F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum")).otherwise(F.lit(0.0))
    plan = rows.join(available, "source", "left").select("recipe", "source", share.alias("wanted_share"), (share * F.col("_budget") * F.lit(float(total))).alias("wanted_tokens"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"), "max_uses")
    rate = F.when(F.col("source_tokens") > 0, F.least(F.col("wanted_tokens") / F.col("source_tokens"), F.col("max_uses").cast("double"))).otherwise(F.lit(0.0))
    plan = written(plan.withColumn("rate", rate), "mixture-plan")

    rates = plan.where("rate > 0").select("recipe", "source", "rate")
    drawn = matched(counted.where("tokens > 0").withColumnRenamed(source, "source"), rates, ["source"], doc, "recipe")
    extra = F.when(_uniform(seed, "recipe", doc) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    uses = written(drawn.select("recipe", doc, "source", "tokens", (F.floor("rate") + extra).cast("int").alias("uses")).where("uses > 0"), "mixture-uses")

    got = uses.groupBy("recipe", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("actual_tokens"))
    got = got.withColumnRenamed("recipe", "_recipe").withColumnRenamed("source", "_source")
    both = plan.join(got, F.col("recipe").eqNullSafe(F.col("_recipe")) & (F.col("source") == F.col("_source")), "left").drop("_recipe", "_source")
    both = both.withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    sums = both.groupBy(F.col("recipe").alias("_recipe")).agg(F.sum("actual_tokens").alias("_sum"))
    both = both.join(sums, F.col("recipe").eqNullSafe(F.col("_recipe")))
    actual = F.when(F.col("_sum") > 0, F.col("actual_tokens") / F.col("_sum")).otherwise(F.lit(0.0))
    shares = both.select("recipe", "source", "wanted_share", "wanted_tokens", "source_tokens", "rate", "max_uses", "actual_tokens", actual.alias("actual_share"))
    return uses, shares
