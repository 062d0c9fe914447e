"""The source gate: three-valued verification, and what it lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(verified: Column) -> Column:
    """Everything but an explicit False: unknown passes. Written so that it is pushed down to the scan."""
    return ~verified.eqNullSafe(F.lit(False))


def audited(verified: Column, finding: Column) -> Column:
    """Verification with an audit finding on top: any finding makes it False, whatever the source check said."""
    return F.when(F.coalesce(finding, F.lit("")) != "", F.lit(False)).otherwise(verified)


def redirect_verified(status: Column, location: Column, anchor: Column) -> Column:
    """True if a redirect leads to the anchor, False if it leads elsewhere, null if nothing was reached."""
    return F.when(status.isNull(), F.lit(None).cast("boolean")).otherwise(status.isin(301, 302) & F.coalesce(F.endswith(location, F.concat(F.lit("#"), anchor)), F.lit(False)))


def gate_status(records: DataFrame, *, verified: Column, names: list[Column], most: int = 10) -> DataFrame:
    """One row (records, usable, refused, refused_ids): the first ``most`` refused ids in order.

    An id is the first of ``names`` that isn't empty. The ids are cut to ``most`` before they are gathered.
    """
    named = records.select(usable(verified).alias("_ok"), F.coalesce(*[F.nullif(n.cast("string"), F.lit("")) for n in names]).alias("_id"))
    counts = named.agg(F.count("*").alias("records"), F.count_if("_ok").alias("usable"), F.count_if(~F.col("_ok")).alias("refused"))
    first = named.where("not _ok and _id is not null").select("_id").orderBy("_id").limit(most)
    ids = first.agg(F.array_join(F.array_sort(F.collect_list("_id")), ",").alias("refused_ids"))
    return counts.withColumn("_one", F.lit(1)).join(ids.withColumn("_one", F.lit(1)), "_one").drop("_one")


def print_check(address: Column, status: Column, magic: Column, text: Column, number: Column, audit: Column) -> Column:
    """struct(verified, note) of a record against the print it names, from what was landed of it.

    An audit finding or a missing address decides first; then the print must be there, be a PDF by its first bytes, and
    have the record's number in its first pages.
    """

    def state(ok: bool, note: Column | str) -> Column:
        return F.struct(F.lit(ok).alias("verified"), (F.lit(note) if isinstance(note, str) else note).alias("note"))

    return (
        F.when(F.coalesce(audit, F.lit("")) != "", state(False, F.concat(F.lit("audit: "), audit)))
        .when(F.coalesce(address, F.lit("")) == "", state(False, "no address"))
        .when(status.isNull() | (status != 200) | ~F.startswith(F.coalesce(magic, F.lit("")), F.lit("%PDF")), state(False, F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("-")), F.lit(", no PDF"))))
        .when(F.contains(F.coalesce(text, F.lit("")), F.nullif(number, F.lit(""))), state(True, "number read back from the print"))
        .otherwise(state(False, "number not in the print"))
    )
