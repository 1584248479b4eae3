"""Validate records and remove copies of an event id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.domains import is_event_id, is_harness, is_name, is_repo, is_token, is_version
from tracemill.schemas import INVOKERS, KINDS, OUTCOMES, RECORD_VERSION, SOURCES

OPTIONAL_NAMES = ["package", "via_skill", "via_agent", "model", "effort"]
OPTIONAL_VERSIONS = ["harness_version", "package_version"]
# Columns that hold lower-case hexadecimal digits in every valid record.
DIGESTS = ["event_id", "repo"]


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _absent_or(name: str, condition: Column) -> Column:
    return F.col(name).isNull() | (F.col(name) == "") | condition


def invalid_reason() -> Column:
    """Why a record is refused, NULL for a valid one. The first failing rule names it."""
    required = (
        _holds(is_harness(F.col("harness")))
        & _holds(is_token(F.col("session_id")))
        & _holds(is_repo(F.col("repo")))
        & _holds(F.col("kind").isin(KINDS))
        & _holds(is_name(F.col("name")))
        & _holds(F.col("invoker").isin(INVOKERS))
    )
    optional = F.lit(True)
    for name in OPTIONAL_NAMES:
        optional = optional & _absent_or(name, is_name(F.col(name)))
    for name in OPTIONAL_VERSIONS:
        optional = optional & _absent_or(name, is_version(F.col(name)))
    zero = F.lit("0001-01-01T00:00:00Z").cast("timestamp")
    return (
        F.when(~_holds(F.col("schema_version") == RECORD_VERSION), F.lit("schema version"))
        .when(~_holds(is_event_id(F.col("event_id"))), F.lit("event id"))
        .when(F.col("ts").isNull() | (F.col("ts") == zero), F.lit("timestamp"))
        .when(~required, F.lit("required field"))
        .when(~optional, F.lit("optional field"))
        .when(F.col("source").isNotNull() & ~F.col("source").isin(SOURCES), F.lit("source"))
        .when(F.col("outcome").isNotNull() & ~F.col("outcome").isin(OUTCOMES), F.lit("outcome"))
        .when(F.col("duration_ms") < 0, F.lit("duration"))
    )


def validate(records: DataFrame) -> DataFrame:
    """Add ``invalid_reason``; filter on it to split valid rows from refused ones."""
    return records.withColumn("invalid_reason", invalid_reason())


def packed(records: DataFrame) -> DataFrame:
    """Valid records with their digests as bytes: half as wide, in the same order."""
    return records.withColumns({c: F.unhex(c) for c in DIGESTS if c in records.columns})


def unpacked(records: DataFrame) -> DataFrame:
    return records.withColumns({c: F.lower(F.hex(c)) for c in DIGESTS if c in records.columns})


def first_copies(records: DataFrame, order: list[str], stored_ids: DataFrame | None = None) -> DataFrame:
    """One record per event id, the first by ``order``; given ``stored_ids``, only of ids that are not among them.

    A combining minimum instead of a ranking window: an id with very many copies shrinks
    to one row per task before it is shuffled. Ties are broken by the record itself. Stored ids
    meet the records in the same shuffle.
    """
    rest = [c for c in records.columns if c != "event_id" and c not in order]
    copies = records.select("event_id", F.struct(*order, *rest).alias("kept"))
    if stored_ids is None:
        first = copies.groupBy("event_id").agg(F.min("kept").alias("kept"))
    else:
        known = stored_ids.select("event_id", F.lit(True).alias("known"))
        first = copies.unionByName(known, allowMissingColumns=True).groupBy("event_id").agg(
            F.min("kept").alias("kept"), F.max("known").alias("known")).where("known is null")
    return first.select("event_id", "kept.*").select(*records.columns)


def unseen(batch: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Records whose id is not stored yet.

    The stored side is cut down to the ids of the batch before the anti join, so the
    large side is read as one column and shrinks by a semi join first.
    """
    known = stored_ids.select("event_id").join(batch.select("event_id"), "event_id", "left_semi").distinct()
    return batch.join(known, "event_id", "left_anti")
