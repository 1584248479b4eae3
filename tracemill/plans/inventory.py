"""The catalog of discoverable primitives and its usage snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.domains import derived_name, is_harness, is_name
from tracemill.operators.usage import PRIMITIVE_KEY, usage_by_primitive
from tracemill.plans.published import PublishedTable
from tracemill.schemas import DEFAULT_HARNESS, SNAPSHOT_KINDS, SNAPSHOT_VERSION, USAGE_SNAPSHOT

PRIMITIVES = "harness string, kind string, name string"


def catalog(found: list[DataFrame], name_key: bytes | None, harness: str = DEFAULT_HARNESS) -> DataFrame:
    """Union of all discovered (kind, name) rows, names derived, refused ones left out."""
    union = found[0].select("kind", "name")
    for more in found[1:]:
        union = union.unionByName(more.select("kind", "name"))
    # Repeats collapse before the digests are computed, and names that coincide after.
    named = union.distinct().select(
        F.lit(harness).alias("harness"), "kind", derived_name(F.col("name"), name_key).alias("name")
    )
    return named.where(F.col("name").isNotNull()).distinct()


def order_catalog(primitives: DataFrame) -> DataFrame:
    return primitives.orderBy(F.concat_ws(":", "kind", "name"), "harness")


def carry_forward(discovered: DataFrame, scanned: bool, previous: DataFrame) -> DataFrame:
    """A pass that saw no project keeps the names of the last snapshot; one that did replaces them.

    Only names are carried: their counters are derived again from the facts.
    """
    if scanned:
        return discovered.select(*PRIMITIVE_KEY)
    return discovered.select(*PRIMITIVE_KEY).unionByName(previous.select(*PRIMITIVE_KEY)).distinct()


def valid_usage() -> Column:
    shape = is_harness(F.col("harness")) & is_name(F.col("name")) & F.col("kind").isin(SNAPSHOT_KINDS)
    counts = (
        (F.least("invocations", "failures", "unknown") >= 0)
        & (F.col("unknown") <= F.col("invocations"))
        & (F.col("failures") <= F.col("invocations") - F.col("unknown"))
    )
    dated = (F.col("invocations") == 0) == F.col("last_used").isNull()
    return F.coalesce(shape & counts & dated, F.lit(False))


def catalog_usage(primitives: DataFrame, usage: DataFrame) -> DataFrame:
    """Every catalog row with its counters, zero when never used; ``usage`` has one row per primitive.

    Usage of a name outside the catalog is not listed. Kinds must match as they are:
    a catalog ``mcp_server`` is a different primitive from the ``mcp_tool`` calls below it.

    Both sides meet in one combining aggregate: a catalog may be far larger than the files that announce it look, so
    a join would send it to the driver as a small table.
    """
    counters = ["invocations", "failures", "unknown"]
    listed = primitives.select(*PRIMITIVE_KEY).where(F.col("kind") != "builtin_tool").select(
        *PRIMITIVE_KEY, F.lit(True).alias("listed"))
    both = listed.unionByName(usage.select(*PRIMITIVE_KEY, *counters, "last_used"), allowMissingColumns=True)
    joined = both.groupBy(*PRIMITIVE_KEY).agg(
        F.max("listed").alias("listed"), *[F.sum(c).alias(c) for c in counters], F.max("last_used").alias("last_used"),
    ).where("listed").select(
        *PRIMITIVE_KEY, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counters], "last_used")
    return joined.where(valid_usage())


def mcp_servers_of_tools(usage: DataFrame) -> DataFrame:
    """Optional roll-up: count ``mcp__<server>__<tool>`` calls as use of the server <server>."""
    server = F.split_part(F.col("name"), F.lit("__"), F.lit(2))
    kind = F.when(F.col("kind") == "mcp_tool", F.lit("mcp_server")).otherwise(F.col("kind"))
    name = F.when(F.col("kind") == "mcp_tool", server).otherwise(F.col("name"))
    return usage.select("harness", kind.alias("kind"), name.alias("name"), "invocations", "failures",
                        "unknown", "last_used").groupBy(*PRIMITIVE_KEY).agg(
        F.sum("invocations").alias("invocations"), F.sum("failures").alias("failures"),
        F.sum("unknown").alias("unknown"), F.max("last_used").alias("last_used"))


def order_snapshot(usage: DataFrame) -> DataFrame:
    return usage.orderBy(F.desc("invocations"), "harness", "kind", "name")


class InvalidSnapshot(ValueError):
    """A snapshot with a wrong version, no date or any invalid row."""


def check_snapshot(rows: DataFrame) -> DataFrame:
    """One row: may this snapshot be used? Any bad row spoils all of it; no rows are fine."""
    sound = (F.col("version") == SNAPSHOT_VERSION) & F.col("refreshed_at").isNotNull() & valid_usage()
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(sound, F.lit(False))), F.lit(True)).alias("usable"))


class UsageSnapshots:
    """The published catalog usage; each refresh replaces the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = PublishedTable(spark, root, USAGE_SNAPSHOT)

    def read(self) -> DataFrame:
        """The current snapshot, or an error when any part of it cannot be trusted."""
        rows = self.table.read()
        if not check_snapshot(rows).first()[0]:
            raise InvalidSnapshot("invalid usage snapshot")
        return rows

    def previous_names(self) -> DataFrame:
        """Names to carry forward; none when the last snapshot is not usable."""
        try:
            return self.read().select(*PRIMITIVE_KEY)
        except InvalidSnapshot:
            return self.table.read().where(F.lit(False)).select(*PRIMITIVE_KEY)

    def refresh(self, records: DataFrame, discovered: DataFrame, scanned: bool) -> int:
        """Join the catalog with its usage and publish the result as the new version."""
        names = carry_forward(discovered, scanned, self.previous_names())
        usage = catalog_usage(names, usage_by_primitive(records))
        return self.publish(usage)

    def publish(self, usage: DataFrame) -> int:
        stamped = usage.select(
            F.lit(SNAPSHOT_VERSION).alias("version"),
            F.current_timestamp().alias("refreshed_at"),
            *PRIMITIVE_KEY, "invocations", "failures", "unknown", "last_used",
        )
        return self.table.publish(stamped)
