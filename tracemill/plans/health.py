"""Scan counters, and the one word they add up to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.published import read_if_present
from tracemill.schemas import COUNTER_NAMES, COUNTERS_VERSION, HOOK_COUNTERS, HOOK_NAMES, SCAN_COUNTERS


class InvalidCounters(ValueError):
    """The counter table holds a version this code does not read."""


class ScanHealth:
    """One appended row per scan and per set-up change; the latest row is current.

    Appending replaces the scan half and the set-up half independently, without a lock.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def record_scan(self, counters: DataFrame, at: datetime) -> None:
        self._append(counters, "scans", at, COUNTER_NAMES)

    def record_hooks(self, counters: DataFrame, at: datetime) -> None:
        self._append(counters, "hooks", at, HOOK_NAMES)

    def _append(self, counters: DataFrame, half: str, at: datetime, names: list[str]) -> None:
        counters.select(
            F.lit(COUNTERS_VERSION).alias("version"),
            F.lit(at).cast("timestamp").alias("at"),
            *[F.col(n).cast("bigint").alias(n) for n in names],
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/{half}")

    def current(self) -> DataFrame:
        """One row: the latest scan; no scan yet is all zeros and no instant."""
        return latest_scan(self._checked("scans", SCAN_COUNTERS))

    def hooks(self) -> DataFrame:
        rows = self._checked("hooks", HOOK_COUNTERS)
        return rows.agg(
            F.max("at").alias("at"),
            *[F.coalesce(F.max_by(n, "at"), F.lit(0)).alias(n) for n in HOOK_NAMES],
        )

    def _checked(self, half: str, schema) -> DataFrame:
        rows = read_if_present(self.spark, f"{self.root}/{half}", schema)
        foreign = rows.where(~F.coalesce(F.col("version") == COUNTERS_VERSION, F.lit(False)))
        if not foreign.isEmpty():
            raise InvalidCounters("unknown counter version")
        return rows

    def diagnose(self, hooks_readable: bool = True) -> DataFrame:
        """(state, scan_at, counters...): unreadable counters are a state, not a failure."""
        try:
            scan, readable = self.current(), True
        except InvalidCounters:
            scan, readable = latest_scan(self.spark.createDataFrame([], SCAN_COUNTERS)), False
        state = integration_state(F.lit(readable), F.lit(hooks_readable))
        return scan.select(state.alias("state"), F.col("at").alias("scan_at"), *COUNTER_NAMES)


def latest_scan(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.max("at").alias("at"), *[F.coalesce(F.max_by(n, "at"), F.lit(0)).alias(n) for n in COUNTER_NAMES]
    )


def integration_state(counters_readable: Column, hooks_readable: Column) -> Column:
    """The first rule that applies names the state.

    Pending, interrupted, ambiguous and skipped never take part: they are ordinary.
    """
    losses = (
        (F.col("unreadable") > 0)
        | (F.col("parse_errors") > 0)
        | (F.col("refused_projects") > 0)
        | (F.col("refused_calls") > 0)
    )
    return (
        F.when(~counters_readable, F.lit("counters unreadable"))
        .when(~hooks_readable, F.lit("hooks unreadable"))
        .when(F.col("at").isNull(), F.lit("never scanned"))
        .when(losses, F.lit("collects nothing"))
        .when(F.col("events_written") == 0, F.lit("collects zero"))
        .otherwise(F.lit("collecting"))
    )
