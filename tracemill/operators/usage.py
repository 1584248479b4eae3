"""Aggregates over the fact table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.classify import is_counted, is_failure

PROVENANCE_KEY = ["name", "kind", "harness", "invoker", "via_agent"]
PRIMITIVE_KEY = ["harness", "kind", "name"]


def counted(records: DataFrame, since: datetime | None = None) -> DataFrame:
    """Records the aggregates see. ``since`` (not part of the original reports) limits to recent use."""
    rows = records.where(is_counted(F.col("kind")))
    return rows if since is None else rows.where(F.col("ts") >= F.lit(since))


def error_rate(failures: Column, known: Column) -> Column:
    """Failures per known outcome in percent; NULL when nothing is known."""
    return F.try_divide(failures, known) * 100


def _counts() -> list[Column]:
    outcome = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("invocations"),
        F.count(outcome).alias("known"),
        F.count_if(outcome.isNull()).alias("unknown"),
        F.count_if(is_failure(outcome)).alias("failures"),
    ]


def summary(records: DataFrame, since: datetime | None = None) -> DataFrame:
    """One row, also for no records: totals, exact distinct sessions, rate over known outcomes."""
    return (
        counted(records, since)
        .agg(*_counts(), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last_observed"))
        .withColumn("error_percent", error_rate(F.col("failures"), F.col("known")))
    )


def outcome_histogram(records: DataFrame, since: datetime | None = None) -> DataFrame:
    known = counted(records, since).where(F.col("outcome").isNotNull())
    return known.groupBy("outcome").agg(F.count(F.lit(1)).alias("invocations"))


def usage_by_provenance(records: DataFrame, since: datetime | None = None) -> DataFrame:
    """Usage per (name, kind, harness, invoker, via_agent); no via_agent and an empty one are one key.

    Distinct sessions are exact. Spark first reduces to one row per key and session, which
    also spreads a key that dominates the table over all its sessions.
    """
    rows = counted(records, since).withColumn("via_agent", F.coalesce("via_agent", F.lit("")))
    return (
        rows.groupBy(*PROVENANCE_KEY)
        .agg(*_counts(), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last_used"))
        .withColumn("error_percent", error_rate(F.col("failures"), F.col("known")))
    )


def order_usage(usage: DataFrame) -> DataFrame:
    """Most used first; kind closes the key so the order is total."""
    return usage.orderBy(F.desc("invocations"), "harness", "name", "invoker", "via_agent", "kind")


def usage_by_primitive(records: DataFrame, since: datetime | None = None) -> DataFrame:
    """Usage per (harness, kind, name), straight from the facts (sessions do not add up)."""
    return counted(records, since).groupBy(*PRIMITIVE_KEY).agg(
        F.count(F.lit(1)).alias("invocations"),
        F.count_if(is_failure(F.col("outcome"))).alias("failures"),
        F.count_if(F.col("outcome").isNull()).alias("unknown"),
        F.max("ts").alias("last_used"),
    )


def ratio(numerator: str, denominator: str, excluded: str, total: str) -> Column:
    """A rate that keeps the population it leaves out; all four counts travel together."""
    return F.struct(
        F.col(numerator).alias("numerator"),
        F.col(denominator).alias("denominator"),
        F.col(excluded).alias("excluded"),
        F.col(total).alias("total"),
    )


def ratio_percent(value: Column) -> Column:
    return error_rate(value["numerator"], value["denominator"])


def ratio_holds(value: Column) -> Column:
    """The invariant every ratio satisfies."""
    return (value["numerator"] <= value["denominator"]) & (
        value["denominator"] + value["excluded"] <= value["total"]
    )
