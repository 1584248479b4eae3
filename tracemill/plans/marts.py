"""Report and dashboard tables over the facts and the usage snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.usage import error_rate, summary

RFC3339_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def kind_label(kind: Column) -> Column:
    return F.replace(kind, F.lit("_"), F.lit(" "))


def one_decimal(value: Column) -> Column:
    """A non-negative double with one decimal, rounded on its exact binary value.

    ``format_string`` rounds the shortest decimal spelling half up instead, which turns
    6.25 into 6.3 and 0.15 (stored a little below) into 0.2. The candidate tenth ``t`` is
    compared with the exact midpoint: 20 x = 16 x + 4 x, and neither product rounds.
    """
    t = F.floor(value * 10).cast("bigint")
    below_mid = (2 * t + 1).cast("double") - value * 16
    quarter = value * 4
    tenths = F.when(quarter > below_mid, t + 1).when(quarter < below_mid, t).otherwise(t + t % 2)
    whole = F.floor(tenths / 10).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), (tenths - whole * 10).cast("string"))


def error_cell(failures: Column, known: Column) -> Column:
    """``0``, or the failures with their share of the known outcomes."""
    percent = error_rate(failures, known)
    return (
        F.when(failures == 0, F.lit("0"))
        .when(percent.isNull(), failures.cast("string"))
        .otherwise(F.concat(failures.cast("string"), F.lit(" ("), one_decimal(percent), F.lit("%)")))
    )


def used_primitives(usage: DataFrame) -> DataFrame:
    """Catalog rows with activity: raw numbers next to their report spelling."""
    known = F.col("invocations") - F.col("unknown")
    return usage.where(F.col("invocations") > 0).select(
        "name",
        kind_label(F.col("kind")).alias("kind"),
        "harness",
        F.date_format("last_used", RFC3339_SECONDS).alias("last_used"),
        F.col("invocations").alias("calls"),
        "failures",
        error_rate(F.col("failures"), known).alias("error_percent"),
        error_cell(F.col("failures"), known).alias("errors"),
    )


def unused_primitives(usage: DataFrame) -> DataFrame:
    return usage.where(F.col("invocations") == 0).select("name", kind_label(F.col("kind")).alias("kind"), "harness")


def unused_overview(usage: DataFrame) -> DataFrame:
    """Unused rows per kind in alphabetical order, then the total; no rows when all are used."""
    counts = usage.where(F.col("invocations") == 0).rollup("kind").agg(
        F.grouping("kind").alias("is_total"), F.count(F.lit(1)).alias("unused")
    )
    label = kind_label(F.col("kind"))
    capital = F.concat(F.upper(F.substr(label, F.lit(1), F.lit(1))), F.substr(label, F.lit(2)))
    return (
        counts.where(F.col("unused") > 0)
        .select(
            "is_total",
            F.when(F.col("is_total") == 1, F.lit("Total unused")).otherwise(capital).alias("label"),
            "unused",
        )
        .orderBy("is_total", "label")
    )


def last_observed(records: DataFrame) -> DataFrame:
    return summary(records).select(
        F.coalesce(F.date_format("last_observed", RFC3339_SECONDS), F.lit("not observed")).alias("last_observed")
    )


def overview(records: DataFrame, usage: DataFrame) -> DataFrame:
    """The headline tiles: totals, rate text, what the rate leaves out, last activity."""
    totals = summary(records)
    listed = usage.agg(F.count(F.lit(1)).alias("listed"))
    # Two one-row aggregates become one row.
    both = totals.unionByName(listed, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in [*totals.columns, "listed"]]
    )
    rate = F.coalesce(
        F.concat(one_decimal(F.col("error_percent")), F.lit("%")), F.lit("not available")
    )
    detail = F.concat(
        F.col("failures").cast("string"), F.lit(" / "), F.col("known").cast("string"),
        F.lit(" known; "), F.col("unknown").cast("string"), F.lit(" excluded"),
    )
    return both.select(
        "invocations",
        "sessions",
        rate.alias("error_rate"),
        detail.alias("error_detail"),
        F.coalesce(F.date_format("last_observed", "MMM dd"), F.lit("-")).alias("last_observed"),
        F.coalesce(
            F.concat(F.lit("Last observed "), F.date_format("last_observed", "yyyy-MM-dd HH:mm")),
            F.lit("No activity observed yet"),
        ).alias("updated"),
        ((F.col("invocations") == 0) & (F.col("listed") == 0)).alias("is_empty"),
    )


def headline(records: DataFrame) -> DataFrame:
    """Two numbers: terminal invocations and distinct sessions."""
    return summary(records).select("invocations", "sessions")
