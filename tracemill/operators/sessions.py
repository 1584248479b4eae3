"""Session activity inside a file, the closing rule, and what depends on it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ["file", "session"]


@dataclass(frozen=True)
class Staleness:
    """One threshold and one clock reading per run; without either nothing ever closes."""

    timeout: timedelta | None = None
    now: datetime | None = None

    @property
    def enabled(self) -> bool:
        return self.timeout is not None and self.timeout > timedelta(0) and self.now is not None

    def closes(self, last_activity: Column) -> Column:
        """True when the silence since ``last_activity`` is strictly longer than the timeout."""
        if not self.enabled:
            return F.lit(False)
        micros = self.timeout // timedelta(microseconds=1)
        return F.unix_micros(F.lit(self.now)) - F.unix_micros(last_activity) > micros


def session_activity(entries: DataFrame) -> DataFrame:
    """Last activity per (file, session) over every line that names a session and an instant."""
    return (
        entries.where(F.col("seen_session").isNotNull() & F.col("seen_ts").isNotNull())
        .groupBy("file", F.col("seen_session").alias("session"))
        .agg(F.max("seen_ts").alias("last_activity"))
    )


def blind_files(entries: DataFrame) -> DataFrame:
    """Files with a line that may have hidden the end of a call."""
    return entries.where("blind").select("file").distinct()


def closed_sessions(activity: DataFrame, blind: DataFrame, staleness: Staleness) -> DataFrame:
    """(file, session) pairs that went quiet; one blind line keeps a whole file open."""
    quiet = activity.where(staleness.closes(F.col("last_activity")))
    return quiet.join(blind, "file", "left_anti").select(*SESSION)


def with_closed_flag(open_calls: DataFrame, closed: DataFrame) -> DataFrame:
    """Open calls with ``is_closed``: those of closed sessions end as interrupted at their own instant."""
    marked = closed.select(*SESSION, F.lit(True).alias("is_closed"))
    return open_calls.join(marked, SESSION, "left").withColumn("is_closed", F.coalesce("is_closed", F.lit(False)))


def with_line_offsets(lines: DataFrame) -> DataFrame:
    """Add the byte offset of each line: a running sum of ``nbytes`` in file order.

    Two levels keep every sort bounded by one input split: lines are summed inside their
    chunk, and the (few) chunk totals of a file give each chunk its base. Select narrow
    columns first; the rows are shuffled once.
    """
    order = Window.partitionBy("file", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        lines.groupBy("file", "chunk")
        .agg(F.sum("nbytes").alias("chunk_bytes"))
        .select("file", "chunk", F.coalesce(F.sum("chunk_bytes").over(chunks), F.lit(0)).alias("base"))
    )
    inside = lines.withColumn("within", F.coalesce(F.sum("nbytes").over(order), F.lit(0)))
    return (
        inside.join(bases, ["file", "chunk"])
        .withColumn("offset", F.col("base") + F.col("within"))
        .drop("base", "within")
    )


def first_offsets(entries: DataFrame) -> DataFrame:
    """Activity with the byte offset of the first line of each (file, session)."""
    narrow = entries.select(
        "file", "chunk", "line", "nbytes", "seen_session", "seen_ts",
        *(["offset"] if "offset" in entries.columns else []),
    )
    placed = narrow if "offset" in entries.columns else with_line_offsets(narrow)
    return (
        placed.where(F.col("seen_session").isNotNull() & F.col("seen_ts").isNotNull())
        .groupBy("file", F.col("seen_session").alias("session"))
        .agg(F.max("seen_ts").alias("last_activity"), F.min("offset").alias("first_offset"))
    )


def cursor_floor(
    files: DataFrame, activity: DataFrame, blind: DataFrame, staleness: Staleness
) -> DataFrame:
    """Per file: open sessions and the smallest first offset among them (0 when none is open).

    ``activity`` comes from :func:`first_offsets`. A source must be kept from that offset on.
    """
    closed = closed_sessions(activity, blind, staleness)
    still_open = activity.join(closed, SESSION, "left_anti")
    per_file = still_open.groupBy("file").agg(
        F.count(F.lit(1)).alias("open_sessions"), F.min("first_offset").alias("cursor_floor")
    )
    return files.select("file").join(per_file, "file", "left").select(
        "file",
        F.coalesce("open_sessions", F.lit(0)).cast("bigint").alias("open_sessions"),
        F.coalesce("cursor_floor", F.lit(0)).cast("bigint").alias("cursor_floor"),
    )
