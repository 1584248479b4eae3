"""Skill runs that leave no tool call behind: collapse them and keep the uncovered ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = ["file", "session", "name"]


def collapse_candidates(candidates: DataFrame) -> DataFrame:
    """One row per (file, session, name): the earliest by (ts, event id), and how many more.

    ``candidates`` carries a ``record`` struct. Constant-size aggregate, combined before
    the shuffle.
    """
    return candidates.groupBy(*RUN).agg(
        F.min_by("record", F.struct("record.ts", "record.event_id")).alias("record"),
        (F.count(F.lit(1)) - 1).alias("extra"),
    )


def uncovered_runs(collapsed: DataFrame, invoked: DataFrame, closed: DataFrame) -> DataFrame:
    """Runs of closed sessions whose skill was never called as a tool in that session."""
    return collapsed.join(closed, ["file", "session"], "left_semi").join(
        invoked.select(*RUN).distinct(), RUN, "left_anti"
    )
