"""Deriving records piece by piece: what earlier lines of a file leave for later ones.

The state of a file is small and closed under merging: calls that wait and results that came early, activity and first
offset per session, whether a line was blind, the earliest skill run per session and name, and the skills called as
tools. One step merges the state with the entries of new lines, gives the records that have become final, and the
state for the next step. The lines themselves are not needed again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracemill.operators.calls import acting_entries, addressable, project_calls, project_results, skill_candidates
from tracemill.operators.consent import attach_consent, resolve_directories
from tracemill.operators.pairing import KEYS, USE, call_events, carry_calls
from tracemill.operators.sessions import (
    SESSION,
    Staleness,
    blind_files,
    closed_sessions,
    cursor_floor,
    first_offsets,
    with_closed_flag,
)
from tracemill.operators.skills import RUN, collapse_candidates, uncovered_runs
from tracemill.plans.derive import DeriveOptions, finished_records
from tracemill.session import lazy

CALL, ACTIVE, BLIND, SKILL, INVOKED = "call", "session", "blind", "run", "invoked"


@dataclass(frozen=True)
class CarriedState:
    """The parts of the state; every member is a DataFrame keyed by file."""

    calls: DataFrame
    sessions: DataFrame
    blind: DataFrame
    runs: DataFrame
    invoked: DataFrame

    def packed(self) -> DataFrame:
        """All parts as one table, told apart by ``kind``."""
        parts = [(CALL, self.calls), (ACTIVE, self.sessions), (BLIND, self.blind), (SKILL, self.runs), (INVOKED, self.invoked)]
        out = None
        for kind, part in parts:
            part = part.withColumn("kind", F.lit(kind))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    @staticmethod
    def unpacked(rows: DataFrame) -> CarriedState:
        def part(kind: str, *columns: str) -> DataFrame:
            return rows.where(F.col("kind") == kind).select(*columns)

        return CarriedState(
            part(CALL, *KEYS, "pos", "tag", "call", "result"),
            part(ACTIVE, *SESSION, "last_activity", "first_offset"),
            part(BLIND, "file"),
            part(SKILL, *RUN, "record", "extra", "done"),
            part(INVOKED, *RUN),
        )

    def cursors(self, staleness: Staleness) -> DataFrame:
        """Per file: open sessions and the offset its lines must be kept from."""
        files = self.sessions.select("file").unionByName(self.blind).unionByName(self.calls.select("file")).distinct()
        return cursor_floor(files, self.sessions, self.blind, staleness)


def state_schema(spark: SparkSession, entries: StructType, options: DeriveOptions, consent: DataFrame) -> StructType:
    """The columns of a packed state."""
    none = spark.createDataFrame([], entries)
    acting = attach_consent(acting_entries(none), resolve_directories(none.select("cwd"), consent, options.salt), options.scope)
    calls = call_events(addressable(project_calls(acting, options.name_key, options.harness)), addressable(project_results(none)))
    runs = collapse_candidates(skill_candidates(acting, options.name_key, options.harness)).withColumn("done", F.lit(None).cast("string"))
    return CarriedState(calls, first_offsets(none), blind_files(none), runs, runs.select(*RUN)).packed().schema


def advance(
    entries: DataFrame,
    state: CarriedState,
    consent: DataFrame,
    options: DeriveOptions,
    stage: Callable[[DataFrame, str], DataFrame] = lazy,
) -> tuple[DataFrame, CarriedState]:
    """Records that the new ``entries`` (and the clock) make final, and the state after them.

    Calls of sessions that have fallen silent end as interrupted and leave the state: a result that comes later finds
    no call. Sessions, their skill runs and skills called stay known until :func:`forget`.

    ``stage`` writes what is costly to make twice; small parts with two consumers are simply made twice.
    """
    acting = acting_entries(entries)
    directories = stage(resolve_directories(acting.select("cwd"), consent, options.salt), "directories")
    acting = attach_consent(acting, directories, options.scope)
    calls = stage(project_calls(acting, options.name_key, options.harness), "calls")
    new_events = call_events(addressable(calls), addressable(project_results(entries)))
    carried = carry_calls(new_events.unionByName(state.calls), stage)

    seen = first_offsets(entries).unionByName(state.sessions)
    sessions = stage(
        seen.groupBy(*SESSION).agg(F.max("last_activity").alias("last_activity"), F.min("first_offset").alias("first_offset")), "sessions")
    blind = blind_files(entries).unionByName(state.blind).distinct()
    closed = closed_sessions(sessions, blind, options.staleness)

    left = carried.left.withColumn("session", F.col("call.session_id"))
    flagged = stage(with_closed_flag(left, closed), "left-calls")
    given_up = (F.col("tag") == USE) & F.col("is_closed")
    interrupted = flagged.where(given_up).withColumnRenamed("pos", "call_pos")

    called = calls.where((F.col("status") == "accepted") & (F.col("call.kind") == "skill")).select(*RUN)
    invoked = called.unionByName(state.invoked).distinct()
    candidates = collapse_candidates(skill_candidates(acting, options.name_key, options.harness))
    runs = stage(
        candidates.withColumn("done", F.lit(None).cast("string")).unionByName(state.runs).groupBy(*RUN).agg(
            F.min_by("record", F.struct("record.ts", "record.event_id")).alias("record"),
            (F.sum(F.col("extra") + 1) - 1).alias("extra"), F.max("done").alias("done")),
        "skill-runs",
    )
    due = uncovered_runs(runs, invoked, closed).where(~F.col("done").eqNullSafe(F.col("record.event_id")))
    written = due.select(*RUN, F.col("record.event_id").alias("now_done"))
    marked = runs.join(written, RUN, "left").withColumn("done", F.coalesce("now_done", "done")).drop("now_done")

    records = finished_records(carried.pairs, interrupted, due)
    return records, CarriedState(flagged.where(~given_up).drop("session", "is_closed"), sessions, blind, marked, invoked)


def forget(state: CarriedState, staleness: Staleness) -> CarriedState:
    """The state without what lies before the cursor floor of its file.

    Closed sessions go with their skill runs and skills called, and early results from before the first line of any
    open session; of a file without open sessions nothing is left. Should a forgotten session speak again, it is a new
    one, as it is for a reader that starts at the floor. A blind file keeps everything.
    """
    closed = closed_sessions(state.sessions, state.blind, staleness)
    sessions = state.sessions.join(closed, SESSION, "left_anti")
    floors = state.cursors(staleness).where("open_sessions > 0").select("file", "cursor_floor")
    kept = state.calls.join(floors, "file").where((F.col("tag") == USE) | (F.col("pos.line") >= F.col("cursor_floor")))
    return CarriedState(
        kept.drop("cursor_floor"), sessions, state.blind,
        state.runs.join(sessions.select(*SESSION), SESSION, "left_semi"),
        state.invoked.join(sessions.select(*SESSION), SESSION, "left_semi"),
    )
