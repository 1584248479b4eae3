"""From decoded transcript entries to invocation records and per-file counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.calls import (
    acting_entries,
    addressable,
    invocation,
    project_calls,
    project_results,
    skill_candidates,
)
from tracemill.operators.consent import WHOLE_HISTORY, attach_consent, resolve_directories
from tracemill.operators.pairing import POSITION_TYPE, call_events, pair_calls
from tracemill.operators.sessions import (
    Staleness,
    blind_files,
    closed_sessions,
    session_activity,
    with_closed_flag,
)
from tracemill.operators.skills import collapse_candidates, uncovered_runs
from tracemill.schemas import DEFAULT_HARNESS
from tracemill.session import lazy

# Where a record came from inside a run; orders copies of one event id the way they were
# written: paired calls, then calls closed as interrupted, then skill runs.
PROVENANCE = ["src_file", "src_phase", "src_pos"]
PAIRED, STALE, SKILL_RUN = 0, 1, 2


@dataclass(frozen=True)
class DeriveOptions:
    salt: bytes
    name_key: bytes | None = None
    staleness: Staleness = field(default_factory=Staleness)
    scope: str = WHOLE_HISTORY
    harness: str = DEFAULT_HARNESS


@dataclass(frozen=True)
class Derivation:
    """What one pass over the entries yields; every member is a DataFrame."""

    records: DataFrame
    pending: DataFrame
    interrupted: DataFrame
    skill_runs: DataFrame
    refused: DataFrame
    activity: DataFrame


def derive(
    entries: DataFrame,
    consent: DataFrame,
    options: DeriveOptions,
    stage: Callable[[DataFrame, str], DataFrame] = lazy,
) -> Derivation:
    """Pair calls, close what went quiet, keep uncovered skill runs.

    ``stage`` decides what happens to a frame with several consumers: left lazy, or
    written once to the shared scratch folder (large runs).
    """
    acting = acting_entries(entries)
    directories = stage(resolve_directories(acting.select("cwd"), consent, options.salt), "directories")
    acting = attach_consent(acting, directories, options.scope)

    calls = stage(project_calls(acting, options.name_key, options.harness), "calls")
    results = project_results(entries)
    events = stage(call_events(addressable(calls), addressable(results)), "call-events")
    pairs = stage(pair_calls(events, stage), "pairs")

    activity = stage(session_activity(entries), "sessions")
    closed = stage(closed_sessions(activity, blind_files(entries), options.staleness), "closed-sessions")

    open_calls = pairs.where(F.col("result").isNull()).withColumn("session", F.col("call.session_id"))
    ended = stage(with_closed_flag(open_calls, closed), "open-calls")
    interrupted, pending = ended.where("is_closed").drop("is_closed"), ended.where("not is_closed").drop("is_closed")

    invoked = calls.where((F.col("status") == "accepted") & (F.col("call.kind") == "skill"))
    candidates = collapse_candidates(skill_candidates(acting, options.name_key, options.harness))
    runs = stage(uncovered_runs(candidates, invoked, closed), "skill-runs")

    records = finished_records(pairs.where(F.col("result").isNotNull()), interrupted, runs)
    return Derivation(
        records=records,
        pending=pending,
        interrupted=interrupted,
        skill_runs=runs,
        refused=calls.where(F.col("status") == "refused"),
        activity=activity,
    )


def finished_records(paired: DataFrame, interrupted: DataFrame, runs: DataFrame) -> DataFrame:
    """The records of completed pairs, of calls that were never answered, and of skill runs, with their provenance."""
    return (
        paired.select(
            *invocation("call", F.col("result.ts"), F.col("result.outcome")),
            F.col("file").alias("src_file"),
            F.lit(PAIRED).alias("src_phase"),
            F.greatest("call_pos", "result_pos").alias("src_pos"),
        )
        .unionByName(
            interrupted.select(
                *invocation("call", F.col("call.ts"), F.lit("interrupted")),
                F.col("file").alias("src_file"),
                F.lit(STALE).alias("src_phase"),
                F.col("call_pos").alias("src_pos"),
            )
        )
        .unionByName(
            runs.select(
                *invocation("record", F.col("record.ts"), F.lit(None)),
                F.col("file").alias("src_file"),
                F.lit(SKILL_RUN).alias("src_phase"),
                F.lit(None).cast(POSITION_TYPE).alias("src_pos"),
            )
        )
    )


def incomplete_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file) of which some lines, but fewer bytes than listed were read.

    List before reading: a transcript that grows in between is longer than listed, not
    shorter. Every line counts a newline, which the last one may lack.
    """
    read = lines.groupBy("file").agg(F.sum("nbytes").alias("read"))
    return files.join(read, "file").where("read < length").select("file")


def file_counters(
    files: DataFrame, entries: DataFrame, derived: Derivation, incomplete: DataFrame | None = None
) -> DataFrame:
    """One row per transcript with its counters; ``files`` is the (file, length) listing.

    A non-empty file without a single line read is unreadable. One that was read in part
    (``incomplete``; its entries are not in ``entries``) counts one parse error and nothing
    else. All parts are combining counts by file, summed once.
    """
    zero = F.lit(0).cast("bigint")
    names = [
        "lines", "malformed", "oversize", "blind", "bookkeeping", "mistyped",
        "refused_calls", "pending_calls", "interrupted_calls", "ambiguous_skill_runs", "parsed",
    ]

    def part(df: DataFrame, key: str = "file", **counts) -> DataFrame:
        return df.groupBy(F.col(key).alias("file")).agg(
            *[counts.get(n, zero).cast("bigint").alias(n) if n in counts else F.max(zero).alias(n) for n in names]
        )

    one = F.count(F.lit(1))
    reason = F.col("malformed_reason")
    parts = [
        part(
            entries,
            lines=one,
            malformed=F.count_if(F.col("status") == "malformed"),
            oversize=F.count_if(F.col("status") == "oversize"),
            blind=F.count_if(reason == "blind"),
            bookkeeping=F.count_if(reason == "bookkeeping"),
            mistyped=F.count_if(reason == "mistyped"),
        ),
        part(derived.refused, refused_calls=one),
        part(derived.pending, pending_calls=one),
        part(derived.interrupted, interrupted_calls=one),
        part(derived.skill_runs, ambiguous_skill_runs=F.sum("extra")),
        part(derived.records, key="src_file", parsed=one),
    ]
    merged = parts[0]
    for extra in parts[1:]:
        merged = merged.unionByName(extra)
    totals = merged.groupBy("file").agg(*[F.sum(n).alias(n) for n in names])
    counted = files.select("file", "length").join(totals, "file", "left")
    if incomplete is None:
        counted = counted.withColumn("failed", F.lit(False))
    else:
        counted = counted.join(incomplete.withColumn("failed", F.lit(True)), "file", "left")
    failed = F.coalesce("failed", F.lit(False))
    return counted.select(
        "file",
        ((F.col("length") > 0) & F.col("lines").isNull() & ~failed).alias("unreadable"),
        failed.alias("failed"),
        *[F.coalesce(n, zero).alias(n) for n in names],
        (F.coalesce(F.col("malformed") + F.col("oversize"), zero) + failed.cast("bigint")).alias("parse_errors"),
    ).withColumn(
        "skipped",
        ~F.col("unreadable") & ~F.col("failed") & (F.col("parsed") == 0) & (F.col("refused_calls") == 0),
    )


def total_counters(per_file: DataFrame) -> DataFrame:
    """One row: the counters of a whole scan, plus the split of its parse errors."""
    sums = [
        "parse_errors", "refused_calls", "pending_calls", "interrupted_calls", "ambiguous_skill_runs",
        "blind", "bookkeeping", "mistyped", "oversize",
    ]
    return per_file.agg(
        F.count(F.lit(1)).alias("transcripts"),
        F.count_if("unreadable").alias("unreadable"),
        F.count_if("skipped").alias("skipped"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
    )
