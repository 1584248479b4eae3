"""The ingest job: scan transcripts, derive records, append them, count what happened."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.sessions import blind_files, cursor_floor, first_offsets
from tracemill.plans.derive import (
    Derivation,
    DeriveOptions,
    derive,
    file_counters,
    incomplete_files,
    total_counters,
)
from tracemill.plans.health import ScanHealth
from tracemill.plans.inventory import PRIMITIVES, UsageSnapshots
from tracemill.plans.store import AppendResult, EventStore
from tracemill.session import materialize
from tracemill.sources.lines import list_files, scan_lines
from tracemill.sources.transcripts import decode_entries

# Copies of one event id are ranked the way the files are walked: by path element, then
# by kind of record, then by position.
WALK_ORDER = ["walk", "src_phase", "src_pos", "ts"]


@dataclass(frozen=True)
class IngestReport:
    append: AppendResult
    counters: DataFrame
    files: DataFrame
    cursors: DataFrame
    #: (cwd, kind, name) of the session listings met on the way, when asked for.
    announced: DataFrame | None = None


def in_walk_order(records: DataFrame) -> DataFrame:
    return records.withColumn("walk", F.split("src_file", "/")).drop("src_file")


def _scan(spark: SparkSession, path: str, cap: int | None, glob: str, announced: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, the listing, and the files that were read in part, whose entries are left out.

    The text is read and parsed once; everything later reads the narrow entry table.
    """
    files = materialize(list_files(spark, path, glob), "files")
    entries = materialize(decode_entries(scan_lines(spark, path, cap, glob), announced), "entries")
    incomplete = materialize(incomplete_files(files, entries), "incomplete")
    return entries.join(incomplete, "file", "left_anti"), files, incomplete


def _report(
    entries: DataFrame, files: DataFrame, incomplete: DataFrame, derived: Derivation,
    appended: AppendResult, refused_projects: DataFrame, options: DeriveOptions,
    health: ScanHealth | None,
) -> IngestReport:
    per_file = materialize(file_counters(files, entries, derived, incomplete), "file-counters")
    refused = refused_projects.first()[0]
    totals = total_counters(per_file).select(
        "*",
        F.lit(appended.written).cast("bigint").alias("events_written"),
        F.lit(refused).cast("bigint").alias("refused_projects"),
    )
    if health is not None:
        health.record_scan(totals, options.staleness.now or datetime.now(timezone.utc))
    cursors = cursor_floor(files, first_offsets(entries), blind_files(entries), options.staleness)
    return IngestReport(appended, totals, per_file, cursors)


def ingest(
    spark: SparkSession,
    path: str,
    consent: DataFrame,
    store: EventStore,
    options: DeriveOptions,
    refused_projects: DataFrame | None = None,
    health: ScanHealth | None = None,
    cap: int | None = None,
    glob: str = "*.jsonl",
    rebuild: bool = False,
    snapshots: UsageSnapshots | None = None,
    announced: bool = False,
) -> IngestReport:
    """Scan everything below ``path`` and add what is new; running it again adds nothing.

    ``rebuild`` discards what is stored and derives it afresh; the old generation stays in
    force until the new one is complete. With ``snapshots`` the usage snapshot follows the
    facts: names stay those of the last discovery. With ``announced`` the report holds what
    the session listings name, from the same read, for a discovery to use.
    """
    entries, files, incomplete = _scan(spark, path, cap, glob, announced)
    derived = derive(entries, consent, options, materialize)
    records = in_walk_order(derived.records)
    write = store.rebuild if rebuild else store.append
    appended = write(records, order=WALK_ORDER)
    if snapshots is not None:
        snapshots.refresh(store.read(), spark.createDataFrame([], PRIMITIVES), scanned=False)
    none_refused = spark.range(1).select(F.lit(0).alias("refused_projects"))
    refused = none_refused if refused_projects is None else refused_projects
    made = _report(entries, files, incomplete, derived, appended, refused, options, health)
    return replace(made, announced=entries.select(F.inline("announced"))) if announced else made
