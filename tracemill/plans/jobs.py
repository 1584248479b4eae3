"""The jobs around the facts: discover primitives, report on them, diagnose collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.usage import order_usage, usage_by_provenance
from tracemill.plans.health import ScanHealth
from tracemill.plans.inventory import PRIMITIVES, UsageSnapshots, catalog, order_snapshot
from tracemill.plans.marts import last_observed, overview, unused_overview, unused_primitives, used_primitives
from tracemill.plans.store import EventStore
from tracemill.schemas import DEFAULT_HARNESS
from tracemill.session import materialize
from tracemill.sources.catalog_files import (
    PLUGIN_MANIFEST,
    PROJECT_FOLDER,
    announced_primitives,
    list_documents,
    listed_primitives,
    mcp_documents,
    mcp_servers,
    plugin_paths,
    primitives_in_layout,
)
from tracemill.sources.folders import read_documents
from tracemill.sources.lines import scan_lines


@dataclass(frozen=True)
class Discovery:
    """Primitives found, and whether any project was looked at."""

    primitives: DataFrame
    scanned: bool


def primitives_of(
    files: DataFrame, bases: DataFrame, documents: DataFrame, listed: DataFrame, name_key: bytes | None,
    harness: str = DEFAULT_HARNESS,
) -> DataFrame:
    """The catalog that follows from a file listing, configuration documents and what session listings name."""
    return catalog([primitives_in_layout(files, bases), mcp_servers(documents), listed], name_key, harness)


def discover(
    spark: SparkSession, home: str, roots: DataFrame | None, name_key: bytes | None, harness: str = DEFAULT_HARNESS,
    announced: DataFrame | None = None,
) -> Discovery:
    """Everything a harness can run: its own folder, its plugins, and the consented ``roots(root)``.

    Sources that are missing or malformed contribute nothing. Without roots only global
    primitives are found, and a snapshot keeps the project names it had. ``announced`` is what
    an ingest has read in the transcripts; without it they are read here.
    """
    base = spark.createDataFrame([(home.rstrip("/"),)], "base string")
    manifest = base.select(F.concat("base", F.lit(f"/{PLUGIN_MANIFEST}")).alias("path"))
    plugins = materialize(plugin_paths(read_documents(manifest)), "plugins")
    known = spark.createDataFrame([], "root string") if roots is None else roots.select("root").distinct()
    projects = known.select(F.col("root").alias("base"))
    folders = base.unionByName(plugins).unionByName(projects.select(F.concat("base", F.lit(PROJECT_FOLDER)).alias("base")))
    if announced is None:
        listed = listed_primitives(scan_lines(spark, f"{home.rstrip('/')}/projects"), known)
    else:
        listed = announced_primitives(announced, known)
    found = primitives_of(
        list_documents(folders), folders, read_documents(mcp_documents(base, plugins, projects)), listed, name_key, harness)
    return Discovery(found, roots is not None)


@dataclass(frozen=True)
class Report:
    """Tables of one report; all of them follow from the same facts and the same snapshot."""

    last_observed: DataFrame
    tiles: DataFrame
    by_provenance: DataFrame
    used: DataFrame
    unused: DataFrame
    unused_by_kind: DataFrame


def report_of(records: DataFrame, usage: DataFrame) -> Report:
    return Report(
        last_observed(records), overview(records, usage), order_usage(usage_by_provenance(records)),
        used_primitives(order_snapshot(usage)), unused_primitives(usage), unused_overview(usage),
    )


def report(store: EventStore, snapshots: UsageSnapshots, discovery: Discovery | None = None) -> Report:
    """Refresh the snapshot, then report on it: what was used, and what never was.

    Without a discovery the last known names are carried forward.
    """
    records = store.read()
    found = discovery or Discovery(records.sparkSession.createDataFrame([], PRIMITIVES), False)
    snapshots.refresh(records, found.primitives, found.scanned)
    return report_of(records, snapshots.read())


def doctor(health: ScanHealth, hooks_installed: int | None) -> DataFrame:
    """One row: the state of collection, the counters of the last scan, and the hooks.

    ``hooks_installed`` is counted by the caller, NULL when the settings are unreadable;
    what an earlier set-up recorded about removed and kept hooks stands next to it.
    """
    hooks = health.hooks().select("removed", "kept_owned")
    scan = health.diagnose(hooks_readable=hooks_installed is not None)
    # Two one-row tables become one row.
    both = scan.unionByName(hooks, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*scan.columns, *hooks.columns]]).withColumn(
        "installed", F.lit(hooks_installed or 0))
