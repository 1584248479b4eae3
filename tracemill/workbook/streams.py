"""Files, ingests and streams: the same transcripts through every way of collecting them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.ingest import ingest
from tracemill.plans.store import EventStore
from tracemill.session import ROWS_A_FILE, scratch_path
from tracemill.sources.folders import OPENED, write_files
from tracemill.sources.lines import list_files, scan_lines
from tracemill.streaming.collect import FEED, Collector, collect_available, run_until_closed, session_closures
from tracemill.workbook.registry import query
from tracemill.workbook.transcripts import (
    EVENTS_SQL,
    OPTIONS,
    QUIET,
    RECORD_COLUMNS,
    event_consent,
    event_feed,
)


def write_transcripts(spark: SparkSession, events: DataFrame) -> str:
    """The event feed as text files, one folder per transcript."""
    path = scratch_path(spark, "transcripts")
    lines = event_feed(events).repartition("file").sortWithinPartitions("file", "offset")
    if not OPENED.match(path):
        lines.select("file", "value").write.partitionBy("file").text(path)
        return path
    name = F.concat(F.lit("file="), F.coalesce("file", F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/part.txt"))
    write_files(lines.select(name.alias("path"), "value"), path)
    return path


@query("transcript_scan", f"""WITH {EVENTS_SQL}, lines AS (
  SELECT file FROM seen UNION ALL SELECT file FROM e WHERE u % 64 = 3 AND id % 97 = 0)
SELECT file, count(*) AS lines, true AS whole FROM lines GROUP BY file""")
def _(spark, tables):
    path = write_transcripts(spark, tables("events"))
    name = F.regexp_extract("file", r"/file=([^/]+)/", 1)
    read = scan_lines(spark, path, glob="*.txt").groupBy(name.alias("file")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("nbytes").alias("nbytes"))
    sizes = list_files(spark, path, "*.txt").groupBy(name.alias("file")).agg(F.sum("length").alias("length"))
    return read.join(sizes, "file").select("file", "lines", (F.col("nbytes") == F.col("length")).alias("whole"))


_RECORDS = f"WITH {EVENTS_SQL} SELECT {', '.join(RECORD_COLUMNS)} FROM records"


@query("incremental_collection", _RECORDS)
def _(spark, tables):
    """Three micro-batches cut at offsets, collected as they arrive, then one sweep."""
    events = tables("events")
    feed_path = scratch_path(spark, "feed")
    lines = event_feed(events).select("file", F.col("offset").cast("bigint").alias("offset"), "value")
    # Each micro-batch is as many files of bounded size: Spark does not split one that packs well.
    files = max(1, -(-lines.count() // (3 * ROWS_A_FILE)))
    lines.repartition(3 * files, "file", "offset").write.parquet(feed_path)
    store = EventStore(spark, scratch_path(spark, "store"))
    # Until the sweep the clock stands before any session could have fallen silent.
    collector = Collector(spark, scratch_path(spark, "landing"), store, event_consent(events), OPTIONS,
                          clock=lambda: QUIET.now - timedelta(days=60))
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files).parquet(feed_path)
    collect_available(collector.stream(feed, scratch_path(spark, "checkpoint")))
    collector.clock = lambda: QUIET.now
    collector.sweep()
    return store.read().select(*RECORD_COLUMNS)


def _collector(spark: SparkSession, events: DataFrame) -> Collector:
    return Collector(spark, scratch_path(spark, "landing"), EventStore(spark, scratch_path(spark, "store")), event_consent(events), OPTIONS,
                     clock=lambda: QUIET.now)


def _late(feed: DataFrame) -> DataFrame:
    """Whether a line is the result of every seventh call."""
    number = F.regexp_extract("value", '"tool_use_id":"c([0-9]+)"', 1)
    return (number != "") & (number.try_cast("bigint") % 7 == 3)


# A call of a closed session whose result had not come ends as interrupted; the result changes nothing.
_LATE = EVENTS_SQL.replace("FROM calls WHERE id % 20 <> 0\n", "FROM calls WHERE id % 20 <> 0 AND id % 7 <> 3\n").replace(
    "id % 20 = 0 AS is_open, (file, session)",
    "id % 20 = 0 OR (id % 7 = 3 AND (file, session) IN (SELECT (file, session) FROM closed)) AS is_open, (file, session)")


@query("late_results", f"WITH {_LATE} SELECT {', '.join(RECORD_COLUMNS)} FROM records")
def _(spark, tables):
    """Every seventh result arrives only after the sweep that closed its session."""
    events = tables("events")
    feed = event_feed(events).select("file", F.col("offset").cast("bigint").alias("offset"), "value")
    collector = _collector(spark, events)
    collector.process(feed.where(~_late(feed)), 0)
    collector.process(feed.where(_late(feed)), 1)
    return collector.store.read().select(*RECORD_COLUMNS)


@query("collection_with_retention", _RECORDS)
def _(spark, tables):
    """Half of the files, then retention up to the cursors, then the other half: together the records of one ingest."""
    events = tables("events")
    feed = event_feed(events).select("file", F.col("offset").cast("bigint").alias("offset"), "value")
    first = F.pmod(F.xxhash64("file"), F.lit(2)) == 0
    collector = _collector(spark, events)
    collector.process(feed.where(first), 0)
    collector.retain()
    collector.process(feed.where(~first), 1)
    return collector.store.read().select(*RECORD_COLUMNS)


@query("session_closures", f"WITH {EVENTS_SQL} SELECT file, session, last_activity FROM activity")
def _(spark, tables):
    feed_path, out = scratch_path(spark, "feed"), scratch_path(spark, "closures")
    event_feed(tables("events")).select("file", F.col("offset").cast("bigint").alias("offset"), "value").write.parquet(feed_path)
    feed = spark.readStream.schema(FEED).parquet(feed_path)
    closures = session_closures(feed, timedelta(hours=24))
    writer = closures.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "checkpoint"))
    run_until_closed(writer)
    return spark.read.schema(closures.schema).parquet(out)


@query("transcript_ingest", _RECORDS)
def _(spark, tables):
    """The batch job from files to store, run twice: the second run adds nothing."""
    events = tables("events")
    path = write_transcripts(spark, events)
    store = EventStore(spark, scratch_path(spark, "store"))
    for _ in range(2):
        ingest(spark, path, event_consent(events), store, OPTIONS, glob="*.txt")
    return store.read().select(*RECORD_COLUMNS)
