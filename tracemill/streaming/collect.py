"""Incremental collection from a line feed.

The feed delivers rows (file, offset, value): a topic, a table or rotated segments. Files
that grow in place are covered by scheduled batch ingests instead, because a file stream
reads each file once.

Every trigger merges its lines into a small state per file (see ``plans.carried``) and
stores the records that became final; lines are not kept. The state lies in buckets of
files: a trigger reads and rewrites the buckets of the files it touches, and a log of
commits names the folder each bucket is in, together with the last epoch merged. So a
trigger that is replayed changes nothing, a late result of a call that already ended as
interrupted changes nothing, an early result waits for its call, and the outcome equals
one batch ingest of the same lines, given that lines of an id used more than once come
in file order.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tracemill.operators.sessions import Staleness
from tracemill.plans.carried import CarriedState, advance, forget, state_schema
from tracemill.plans.commits import CommitLog
from tracemill.plans.derive import DeriveOptions
from tracemill.plans.ingest import WALK_ORDER, in_walk_order
from tracemill.plans.store import AppendResult, EventStore
from tracemill.session import evened, materialize
from tracemill.sources.lines import feed_lines
from tracemill.sources.transcripts import decode_entries

FEED = StructType().add("file", "string").add("offset", "long").add("value", "string")
_LOG = (
    StructType().add("kind", "string").add("id", "long").add("folder", "string").add("rows", "long")
    .add("batch_id", "long").add("merged", "boolean")
)

# The state is spread over this many folders by file, so that a trigger only rewrites
# those of the files it touches.
STATE_BUCKETS = 64


class Collector:
    """Micro-batch body shared by the stream and by sweeps. One writer at a time."""

    def __init__(
        self,
        spark: SparkSession,
        landing: str,
        store: EventStore,
        consent: DataFrame,
        options: DeriveOptions,
        clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
        cap: int | None = None,
        buckets: int = STATE_BUCKETS,
    ):
        self.spark, self.landing, self.store = spark, landing.rstrip("/"), store
        self.consent, self.options, self.clock, self.cap, self.buckets = consent, options, clock, cap, buckets
        self.log = CommitLog(spark, f"{self.landing}/log", _LOG, ["kind", "id"])
        self.entries = decode_entries(feed_lines(spark.createDataFrame([], FEED))).schema
        state = state_schema(spark, self.entries, options, consent)
        self.schema = StructType(state.fields).add("bucket", "integer")

    def _options(self) -> DeriveOptions:
        stale = self.options.staleness
        return replace(self.options, staleness=Staleness(stale.timeout, self.clock()))

    def _bucket(self):
        return F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int")

    def state_rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The packed state in force, of all buckets or of some."""
        folders = [r.folder for r in self.log.read()[0] if r.kind == "bucket" and r.rows and (buckets is None or r.id in buckets)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.landing}/state").parquet(*folders)

    def _advance(self, entries: DataFrame, buckets: list[int], batch: int | None, epoch: int | None = None) -> AppendResult:
        """Merge entries into the state of their buckets, store what became final, then put the new state in force."""
        state = CarriedState.unpacked(self.state_rows(buckets))
        records, state = advance(entries, state, self.consent, self._options(), materialize)
        appended = self.store.append(in_walk_order(records), batch_id=batch, order=WALK_ORDER)
        done = [] if epoch is None else [{"kind": "epoch", "id": epoch, "batch_id": batch, "merged": True}]
        self._write(state, buckets, done)
        return appended

    def _write(self, state: CarriedState, buckets: list[int], changes: list[dict]) -> None:
        rows, number = self.log.read()
        folder = f"{self.landing}/state/commit={number}"
        # Files of even size per bucket; a bucket with very many rows becomes several.
        packed = state.packed().withColumn("bucket", self._bucket()).select(*self.schema.fieldNames())
        packed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(self.schema).parquet(folder)
        sizes = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}
        epochs = [r.id for r in rows if r.kind == "epoch" and r.merged]
        forgotten = [{"kind": "epoch", "id": e, "live": False} for e in epochs if changes and e != changes[0]["id"]]
        self.log.commit([
            *changes, *forgotten,
            *({"kind": "bucket", "id": b, "folder": f"{folder}/bucket={b}", "rows": sizes.get(b, 0)} for b in buckets)])

    def process(self, feed: DataFrame, epoch: int) -> AppendResult:
        """Body of ``foreachBatch``; an epoch that was merged before is left alone.

        The store batch of an epoch is fixed before anything is stored: a trigger that failed half-way replaces it.
        """
        known = {r.id: r for r in self.log.read()[0] if r.kind == "epoch"}
        merged = [e for e, r in known.items() if r.merged]
        if merged and epoch <= max(merged):
            return AppendResult(known[epoch].batch_id if epoch in known else -1, 0, 0, 0)
        batch = known[epoch].batch_id if epoch in known else self.store.next_batch()
        if epoch not in known:
            self.log.commit([{"kind": "epoch", "id": epoch, "batch_id": batch, "merged": False}])
        entries = materialize(decode_entries(feed_lines(evened(feed), self.cap)), "entries")
        return self._advance(entries, self._buckets_of(entries), batch, epoch)

    def _buckets_of(self, files: DataFrame) -> list[int]:
        return sorted(r.bucket for r in files.select(self._bucket().alias("bucket")).distinct().collect())

    def _all_buckets(self) -> list[int]:
        return sorted(r.id for r in self.log.read()[0] if r.kind == "bucket")

    def sweep(self, files: DataFrame | None = None) -> AppendResult:
        """Apply the closing rule by the clock to the state, of all files or of the buckets of ``files(file)``."""
        buckets = self._all_buckets() if files is None else self._buckets_of(files)
        return self._advance(self.spark.createDataFrame([], self.entries), buckets, None)

    def cursors(self) -> DataFrame:
        """Per file: open sessions and the offset its lines must be kept from."""
        return CarriedState.unpacked(self.state_rows()).cursors(self._options().staleness)

    def retain(self) -> DataFrame:
        """Sweep, then drop from the state what lies before the cursors; returns them.

        The feed may be cut at the cursors as well: no line before them is needed again.
        """
        self.sweep()
        staleness, buckets = self._options().staleness, self._all_buckets()
        state = CarriedState.unpacked(self.state_rows())
        cursors = materialize(state.cursors(staleness), "cursors")
        self._write(forget(state, staleness), buckets, [])
        return cursors

    def stream(self, feed: DataFrame, checkpoint: str) -> DataStreamWriter:
        """The configured writer of the collecting stream; the caller sets a trigger and starts it."""
        return (
            feed.writeStream.option("checkpointLocation", checkpoint)
            .outputMode("append")
            .foreachBatch(lambda batch, epoch: self.process(batch, epoch))
        )

    def closing_stream(self, feed: DataFrame, checkpoint: str, timeout: timedelta) -> DataStreamWriter:
        """Sweeps the files whose sessions fall silent, without waiting for new lines.

        The records come from the collector's state; nothing is derived a second time.
        """
        closures = session_closures(feed, timeout, self.cap)
        return (
            closures.writeStream.option("checkpointLocation", checkpoint)
            .outputMode("append")
            .foreachBatch(lambda batch, epoch: self._sweep_closed(batch))
        )

    def _sweep_closed(self, closures: DataFrame) -> None:
        files = materialize(closures.select("file").distinct(), "closures")
        if not files.isEmpty():
            self.sweep(files)


_ACTIVITY = "file string, session string, last_micros bigint"
_CLOSURE = "file string, session string, last_activity timestamp"


def _latest_per_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shrink each Arrow batch to one row per session before it is shuffled to its state."""
    for frame in frames:
        yield frame.groupby(["file", "session"], as_index=False)["last_micros"].max()


def session_closures(feed: DataFrame, timeout: timedelta, cap: int | None = None) -> DataFrame:
    """Streaming (file, session, last_activity) rows, one when a session has been silent too long.

    The state of a session is one number. The timer is only a reminder: when it fires, the
    silence is measured again from the last activity, and the timer is set for the rest.
    A session that speaks again is tracked again.
    """
    timeout_ms = timeout // timedelta(milliseconds=1)
    seen = (
        decode_entries(feed_lines(feed, cap))
        .where("seen_session is not null and seen_ts is not null")
        .select("file", F.col("seen_session").alias("session"), F.unix_micros("seen_ts").alias("last_micros"))
        .mapInPandas(_latest_per_batch, _ACTIVITY)
    )

    def track(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for frame in frames:
            if frame.empty:  # a timer fired
                continue
            newest = int(frame["last_micros"].max())
            last = newest if last is None else max(last, newest)
        silent_ms = state.getCurrentProcessingTimeMs() - last / 1000
        if state.hasTimedOut and silent_ms > timeout_ms:
            state.remove()
            stamp = pd.to_datetime([last], unit="us", utc=True)
            yield pd.DataFrame({"file": [key[0]], "session": [key[1]], "last_activity": stamp})
            return
        state.update((last,))
        state.setTimeoutDuration(max(1, int(timeout_ms - silent_ms) + 1))

    return seen.groupBy("file", "session").applyInPandasWithState(
        track, _CLOSURE, "last_micros bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def collect_available(writer: DataStreamWriter) -> None:
    """Drain what the feed holds now, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


class _Emptied(StreamingQueryListener):
    """Notices when a query has read its feed and its state is empty, or has ended."""

    def __init__(self):
        self.query_id, self.over = None, threading.Event()

    def _own(self, query_id) -> bool:
        return self.query_id is not None and str(query_id) == self.query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self._own(progress.id) and progress.numInputRows == 0 and progress.stateOperators and all(
            o.numRowsTotal == 0 for o in progress.stateOperators
        ):
            self.over.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._own(event.id):
            self.over.set()


def run_until_closed(writer: DataStreamWriter) -> None:
    """Run a stream with timers until it has read its feed and holds no session any more.

    A query with processing-time timers always wants another batch, so it never ends under
    ``availableNow``; in service it simply keeps running on a processing-time trigger. Here
    every session is waited for, however young: the end follows from the state alone, which
    the query reports after each batch.
    """
    spark = SparkSession.getActiveSession()
    listener = _Emptied()
    spark.streams.addListener(listener)
    try:
        query = writer.trigger(processingTime="0 seconds").start()
        listener.query_id = str(query.id)
        try:
            listener.over.wait()
            if query.exception() is not None:
                raise query.exception()
        finally:
            query.stop()
    finally:
        spark.streams.removeListener(listener)
