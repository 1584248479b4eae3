"""The invocation store: an idempotent, append-only fact table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, LongType, StringType, StructField, StructType

from tracemill.operators.validation import first_copies, packed, unpacked, unseen, validate
from tracemill.plans.commits import CommitLog
from tracemill.plans.id_index import LEAF_IDS, MAX_DIGITS, IdIndex, Segment
from tracemill.plans.published import PublishedTable, read_if_present
from tracemill.schemas import INVOCATION, INVOCATION_COLUMNS
from tracemill.session import materialize, releasing_shuffles

STORED = StructType(
    INVOCATION.fields
    + [StructField("batch_id", LongType()), StructField("event_date", DateType())]
)
# The place a record was written to inside its batch: file and row, in order of time and id.
_WRITTEN = StructType(STORED.fields + [StructField("slot", LongType()), StructField("attempt", LongType())])
_ROW_BITS = 33
RECORD_ORDER = ["ts"]
#: Batches up to so many records, which Spark can broadcast, are looked up in the stored ids by joins; larger ones meet them in one shuffle.
LOOKED_UP = 50_000
# Columns that may hold one value throughout a batch; such a column is written as that value and crosses no shuffle.
_UNIFORM = [f.name for f in INVOCATION.fields if f.name not in ("event_id", "ts")]
#: Parts that two stores are compared in before their records meet.
DIFFERENCE_PARTS = 4096

_COMMITTED = StructType([
    StructField("kind", StringType()), StructField("id", LongType()), StructField("folder", StringType()), StructField("rows", LongType()),
    StructField("attempt", LongType()), StructField("digits", IntegerType()), StructField("dead", ArrayType(LongType())),
])


@dataclass(frozen=True)
class AppendResult:
    batch_id: int
    written: int
    duplicate: int
    dropped: int


@dataclass(frozen=True)
class _Contents:
    """What is in force: batches by id with (folder, rows, attempt), segments of the id index, the next commit."""

    batches: dict[int, Row]
    segments: list[Segment]
    next_commit: int


class EventStore:
    """Parquet below ``root/version=<g>``, one folder per batch and attempt, ordered by time inside a batch.

    A log of commits names the folders in force. Every write of a batch goes to a folder of its own and counts
    once it is committed, so readers never see half of it; running the same batch id again replaces exactly what that
    batch wrote before, which makes a retried micro-batch harmless. A generation is replaced only by :meth:`rebuild`.

    Ids already stored are looked up in an index that is kept in the same log (see ``id_index``), and the log knows the
    rows of each batch: neither an append nor a read after some position reads the earlier batches.
    """

    def __init__(self, spark: SparkSession, root: str, leaf_ids: int = LEAF_IDS):
        self.spark, self.leaf_ids = spark, leaf_ids
        self.table = PublishedTable(spark, root, STORED)
        self._logs: dict[int, CommitLog] = {}

    def _log(self, generation: int) -> CommitLog:
        if generation not in self._logs:
            self._logs[generation] = CommitLog(self.spark, f"{self.table.root}/log-{generation}", _COMMITTED, ["kind", "id"])
        return self._logs[generation]

    def _index(self, generation: int) -> IdIndex:
        return IdIndex(self.spark, f"{self.table.root}/ids-{generation}", self.leaf_ids)

    def _contents(self, generation: int) -> _Contents:
        rows, number = self._log(generation).read()
        return _Contents(
            {r.id: r for r in rows if r.kind == "batch"},
            [Segment(r.id, r.folder, r.rows, r.digits, list(r.dead or [])) for r in rows if r.kind == "segment"],
            number,
        )

    def _rows(self, batches: list[Row], generation: int) -> DataFrame:
        folders = [b.folder for b in batches if b.rows]
        if not folders:
            return self.spark.createDataFrame([], _WRITTEN)
        return self.spark.read.schema(_WRITTEN).option("basePath", self.table.path(generation)).parquet(*folders)

    def read(self, after_batch: int | None = None) -> DataFrame:
        """Stored records; ``after_batch`` reads later batches only."""
        generation = self.table.version()
        batches = self._contents(generation).batches
        wanted = [b for n, b in sorted(batches.items()) if after_batch is None or n > after_batch]
        return self._rows(wanted, generation).select(*STORED.fieldNames())

    def entries(self, after: int = 0) -> DataFrame:
        """Records with their dense position from ``after`` on: by batch, then in the order they were written in.

        The log knows where each batch begins, so earlier batches are not read; inside a batch the files are numbered
        by their sizes. Nothing is sorted.
        """
        generation = self.table.version()
        begins, wanted, total = [], [], 0
        for number, batch in sorted(self._contents(generation).batches.items()):
            if total + batch.rows > after:
                begins.append((number, total))
                wanted.append(batch)
            total += batch.rows
        rows = self._rows(wanted, generation).withColumn("_file", F.shiftright("slot", _ROW_BITS))
        earlier = Window.partitionBy("batch_id").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy("batch_id", "_file").agg(F.count(F.lit(1)).alias("_n"))
        # One row per file of the batches read.
        bases = sizes.join(self.spark.createDataFrame(begins, "batch_id bigint, _begin bigint"), "batch_id").select(
            "batch_id", "_file", (F.col("_begin") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_base"))
        row = F.col("slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        placed = rows.join(bases, ["batch_id", "_file"]).withColumn("position", (F.col("_base") + row + 1).cast("bigint"))
        return placed.select(*STORED.fieldNames(), "position").where(F.col("position") > after)

    def head(self) -> int:
        """Highest position: the number of stored records."""
        return sum(b.rows for b in self._contents(self.table.version()).batches.values())

    def next_batch(self) -> int:
        return max(self._contents(self.table.version()).batches, default=-1) + 1

    def append(
        self,
        records: DataFrame,
        batch_id: int | None = None,
        order: list[str] | None = None,
        stage: Callable[[DataFrame, str], DataFrame] = materialize,
    ) -> AppendResult:
        """Validate, drop ids already stored or repeated, append the rest. Never an update.

        ``order`` ranks copies of one id inside the batch; the first one is kept. Counts
        are taken from staged and committed files, so a retried task cannot inflate them.
        With ``lazy`` as ``stage`` the records are evaluated anew by each step instead of being
        copied first: for records that are a projection of stored files and so always the same.
        """
        with releasing_shuffles(self.spark):
            return self._write(records, batch_id, self.table.version(), order or RECORD_ORDER, stage)

    def rebuild(
        self,
        records: DataFrame,
        order: list[str] | None = None,
        stage: Callable[[DataFrame, str], DataFrame] = materialize,
    ) -> AppendResult:
        """Write a new generation from scratch, then make it current."""
        generation = self.table.version() + 1
        abandoned = self._contents(generation).batches
        if abandoned:
            self._log(generation).commit([
                {"kind": kind, "id": n, "live": False} for kind, ids in (
                    ("batch", abandoned), ("segment", [s.number for s in self._contents(generation).segments])) for n in ids])
        with releasing_shuffles(self.spark):
            result = self._write(records, 0, generation, order or RECORD_ORDER, stage)
        self.table.point_to(generation)
        return result

    def _write(self, records, batch, generation, order, stage) -> AppendResult:
        contents = self._contents(generation)
        batch = max(contents.batches, default=-1) + 1 if batch is None else batch
        extra = [c for c in order if c not in INVOCATION_COLUMNS]
        checked = stage(validate(records.select(*INVOCATION_COLUMNS, *extra)), "append")
        valid = checked.where("invalid_reason is null").drop("invalid_reason")
        sample = valid.select(*_UNIFORM).head()
        types = {f.name: f.dataType for f in INVOCATION.fields}
        same = {c: F.lit(sample[c] if sample else None).cast(types[c]) for c in _UNIFORM if c not in order}
        is_valid = F.col("invalid_reason").isNull()
        # At most 16 ** MAX_DIGITS prefixes.
        prefix = F.when(is_valid, F.substring("event_id", 1, MAX_DIGITS))
        total, dropped, prefixes, *held = checked.agg(
            F.count(F.lit(1)), F.count("invalid_reason"), F.collect_set(prefix),
            *[F.bool_and(~is_valid | F.col(c).eqNullSafe(value)) for c, value in same.items()],
        ).first()
        same = {c: value for (c, value), holds in zip(same.items(), held, strict=True) if holds}
        valid = valid.drop(*same)

        # Ids of the attempt that this one replaces do not count as stored.
        replaced = contents.batches.get(batch)
        segments = [replace(s, dead=[*s.dead, replaced.attempt]) if replaced else s for s in contents.segments]
        stored = packed(self._index(generation).stored(segments, prefixes))
        valid = packed(valid)
        new = unseen(first_copies(valid, order), stored) if total <= LOOKED_UP else first_copies(valid, order, stored)
        fresh = unpacked(
            new.select(*[c for c in INVOCATION_COLUMNS if c not in same])
            # Even files over disjoint time ranges: a date filter skips files by their
            # column statistics, a hot day is split, and a sparse batch stays a few files.
            .repartitionByRange("ts", "event_id")
            .sortWithinPartitions("ts", "event_id")
            .withColumn("slot", F.monotonically_increasing_id())
        ).withColumns(same).select(*INVOCATION_COLUMNS, F.to_date("ts").alias("event_date"), "slot")
        target = f"{self.table.path(generation)}/batch_id={batch}/attempt={contents.next_commit}"
        fresh.write.mode("overwrite").option("compression", "zstd").parquet(target)
        written = read_if_present(self.spark, target, INVOCATION).count()
        self._commit(generation, batch, target, written, contents, segments if replaced else [])
        return AppendResult(batch, written, total - dropped - written, dropped)

    def _commit(self, generation: int, batch: int, folder: str, rows: int, contents: _Contents, changed: list[Segment]) -> None:
        """Put the batch in force together with its ids, then merge segments of the index as far as they are due."""
        log, index, number = self._log(generation), self._index(generation), contents.next_commit

        def row(segment: Segment, live: bool = True) -> dict:
            return {"kind": "segment", "id": segment.number, "folder": segment.folder, "rows": segment.rows,
                    "digits": segment.digits, "dead": segment.dead, "live": live}

        own = Segment(number, folder, rows, 0)
        replaced = contents.batches[batch].folder if batch in contents.batches else None
        log.commit([{"kind": "batch", "id": batch, "folder": folder, "rows": rows, "attempt": number},
                    *(row(s, live=s.folder != replaced) for s in changed), row(own)])
        segments = [*(s for s in changed or contents.segments if s.folder != replaced), own]
        while due := index.due(segments):
            number = log.read()[1]
            merged = index.merge(due, number)
            log.commit([row(merged), *(row(s, live=False) for s in due)])
            segments = [s for s in segments if s not in due] + [merged]


def record_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with the side: empty when two stores hold the same records.

    Copies count: a row is returned as often as one side holds it more. The sides are compared part by part first, by 128-bit
    sums over their records; the records of parts that differ meet in one aggregate. So the cost follows the differences.
    """
    a, b = left.select(*INVOCATION_COLUMNS), right.select(*INVOCATION_COLUMNS)
    both = a.withColumn("more", F.lit(1)).unionByName(b.withColumn("more", F.lit(-1)))
    part = F.pmod(F.xxhash64("event_id"), F.lit(DIFFERENCE_PARTS)).cast("int")
    parts = [r.part for r in _unlike(both, part).collect()]
    if len(parts) <= DIFFERENCE_PARTS // 2:
        both = both.where(part.isin(parts))
    net = both.groupBy(*INVOCATION_COLUMNS).agg(F.sum("more").alias("more")).where("more <> 0")
    side = F.when(F.col("more") > 0, "left").otherwise("right").alias("side")
    return net.select(*INVOCATION_COLUMNS, side, F.explode(F.array_repeat(F.lit(0), F.abs("more").cast("int")))).drop("col")


def _unlike(both: DataFrame, part: Column) -> DataFrame:
    """(part) in which the rows counted 1 and those counted -1 are not the same; at most ``DIFFERENCE_PARTS`` rows."""
    # A hash passes over NULLs, so it is told which columns hold one.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in INVOCATION_COLUMNS])
    hashes = {f"h{i}": F.xxhash64(F.lit(i), nulls, *INVOCATION_COLUMNS) for i in range(2)}
    # Halves of 32 bits, whose sums stay within 64.
    halves = [c for h in hashes for c in (F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = [F.sum(F.col("more") * half).alias(f"s{i}") for i, half in enumerate(halves)]
    compared = both.select(part.alias("part"), "more", *[h.alias(n) for n, h in hashes.items()]).groupBy("part").agg(F.sum("more").alias("n"), *sums)
    return compared.where(" or ".join(f"{c} <> 0" for c in compared.columns[1:])).select("part")
