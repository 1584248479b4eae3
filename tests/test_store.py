"""Append, rebuild, import and positions."""

import hashlib
import time
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tests.hostile import not_names
from tracemill.operators.positions import with_positions
from tracemill.operators.validation import first_copies, validate
from tracemill.plans.commits import CommitLog
from tracemill.plans.id_index import MAX_DIGITS
from tracemill.plans.store import EventStore, record_differences
from tracemill.schemas import INVOCATION
from tracemill.session import lazy
from tracemill.sources.event_lines import read_event_lines
from tracemill.sources.lines import list_files, scan_lines

BASE = dict(
    schema_version=1, ts=datetime(2021, 5, 4, 9, tzinfo=timezone.utc), harness="claude-code", harness_version=None,
    session_id="voyage-a", repo="c0ffee00c0ffee00c0ffee00c0ffee00", kind="skill", name="tide-check", package=None,
    package_version=None, source=None, via_skill=None, via_agent=None, model=None, effort=None, invoker="model",
    outcome="ok", duration_ms=None,
)


def record(number, **over):
    row = {**BASE, "event_id": f"{number:064x}", **over}
    return tuple(row[f] for f in INVOCATION.fieldNames())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), INVOCATION)


def test_validation(spark):
    hostile = not_names("lantern", "kelp")
    cases = [(record(1), None), (record(2, schema_version=2), "schema version"), (record(3, ts=None), "timestamp"),
             (record(4, outcome="fine"), "outcome"), (record(5, source="web"), "source"),
             (record(6, duration_ms=-1), "duration"), (record(7, kind="tool"), "required field"),
             (record(8, harness="Other Harness"), "required field"), (record(9, model="a b"), "optional field"),
             (record(10, model=""), None), (record(11, harness_version="1.2+x"), None),
             (record(12, event_id="XYZ"), "event id"), (record(13, outcome=None, kind="session_end"), None),
             (record(14, harness="a" * 33), "required field")]
    cases += [(record(100 + i, name=h), "required field") for i, h in enumerate(hostile)]
    cases += [(record(200 + i, package=h), "optional field") for i, h in enumerate(hostile) if h]
    got = {r.event_id: r.invalid_reason for r in validate(frame(spark, *[c for c, _ in cases])).collect()}
    for row, reason in cases:
        assert got[row[1]] == reason, row


def test_append_is_idempotent(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    late = datetime(2021, 5, 4, 10, tzinfo=timezone.utc)
    batch = frame(spark, record(1, outcome="error", ts=late), record(1), record(2), record(3, name="a/b"))
    first = store.append(batch)
    assert (first.batch_id, first.written, first.duplicate, first.dropped) == (0, 2, 1, 1)
    again = store.append(batch)
    assert (again.batch_id, again.written, again.duplicate, again.dropped) == (0 + 1, 0, 3, 1)
    kept = store.read().where(F.col("event_id") == f"{1:064x}").first()
    assert kept.outcome == "ok"
    # The same batch id again replaces that batch and nothing else.
    assert store.append(frame(spark, record(4)), batch_id=7).written == 1
    assert store.append(frame(spark, record(4), record(1)), batch_id=7).written == 1
    assert store.head() == 3
    assert [r.position for r in store.entries(after=1).orderBy("position").collect()] == [2, 3]
    assert store.read(after_batch=0).count() == 1


def test_lookup_cost_follows_the_batch_not_the_store(spark, tmp_path):
    """Ids read from the index by the same append into stores of 1, 4 and 16 times the size."""
    read = []
    for times in (1, 4, 16):
        store = EventStore(spark, str(tmp_path / f"x{times}"), leaf_ids=64)
        rows = spark.range(1000 * times).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"))
        fields = [F.lit(BASE.get(f.name)).cast(f.dataType).alias(f.name) if f.name != "event_id" else F.col("event_id") for f in INVOCATION.fields]
        store.append(rows.select(*fields))
        ids = [hashlib.sha256(str(i).encode()).hexdigest() for i in [*range(5), *range(10**6, 10**6 + 5)]]
        looked_up = store._index(0).stored(store._contents(0).segments, [i[:MAX_DIGITS] for i in ids])
        read.append(looked_up.count())
        # Whole folders are left out, not rows.
        assert "PartitionFilters: [prefix" in looked_up._jdf.queryExecution().executedPlan().toString()
        result = store.append(frame(spark, *[record(1, event_id=i) for i in ids]))
        assert (result.written, result.duplicate) == (5, 5)
    # Ten folders at most, whatever the size of the store.
    assert max(read) <= 1.25 * 10 * 64


def test_segments_are_merged_and_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tracemill.plans.id_index.FANOUT", 3)
    store = EventStore(spark, str(tmp_path / "store"), leaf_ids=4)
    for number in range(6):
        assert store.append(frame(spark, record(number), record(max(0, number - 1)))).written == 1
    contents = store._contents(0)
    assert len(contents.batches) == 6 and len(contents.segments) < 5 and store.head() == 6
    # A batch written again after its ids were merged: what it no longer holds may be stored again.
    assert store.append(frame(spark, record(100)), batch_id=3).written == 1
    assert store.append(frame(spark, record(3), record(4))).written == 1
    assert sorted(int(r.event_id, 16) for r in store.read().where("event_id < repeat('1', 64)").collect()) == [*range(6), 100]


def test_positions_of_later_batches_read_no_earlier_one(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    for number in range(3):
        store.append(frame(spark, *[record(number * 100 + i, ts=BASE["ts"].replace(minute=59 - i)) for i in range(10)]))
    got = store.entries(after=14)
    assert [(r.position, int(r.event_id, 16)) for r in got.orderBy("position").collect()] == [
        (p, (p - 1) // 10 * 100 + 9 - (p - 1) % 10) for p in range(15, 31)]
    assert all("/batch_id=0/" not in path for path in got.inputFiles())
    assert "Exchange rangepartitioning" not in got._jdf.queryExecution().toString()


def test_files_are_written_in_order(spark, tmp_path):
    """Records lie in their files by time and id, files of a batch over disjoint ranges."""
    store = EventStore(spark, str(tmp_path / "store"))
    store.append(frame(spark, *[record(i, ts=BASE["ts"].replace(minute=i * 7 % 60)) for i in range(200)]))
    rows = store._rows(list(store._contents(0).batches.values()), 0).orderBy("slot").select("ts", "event_id").collect()
    assert rows == sorted(rows) and len(rows) == 200


def test_log_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tracemill.plans.commits.FOLD_AFTER", 4)
    log = CommitLog(spark, str(tmp_path / "log"), StructType().add("name", "string").add("n", "long"), ["name"])
    for number in range(7):
        assert log.commit([{"name": f"k{number % 3}", "n": number}, {"name": "gone", "n": 0, "live": number % 2 == 0}]) == number + 1
    rows, following = log.read()
    assert following == 8 and log.table.version() == 1
    assert {r.name: r.n for r in rows} == {"k0": 6, "k1": 4, "k2": 5, "gone": 0}
    other = CommitLog(spark, str(tmp_path / "log"), StructType().add("name", "string").add("n", "long"), ["name"])
    assert other.read() == log.read()


def test_rebuild_replaces_and_equals_a_first_ingest(spark, tmp_path):
    store, other = EventStore(spark, str(tmp_path / "a")), EventStore(spark, str(tmp_path / "b"))
    rows = frame(spark, *[record(i) for i in range(20)])
    store.append(frame(spark, record(99)))
    store.rebuild(rows)
    other.append(rows)
    assert record_differences(store.read(), other.read()).isEmpty()
    assert store.head() == 20


def test_positions_are_dense_and_ordered(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k")).repartition(7)
    got = [r.id for r in with_positions(rows, ["k", "id"]).orderBy("position").collect()]
    assert got == sorted(range(1000), key=lambda i: (i % 3, i))
    assert with_positions(rows, ["k", "id"]).agg(F.min("position"), F.max("position")).first() == (1, 1000)


def test_event_lines(spark, tmp_path):
    good = ('{"schema_version":1,"event_id":"%064x","ts":"2026-08-13T12:00:00.5Z","harness":"claude-code",'
            '"session_id":"s","repo":"c0ffee00c0ffee00c0ffee00c0ffee00","kind":"skill","name":"n","source":null,'
            '"invoker":"user","outcome":null,"duration_ms":null,"package":""}')
    lines = [good % 1, "{broken", good % 2, (good % 3).replace('"n"', "5"), "", good % 4]
    (tmp_path / "events.ndjson").write_text("\n".join(lines))
    path = str(tmp_path)
    got = read_event_lines(scan_lines(spark, path, glob="*.ndjson"), list_files(spark, path, "*.ndjson"))
    rows = got.orderBy("chunk", "line").collect()
    # The last line has no newline yet, so it is not complete.
    assert [r.event_id for r in rows] == [f"{1:064x}", f"{2:064x}"]
    assert rows[0].package is None and rows[0].ts.microsecond == 500000
    (tmp_path / "events.ndjson").write_text("\n".join(lines) + "\n")
    got = read_event_lines(scan_lines(spark, path, glob="*.ndjson"), list_files(spark, path, "*.ndjson"))
    assert got.count() == 3


def test_a_batch_that_is_read_again_is_not_copied_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Records of stored files are evaluated by each step, one value of all records crosses no shuffle, and a write gives its files back."""
    rows = [record(i % 900, name=f"n{i % 7}", model="m", package=None if i % 5 else "p", duration_ms=7, ts=BASE["ts"].replace(second=i % 60)) for i in range(1000)]
    frame(spark, *rows, record(5000, name="a/b"), record(5001, repo="x")).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.schema(INVOCATION).parquet(str(tmp_path / "batch"))
    crossed = []
    monkeypatch.setattr("tracemill.plans.store.first_copies", lambda valid, *given: (crossed.append(set(valid.columns)), first_copies(valid, *given))[1])
    folders = SparkContextFiles(spark)
    store = EventStore(spark, str(tmp_path / "store"))
    before = folders.shuffles()
    done = store.append(batch, stage=lazy)
    assert (done.written, done.duplicate, done.dropped) == (900, 100, 2)
    again = store.append(batch, stage=lazy)
    assert (again.written, again.duplicate, again.dropped) == (0, 1000, 2)
    assert crossed == [{"event_id", "ts", "name", "package"}] * 2
    want = {}
    for row in sorted(rows, key=lambda r: (r[2], r[8], r[9] is not None, r[9] or "")):
        want.setdefault(row[1], row)
    kept = [c for c in INVOCATION.fieldNames() if c != "ts"]
    assert sorted(str(tuple(r)) for r in store.read().select(kept).collect()) == sorted(str((*w[:2], *w[3:])) for w in want.values())
    for _ in range(50):
        if folders.shuffles() <= before:
            break
        time.sleep(0.1)
    assert folders.shuffles() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


class SparkContextFiles:
    def __init__(self, spark):
        self.disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles(self):
        return self.disk.getAllFiles().mkString("\n").count("/shuffle_")


def test_stores_are_compared_part_by_part(spark, tmp_path):
    """Records meet in a shuffle only in the parts that differ, and copies, NULLs and swapped values are told apart."""
    left = frame(spark, *[record(i) for i in range(3000)])
    same = record_differences(left, left.repartition(3))
    assert "Exchange" not in same._jdf.queryExecution().executedPlan().toString() and same.isEmpty()
    one = record_differences(left, left.where(F.col("event_id") != f"{7:064x}"))
    read = one._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64" in read and [(int(r.event_id, 16), r.side) for r in one.collect()] == [(7, "left")]
    cases = [
        ([record(1), record(1)], [record(1)], ["left"]),
        ([record(1), record(1)], [record(2), record(2)], ["left", "left", "right", "right"]),
        ([record(1, package="a")], [record(1, package_version="a")], ["left", "right"]),
        ([record(1, package="")], [record(1)], ["left", "right"]),
        ([record(1, name="a", session_id="b")], [record(1, name="b", session_id="a")], ["left", "right"]),
        ([record(1), record(2)], [record(2), record(1)], []),
        ([record(1, duration_ms=1), record(1, duration_ms=4)], [record(1, duration_ms=2), record(1, duration_ms=3)], ["left", "left", "right", "right"]),
    ]
    for a, b, want in cases:
        assert sorted(r.side for r in record_differences(frame(spark, *a), frame(spark, *b)).collect()) == want, (a, b)
