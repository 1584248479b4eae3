"""Plans whose cost must follow the input: no table through the driver, no table in one task."""

import math
from pathlib import Path

from pyspark.sql import functions as F

from tracemill import session
from tracemill.operators import pairing
from tracemill.operators.validation import first_copies
from tracemill.plans.inventory import catalog_usage
from tracemill.plans.marts import used_primitives
from tracemill.plans.store import record_differences
from tracemill.schemas import INVOCATION
from tracemill.session import ROWS_A_FILE, materialize
from tracemill.sources.catalog_files import listed_primitives
from tracemill.sources.folders import write_files
from tracemill.sources.lines import feed_lines, frame, scan_lines
from tracemill.sources.transcripts import decode_entries
from tracemill.streaming.collect import FEED, Collector
from tracemill.workbook import QUERIES, streams
from tracemill.workbook.catalog import PARTS_A_TASK, part_catalog
from tracemill.workbook.transcripts import event_feed


def test_catalog_meets_its_usage_without_a_broadcast(spark, tmp_path):
    """A few listed rows that become many look small, yet neither side of a report goes through the driver."""
    spark.range(10).write.parquet(f"{tmp_path}/listed")
    many = spark.read.parquet(f"{tmp_path}/listed").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(9))))
    listed = many.select(F.lit("shop").alias("harness"), F.lit("skill").alias("kind"), F.concat(F.lit("p"), "id", F.lit("g"), "g").alias("name"))
    usage = listed.groupBy("harness", "kind", "name").agg(
        F.count("*").alias("invocations"), F.lit(0).alias("failures"), F.lit(0).alias("unknown"), F.lit("2024-01-01").cast("timestamp").alias("last_used"))
    report = used_primitives(catalog_usage(listed, usage))
    assert "Broadcast" not in report._jdf.queryExecution().executedPlan().toString()
    assert report.count() == 100


def test_catalog_usage_of_repeated_unlisted_and_null_rows(spark):
    listed = spark.createDataFrame(
        [("h", "skill", "a"), ("h", "skill", "a"), ("h", "skill", "b"), ("h", "builtin_tool", "a"), (None, "skill", "a"), ("h", "skill", None)],
        "harness string, kind string, name string")
    usage = spark.createDataFrame([("h", "skill", "a", 3, 1, 1), ("h", "skill", "other", 9, 0, 0), (None, "skill", "a", 5, 0, 0)],
                                  "harness string, kind string, name string, invocations bigint, failures bigint, unknown bigint"
                                  ).withColumn("last_used", F.lit("2024-01-01").cast("timestamp"))
    got = catalog_usage(listed, usage)
    assert got.columns == ["harness", "kind", "name", "invocations", "failures", "unknown", "last_used"]
    assert sorted(tuple(r)[1:6] for r in got.collect()) == [("skill", "a", 3, 1, 1), ("skill", "b", 0, 0, 0)]

def test_parts_of_one_small_file_are_listed_by_many_tasks(spark):
    parts = spark.range(3 * PARTS_A_TASK).select(F.col("id").alias("p_partkey")).coalesce(1)
    listed = part_catalog(parts)
    assert listed.rdd.getNumPartitions() == math.ceil(parts.count() / PARTS_A_TASK)
    assert listed.select("name").distinct().count() == parts.count() * 25


def test_differences_of_two_stores_meet_in_one_shuffle(spark):
    def rows(*ids):
        return spark.createDataFrame([(i,) for i in ids], "event_id string").select(
            *[F.col(f.name) if f.name == "event_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in INVOCATION.fields])

    found = record_differences(rows("a", "a", "a", "b", "X"), rows("a", "b", "b", "x"))
    assert sorted((r.event_id, r.side) for r in found.collect()) == [("X", "left"), ("a", "left"), ("a", "left"), ("b", "right"), ("x", "right")]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_records_and_stored_ids_meet_in_one_shuffle(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "held"), ("c", 1, "new"), ("c", 1, "old")], "event_id string, ts int, name string")
    held = spark.createDataFrame([("b",), ("b",), ("z",)], "event_id string")
    new = first_copies(rows, ["ts"], held)
    assert sorted(tuple(r) for r in new.collect()) == [("a", 1, "first"), ("c", 1, "new")]
    assert new.columns == rows.columns and "Join" not in new._jdf.queryExecution().optimizedPlan().toString()


def test_scratch_tables_have_files_of_bounded_rows(spark):
    table = materialize(spark.range(2 * ROWS_A_FILE + 1).coalesce(1))
    assert len(table.inputFiles()) == 3 and table.count() == 2 * ROWS_A_FILE + 1


def test_lines_of_a_feed_are_dealt_out_evenly(spark):
    """Files cut from one task are full but for the last; those of a feed hold about the same number of lines."""
    n = ROWS_A_FILE
    events = spark.range(n).coalesce(1).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), (F.col("id") % 50).alias("user_id"),
        F.when(F.col("id") % 10 == 0, "view").otherwise("signup").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    sizes = [r["count"] for r in event_feed(events).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 2 and max(sizes) - min(sizes) < 100


def test_a_lump_of_lines_is_dealt_out_before_it_is_parsed(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_FILE", 100)
    lump = spark.range(2000, numPartitions=1)
    dealt = session.evened(lump)
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 200
    assert dealt.distinct().count() == 2000
    # Even tasks, and few rows, stay as they are.
    even, few = spark.range(2000, numPartitions=8), spark.range(90, numPartitions=1)
    assert session.evened(even) is even and session.evened(few) is few and session.evened(few.where("id < 0")).isEmpty()


def test_refused_calls_are_settled_without_a_fold(spark, monkeypatch):
    """(line, tag) of one id each, and what is left: only a result behind every refused call waits."""
    cases = {
        "a": ([(1, "void"), (2, "result")], 2), "b": ([(1, "result"), (2, "void")], None), "c": ([(1, "void")], None),
        "d": ([(1, "void"), (2, "result"), (3, "void")], None), "e": ([(1, "void"), (2, "void"), (3, "result")], 3), "f": ([(1, "result")], 1),
        "g": ([(None, "result"), (1, "void")], None), "h": ([(None, "void"), (1, "result")], 1),
    }
    rows = [("f", i, (0 if line else None, line, 0), tag, None, (line,) if tag == "result" else None)
            for i, (events, _) in cases.items() for line, tag in events]
    events = spark.createDataFrame(rows, f"file string, call_id string, pos {pairing.POSITION_TYPE}, tag string, "
                                         "call struct<event_id: int>, result struct<at: int>")

    def left(carried):
        assert carried.pairs.isEmpty()
        return {r.call_id: r.result.at for r in carried.left.collect() if r.tag == "result"}

    want = {i: line for i, (_, line) in cases.items() if line}
    ends = pairing.fold_short(events).ends.where("state = 2").collect()
    assert {r.call_id: r.held.result.at for r in ends} == want

    def never(*_):
        raise AssertionError("folded")

    monkeypatch.setattr(pairing, "_fold_by_size", never)
    assert left(pairing.carry_calls(events, session.materialize)) == want


def test_micro_batches_are_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """A feed whose lines pack into one row group still comes as three micro-batches of many tasks."""
    epochs = []
    process = Collector.process

    def counted(self, feed, epoch):
        epochs.append(feed.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first())
        return process(self, feed, epoch)

    monkeypatch.setattr(streams, "ROWS_A_FILE", 40)
    monkeypatch.setattr(Collector, "process", counted)
    events = spark.range(300).selectExpr(
        "id as event_id", "timestamp_ntz '2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "id % 7 as user_id",
        "'click' as event_type", "cast(100 as double) as value", "'{\"k\": 5}' as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = QUERIES["incremental_collection"](spark, str(tmp_path))
        assert got.count() == 300 and len(epochs) == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = sum(n for _, n in epochs)
    assert lines == 300 + 285 + 15 and max(n for n, _ in epochs) < lines / 4


def test_only_the_named_members_of_a_line_are_built(spark):
    """Members are read straight from the text, and give the verdicts that a parse of the whole line gives."""
    own = '"uuid":"u","sessionId":"s","timestamp":"2024-01-01T00:00:00Z"'
    blind, fine = ("malformed", "blind"), ("entry", None)
    verdicts = {
        "{%s}" % own: fine, " {%s} " % own: fine, "{%s}}" % own: blind, '{%s},{"uuid":"v"}' % own: blind, "": blind,
        '{%s},{"end-of-document":true}' % own: blind, '{%s},{"end-of-document":true}] x' % own: blind, '{%s,"q":"end-of-document"}' % own: fine,
        "null": ("malformed", "bookkeeping"), "5": ("malformed", "bookkeeping"), "[]": ("malformed", "bookkeeping"),
        "{'uuid':'u'}": blind, '{%s,"q":NaN}' % own: blind, '{%s,"q":1e400}' % own: fine, '{%s,"uuid":5}' % own: ("malformed", "mistyped"),
        '{%s,"message":5}' % own: ("malformed", "mistyped"), '{%s,"message":{"content":[]},"message":5}' % own: ("malformed", "mistyped"),
        '{%s,"message":{"content":[null,{"type":"tool_use","id":"c"}]}}' % own: fine,
        '{%s,"message":{"content":["x",{"type":"tool_use","id":"c"}]}}' % own: ("malformed", "mistyped"),
        '{%s,"message":{"content":[{"type":"tool_use","input":"x"}]}}' % own: ("malformed", "mistyped"),
        '{%s,"message":{"content":[{"type":"tool_use","input":{"skill":5}}]}}' % own: ("malformed", "mistyped"),
        '{%s,"toolUseResult":"x"}' % own: fine,
    }
    feed = spark.createDataFrame([("f", i, line) for i, line in enumerate(verdicts)], FEED)
    entries = decode_entries(feed_lines(feed))
    assert [(r.status, r.malformed_reason) for r in entries.orderBy("offset").collect()] == list(verdicts.values())
    plan = entries._jdf.queryExecution().executedPlan().toString()
    # One generator keeps later conditions from parsing a line again; more would interpret what they hold.
    assert plan.count("from_json") == 1 and plan.count("Generate ") == 1


def test_a_listing_is_read_once_for_all_its_names(spark):
    """The names of a listing come from the members that the decode reads anyway; no text is parsed again, and none for each name."""
    def line(attachment, cwd='"cwd":"/repo",'):
        return '{%s"uuid":"u","sessionId":"s","timestamp":"2024-01-01T00:00:00Z","attachment":%s}' % (cwd, attachment)

    def told(kind, *names, cwd="/repo"):
        return [(cwd, kind, n) for n in names]

    agents = '{"type":"agent_listing_delta","addedTypes":%s}'
    many = [f"n{i}" for i in range(2000)]
    cases = {
        line('{"type":"skill_listing","content":"x\\n- a: b: c\\n- d:e\\n-f: g\\n- h: "}'): told("skill", "a", "h"),
        line('{"type":"skill_listing","content":"- a: b\\r\\n- \\r: c\\n- : d\\n\\n - e: f\\n- \u2028- g: h: - i: j"}'): told("skill", "a", "\r", "", "\u2028- g"),
        line('{"type":"skill_listing","content":""}'): [], line('{"type":"skill_listing"}'): None,
        line(agents % str(many).replace("'", '"')): told("subagent", *many), line(agents % '["a",null,"a"]'): told("subagent", "a", "", "a"),
        line(agents % "[]"): [], line(agents % "null"): None, line(agents % '["a",5]'): None, line(agents % '["a",["b"]]'): None,
        line(agents % '"a"'): None, line(agents % "[null]"): told("subagent", ""), line(agents % '["a"]', cwd=""): told("subagent", "a", cwd=""),
        line(agents % '["a"]', cwd='"cwd":5,'): None, line(agents % '["a"]', cwd='"cwd":null,'): told("subagent", "a", cwd=""),
        line('{"type":"mcp_instructions_delta","addedNames":["m"],"addedTypes":["t"]}'): told("mcp_server", "m"),
        line('{"type":"mcp_instructions_delta","addedNames":["m"],"addedTypes":[5]}'): None,
        line('{"type":"other","content":"- a: b"}'): None, line('{"type":5,"content":"- a: b"}'): None, line('"attachment"'): None, line("null"): None,
        line(agents % '["a"]') + "}": None, "attachment": None, '["attachment"]': None, line(agents % '["a"],"q":"end-of-document"'): told("subagent", "a"),
    }
    feed = spark.createDataFrame([("f", i, text) for i, text in enumerate(cases)], FEED)
    entries = decode_entries(feed_lines(feed), announced=True)
    got = [r.announced and [tuple(x) for x in r.announced] for r in entries.orderBy("offset").collect()]
    assert got == list(cases.values())
    assert entries.drop("announced").collect() == decode_entries(feed_lines(feed)).collect()
    names = {n for want in cases.values() for n in want or []}
    listed = listed_primitives(frame(feed.select("file", F.lit(0).alias("chunk"), F.col("offset").alias("line"), F.lit(0).alias("nbytes"), "value")),
                               spark.createDataFrame([("/repo",)], "root string"))
    assert {tuple(r) for r in listed.collect()} == {(kind, name) for cwd, kind, name in names if cwd}

    def parses(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")

    assert parses(entries) == parses(decode_entries(feed_lines(feed)))


def test_many_transcripts_are_written_in_place_and_listed_by_few_tasks(spark, tmp_path):
    """No task is started for each folder, and no file is copied, checked or moved; the text is that of the feed."""
    n = 9000
    events = spark.range(n).selectExpr(
        "id as event_id", "timestamp_ntz '2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "if(id < 6000, 1, if(id = 6000, null, id)) as user_id",
        "'click' as event_type", "cast(100 as double) as value", "'{\"k\": 5}' as props")
    path = streams.write_transcripts(spark, events)
    root = Path(path.removeprefix("file:"))
    names = {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()}
    want = {}
    for row in event_feed(events).orderBy("offset").collect():
        want.setdefault(f"file={row.file or '__HIVE_DEFAULT_PARTITION__'}/part.txt", []).append(row.value)
    assert names == set(want) and len(names) > 1000
    assert all((root / name).read_text() == "".join(f"{v}\n" for v in lines) for name, lines in want.items())
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        lines = scan_lines(spark, path, glob="*.txt")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert lines.count() == sum(map(len, want.values()))


def test_lines_are_written_as_they_come(spark, tmp_path, monkeypatch):
    """A long file is written piece by piece, an absent value is an empty line, and writing again changes nothing."""
    monkeypatch.setattr("tracemill.sources.folders.FRAME_ENTRIES", 7)
    rows = [(f"a/f{i // 100}.txt", None if i % 10 == 0 else f"line {i} é") for i in range(250)]
    lines = spark.createDataFrame(rows, "path string, value string").coalesce(1)
    for _ in range(2):
        assert write_files(lines, str(tmp_path)) == 3
    text = "".join((tmp_path / "a" / f"f{i}.txt").read_text() for i in range(3))
    assert text == "".join(f"{value or ''}\n" for _, value in rows)
    assert write_files(lines.limit(0), str(tmp_path / "none")) == 0
