"""Ingest from files and incremental collection: both end at the same records."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from tests.support import CALL_AT, CLOSED, HOUR, NAME_KEY, REPO, SALT, consent_rows
from tests.test_transcripts import OK_RESULT, OPEN_CALL, SYNTAX, end_turn, entry, result, use
from tracemill.operators.sessions import Staleness
from tracemill.plans.derive import DeriveOptions
from tracemill.plans.health import ScanHealth
from tracemill.plans.ingest import ingest
from tracemill.plans.inventory import UsageSnapshots
from tracemill.plans.jobs import discover, doctor, report
from tracemill.plans.store import EventStore, record_differences
from tracemill.sources.lines import list_files
from tracemill.streaming.collect import FEED, Collector, collect_available, run_until_closed

TRANSCRIPTS = {
    "pair": [OPEN_CALL, OK_RESULT],
    "early": [OK_RESULT.replace("line-2", "line-8"), entry("line-7", content=[use()])],
    "silent": [entry("line-3", content=[use("call-9")])],
    "blind": [entry("line-4", content=[use("call-4")]), SYNTAX],
    "run": [end_turn("line-5"), end_turn("line-6", 3)],
    # A copy of another file: the same event ids, so nothing new.
    "copy": [OPEN_CALL, OK_RESULT],
}


def test_ingest_rebuild_and_counters(spark, tmp_path):
    home = tmp_path / "projects"
    for name, lines in TRANSCRIPTS.items():
        (home / name).mkdir(parents=True)
        (home / name / "session.jsonl").write_text("".join(line + "\n" for line in lines))
    (home / "empty.jsonl").write_text("")
    consent = consent_rows(spark, (REPO, "/repo"))
    options = DeriveOptions(SALT, NAME_KEY, CLOSED)
    health = ScanHealth(spark, str(tmp_path / "health"))
    store = EventStore(spark, str(tmp_path / "store"))
    report = ingest(spark, str(home), consent, store, options, health=health)
    assert (report.append.written, report.append.duplicate, report.append.dropped) == (4, 1, 0)
    counters = health.current().first()
    assert (counters.transcripts, counters.unreadable, counters.parse_errors, counters.events_written) == (7, 0, 1, 4)
    assert (counters.pending_calls, counters.interrupted_calls, counters.ambiguous_skill_runs, counters.skipped) == (1, 1, 1, 2)
    assert health.diagnose().first().state == "collects nothing"
    cursors = {r.file.split("/")[-2]: (r.open_sessions, r.cursor_floor) for r in report.cursors.collect()}
    assert cursors["pair"] == (0, 0) and cursors["blind"] == (1, 0)

    again = ingest(spark, str(home), consent, store, options)
    assert (again.append.written, again.append.duplicate) == (0, 5)
    before = store.read().collect()
    ingest(spark, str(home), consent, store, options, rebuild=True)
    rebuilt = store.read()
    assert record_differences(rebuilt, spark.createDataFrame(before, rebuilt.schema)).isEmpty()


def test_collection_in_pieces_equals_one_ingest(spark, tmp_path):
    rows = []
    for name, lines in TRANSCRIPTS.items():
        offset = 0
        for number, line in enumerate(lines):
            rows.append((number, name, offset, line))
            offset += len(line.encode()) + 1
    for number in (1, 0):
        piece = [(f, o, v) for n, f, o, v in rows if n == number]
        spark.createDataFrame(piece, FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    store = EventStore(spark, str(tmp_path / "store"))
    options = DeriveOptions(SALT, NAME_KEY, Staleness(HOUR))
    now = [CALL_AT + timedelta(minutes=5)]
    collector = Collector(spark, str(tmp_path / "landing"), store, consent_rows(spark, (REPO, "/repo")), options, clock=lambda: now[0])
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    collect_available(collector.stream(feed, str(tmp_path / "checkpoint")))
    assert sorted(r.outcome for r in store.read().collect()) == ["ok", "ok"]
    # A replayed micro-batch changes nothing.
    piece = spark.createDataFrame([(f, o, v) for n, f, o, v in rows if n == 0], FEED)
    collector.process(piece, 1)
    assert store.head() == 2
    assert {r.file: r.open_sessions for r in collector.cursors().collect()}["pair"] == 1

    now[0] = CALL_AT + 8 * HOUR
    assert collector.sweep().written == 2
    assert sorted(str(r.outcome) for r in store.read().collect()) == ["None", "interrupted", "ok", "ok"]
    # A result that comes after its call ended as interrupted is dropped.
    late = entry("line-9", 30, content=[result("call-9", is_error=False)])
    assert collector.process(spark.createDataFrame([("silent", 1000, late)], FEED), 2).written == 0
    assert store.head() == 4


def test_file_read_in_part_counts_once_and_gives_nothing(spark, tmp_path, monkeypatch):
    home = tmp_path / "projects"
    for name, lines in TRANSCRIPTS.items():
        (home / name).mkdir(parents=True)
        (home / name / "session.jsonl").write_text("".join(line + "\n" for line in lines))
    listed = list_files

    def longer(session, path, glob="*.jsonl"):
        """The listing of files whose tail could not be read."""
        cut = F.col("file").rlike("/(silent|run)/").cast("bigint")
        return listed(session, path, glob).withColumn("length", F.col("length") + cut * 100)

    monkeypatch.setattr("tracemill.plans.ingest.list_files", longer)
    store = EventStore(spark, str(tmp_path / "store"))
    report = ingest(spark, str(home), consent_rows(spark, (REPO, "/repo")), store, DeriveOptions(SALT, NAME_KEY, CLOSED))
    files = {r.file.split("/")[-2]: r for r in report.files.collect()}
    assert {n for n, r in files.items() if r.failed} == {"silent", "run"}
    for name in ("silent", "run"):
        r = files[name]
        assert (r.parse_errors, r.parsed, r.interrupted_calls, r.pending_calls, r.skipped, r.unreadable) == (1, 0, 0, 0, False, False)
    assert sorted(r.outcome for r in store.read().collect()) == ["ok", "ok"]
    # Read whole later, its records come.
    monkeypatch.undo()
    again = ingest(spark, str(home), consent_rows(spark, (REPO, "/repo")), store, DeriveOptions(SALT, NAME_KEY, CLOSED))
    assert again.append.written == 2


def test_silence_becomes_a_record(spark, tmp_path):
    """A session that falls silent ends its call without any new line."""
    rows = [("silent", 0, entry("line-3", content=[use("call-9")])), ("pair", 0, OPEN_CALL), ("pair", 500, OK_RESULT)]
    spark.createDataFrame(rows, FEED).coalesce(1).write.parquet(str(tmp_path / "feed"))
    store = EventStore(spark, str(tmp_path / "store"))
    before, after = (lambda: CALL_AT), (lambda: CALL_AT + 8 * HOUR)
    options = DeriveOptions(SALT, NAME_KEY, Staleness(HOUR))
    collector = Collector(spark, str(tmp_path / "landing"), store, consent_rows(spark, (REPO, "/repo")), options, clock=before)
    feed = spark.readStream.schema(FEED).parquet(str(tmp_path / "feed"))
    collect_available(collector.stream(feed, str(tmp_path / "checkpoint")))
    assert [r.outcome for r in store.read().collect()] == ["ok"]
    collector.clock = after
    run_until_closed(collector.closing_stream(feed, str(tmp_path / "closing"), HOUR))
    assert sorted(r.outcome for r in store.read().collect()) == ["interrupted", "ok"]


def test_late_result_changes_nothing_and_retention_forgets(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    now = [CALL_AT + timedelta(minutes=5)]
    collector = Collector(spark, str(tmp_path / "landing"), store, consent_rows(spark, (REPO, "/repo")),
                          DeriveOptions(SALT, NAME_KEY, Staleness(HOUR)), clock=lambda: now[0])
    feed = lambda *rows: spark.createDataFrame(list(rows), FEED)
    silent = [("silent", 0, entry("line-3", content=[use("call-9")])), ("silent", 400, entry("line-31", content=[result("other")]))]
    assert collector.process(feed(*silent, ("run", 0, end_turn("line-5")), ("run", 700, end_turn("line-6", 3))), 0).written == 0
    assert {(r.kind, r.file, r.tag) for r in collector.state_rows().collect()} == {
        ("call", "silent", "use"), ("call", "silent", "result"), ("session", "silent", None), ("session", "run", None), ("run", "run", None)}
    assert {r.file: (r.open_sessions, r.cursor_floor) for r in collector.cursors().collect()} == {"silent": (1, 0), "run": (1, 0)}
    # A call and its result in different micro-batches, whichever comes first.
    assert collector.process(feed(("early", 500, OK_RESULT)), 1).written == 0
    assert collector.process(feed(("early", 0, OPEN_CALL)), 2).written == 1
    now[0] = CALL_AT + 8 * HOUR
    assert collector.sweep().written == 2 and collector.sweep() .written == 0
    late = feed(("silent", 1000, entry("line-9", 30, content=[result("call-9", is_error=False)])))
    assert collector.process(late, 3).written == 0
    assert sorted(str(r.outcome) for r in store.read().collect()) == ["None", "interrupted", "ok"]
    kept = collector.state_rows().count()
    floors = {r.file: r.open_sessions for r in collector.retain().collect()}
    assert floors == {"silent": 0, "run": 0, "early": 0} and collector.state_rows().count() == 0 < kept
    # Epochs that were merged are left alone, later ones go on.
    assert collector.process(late, 3).written == 0 and collector.process(feed(*silent), 2).written == 0
    assert collector.state_rows().count() == 0 and store.head() == 3


def test_transcripts_are_read_once_for_ingest_and_discovery(spark, tmp_path):
    home = tmp_path / "home"
    (home / "projects").mkdir(parents=True)
    listing = json.dumps({"cwd": "/repo", "attachment": {"type": "skill_listing", "content": "x\n- anchor: holds\n- bad"}})
    away = json.dumps({"cwd": "/away", "attachment": {"type": "mcp_instructions_delta", "addedNames": ["buoy"]}})
    wrong = json.dumps({"cwd": "/repo", "attachment": {"type": "mcp_instructions_delta", "addedNames": [5]}})
    (home / "projects" / "s.jsonl").write_text("\n".join([OPEN_CALL, listing, away, wrong, OK_RESULT, ""]))
    roots = spark.createDataFrame([("/repo",)], "root string")
    store = EventStore(spark, str(tmp_path / "store"))
    done = ingest(spark, str(home / "projects"), consent_rows(spark, (REPO, "/repo")), store, DeriveOptions(SALT, NAME_KEY, CLOSED), announced=True)
    assert done.append.written == 1
    found = discover(spark, str(home), roots, NAME_KEY, announced=done.announced)
    assert [(r.kind, r.name) for r in found.primitives.collect()] == [("skill", "anchor")]
    assert "Scan text" not in found.primitives._jdf.queryExecution().toString()
    assert {tuple(r) for r in discover(spark, str(home), roots, NAME_KEY).primitives.collect()} == {tuple(r) for r in found.primitives.collect()}


def test_discovery_report_and_doctor(spark, tmp_path):
    home, repo = tmp_path / "home", tmp_path / "repo"
    for path, text in {
        home / "skills" / "anchor" / "SKILL.md": "", home / "settings.json": '{"mcpServers":{"buoy":{}}}',
        repo / ".claude" / "commands" / "reef.md": "", repo / ".mcp.json": '{"mcpServers":{"tide":{}}}',
        home / "projects" / "p" / "s.jsonl": entry("line-1", cwd=str(repo), content=[use(name="Skill", skill="anchor")]) + "\n"
        + OK_RESULT.replace('"cwd": "/repo"', f'"cwd": "{repo}"') + "\n",
    }.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    store, snapshots = EventStore(spark, str(tmp_path / "store")), UsageSnapshots(spark, str(tmp_path / "snapshots"))
    health = ScanHealth(spark, str(tmp_path / "health"))
    roots = spark.createDataFrame([(str(repo),)], "root string")
    found = discover(spark, str(home), roots, NAME_KEY)
    assert {(r.kind, r.name) for r in found.primitives.collect()} == {
        ("skill", "anchor"), ("mcp_server", "buoy"), ("command", "reef"), ("mcp_server", "tide")}
    assert {r.name for r in discover(spark, str(home), None, NAME_KEY).primitives.collect()} == {"anchor", "buoy"}
    report(store, snapshots, found)
    ingest(spark, str(home / "projects"), consent_rows(spark, (REPO, str(repo))), store, DeriveOptions(SALT, NAME_KEY, CLOSED),
           health=health, snapshots=snapshots)
    # The ingest refreshed the counters of the names that discovery had published.
    assert {r.name: r.invocations for r in snapshots.read().collect()} == {"anchor": 1, "buoy": 0, "reef": 0, "tide": 0}
    made = report(store, snapshots)
    assert [(r.name, r.calls) for r in made.used.collect()] == [("anchor", 1)]
    assert {r.name for r in made.unused.collect()} == {"buoy", "reef", "tide"}
    assert made.unused_by_kind.collect()[-1].unused == 3
    row = doctor(health, 2).first()
    assert (row.state, row.transcripts, row.events_written, row.installed) == ("collecting", 1, 1, 2)
    assert doctor(health, None).first().state == "hooks unreadable"
