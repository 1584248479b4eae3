"""Consent, pairing of reused ids, offsets, catalog, marts and counters on small data."""

import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.hostile import not_names, not_scoped
from tests.support import SALT, consent_rows
from tracemill.functions.domains import derived_name
from tracemill.functions.paths import clean_absolute
from tracemill.operators.consent import resolve_directories
from tracemill.operators.pairing import BLOCK_EVENTS, call_events, pair_calls
from tracemill.operators.sessions import with_line_offsets
from tracemill.operators.usage import summary, usage_by_provenance
from tracemill.plans.health import InvalidCounters, ScanHealth, integration_state
from tracemill.plans.inventory import InvalidSnapshot, UsageSnapshots, catalog
from tracemill.plans.marts import one_decimal, overview, unused_overview
from tracemill.schemas import COUNTER_NAMES, INVOCATION, USAGE_SNAPSHOT
from tracemill.session import lazy, materialize
from tracemill.sources.catalog_files import (
    list_documents, listed_primitives, mcp_documents, mcp_servers, plugin_paths, primitives_in_layout,
)
from tracemill.sources.consent_table import Signing, consented, parse_consent, refused_count, trusted_consent
from tracemill.sources.folders import list_folder, read_documents
from tracemill.sources.lines import list_files, scan_lines

UTC = timezone.utc


def mac(message, key=SALT):
    return hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


# --- names and paths ------------------------------------------------------------------

def test_derived_names(spark):
    key = b"key of the harbour"
    digest = mac("docks/east", key)[:12]
    own = f"scope-{digest}:launch"
    cases = {"docks/east:launch": own, "\u2003docks/east:launch ": own, "tide-check": "tide-check", "crew:watch": "crew:watch",
             # What already looks like a digest is refused; what only resembles one is a plain name.
             own: None, "scope-east:launch": "scope-east:launch", f"scope-{digest}": f"scope-{digest}", "scopes:launch": "scopes:launch"}
    cases.update(dict.fromkeys(not_scoped("docks", "east"), None))
    cases.update({v: None for v in not_names("docks", "east") if "/" not in v and v == v.strip()})
    cases["/".join(["w" * 62, "x" * 62]) + ":launch"] = None
    rows = spark.createDataFrame([(v,) for v in cases], "v string")
    got = {r.v: r.n for r in rows.select("v", derived_name(F.col("v"), key).alias("n")).collect()}
    assert got == cases
    keyless = {r.v: r.n for r in rows.select("v", derived_name(F.col("v"), None).alias("n")).collect()}
    assert keyless["docks/east:launch"] is None and keyless["tide-check"] == "tide-check"


def test_clean_paths(spark):
    cases = {"/a//b/./c/": "/a/b/c", "/a/../b": "/b", "/../..": "/", "/": "/", "a/b": None, "/a/b/../../..": "/", "": None}
    rows = spark.createDataFrame([(v,) for v in cases], "v string")
    assert {r.v: r.c for r in rows.select("v", clean_absolute(F.col("v")).alias("c")).collect()} == cases


def under(root, path):
    return path == root or path.startswith(root.rstrip("/") + "/")


def test_prefix_rule(spark):
    """Every root against every directory, with and without case, by the plain definition."""
    roots = ["/", "/mole", "/mole/pier", "/Mole", "/mole/Pier", "/quay"]
    cwds = [*roots, "/mole/pier/nine", "/molex", "/mole-pier", "/MOLE/PIER", "/mole/pier.d", "quay/x"]
    rows = spark.createDataFrame([(c,) for c in cwds], "cwd string")
    for root in roots:
        for fold in (False, True):
            consent = consent_rows(spark, ("1" * 32, root, None, None, fold))
            got = {r.cwd: r.matched for r in resolve_directories(rows, consent, SALT).collect()}
            case = str.lower if fold else str
            assert got == {c: c.startswith("/") and under(case(root), case(c)) for c in cwds}, (root, fold)


def test_longest_root_wins(spark):
    consent = consent_rows(spark, ("1" * 32, "/w"), ("2" * 32, "/w/deep", None, ["/alias"]), ("3" * 32, "/w/deep/er"))
    cwds = spark.createDataFrame([(c,) for c in ("/w/x", "/w/deep/x", "/w/deep/er", "/alias/y", "/none")], "cwd string")
    got = {r.cwd: r.repo for r in resolve_directories(cwds, consent, SALT).collect()}
    assert got == {"/w/x": "1" * 32, "/w/deep/x": "2" * 32, "/w/deep/er": "3" * 32, "/alias/y": "2" * 32,
                   "/none": mac("/none")[:32]}


def test_consent_table_trust(spark):
    signing = Signing(SALT, "label/v1")

    def entry(root, bound="", fold=False, aliases=(), sign_bound=True, **over):
        text = "label/v1\0" + ("f" if fold else "") + "\0" + "".join(s + "\0" for s in (root, *aliases))
        row = {"id": mac(root)[:32], "label": "repo", "root": root, "aliases": list(aliases), "case_insensitive": fold,
               "collect_from": bound, "match_mac": mac(text + bound + "\0") if sign_bound else mac(text)}
        return {**row, **over}

    bound = "2026-01-02T03:04:05.5Z"
    entries = [entry("/a"), entry("/b", bound, True, ["/b2"]), entry("/c", sign_bound=False),
               entry("/d", bound, sign_bound=False), entry("/e", case_insensitive=True), entry("/f/"),
               entry("/g", "2026-01-02T03:04:05.50Z"), entry("/h", label="x/y"), entry("/i"), entry("/i"),
               entry("/j", id="0" * 32), entry("/k", aliases=["/l"]), entry("/l")]
    table = spark.createDataFrame([("p", json.dumps({"version": 1, "projects": entries}))], "path string, value string")
    judged = trusted_consent(parse_consent(table), signing)
    verdicts = [r.verdict for r in judged.orderBy("entry").collect()]
    assert verdicts == ["trusted", "trusted", "trusted", "unsigned", "unsigned", "malformed", "malformed", "malformed",
                        "ambiguous", "ambiguous", "unsigned", "ambiguous", "ambiguous"]
    assert refused_count(judged).first()[0] == 10
    kept = consented(judged).where("root = '/b'").first()
    assert kept.collect_from == datetime(2026, 1, 2, 3, 4, 5, 500000)
    newer = spark.createDataFrame([("p", '{"version":2,"projects":[]}')], "path string, value string")
    with pytest.raises(Exception, match="unusable consent table"):
        parse_consent(newer.unionByName(table)).collect()


# --- pairing --------------------------------------------------------------------------

def simulate(events):
    state, held, pairs = "idle", None, []
    for tag, item in events:
        if tag == "use":
            if state == "early":
                pairs.append((item, held))
                state, held = "idle", None
            else:
                state, held = "waiting", item
        elif tag == "void":
            if state == "early":
                state, held = "idle", None
        elif state == "waiting":
            pairs.append((held, item))
            state, held = "idle", None
        elif state == "idle":
            state, held = "early", item
    if state == "waiting":
        pairs.append((held, None))
    return sorted(pairs)


@pytest.mark.parametrize("stage", [lazy, materialize])
def test_pairing_equals_a_sequential_walk(spark, stage):
    """Random sequences over many chunks; one id holds a third of all events."""
    rng = random.Random(7)
    sequences = {f"id-{i}": rng.randint(1, 9) for i in range(300)} | {"hot": 700}
    uses, results, expected = [], [], {}
    for call_id, length in sequences.items():
        events = []
        for position in range(length):
            tag = rng.choice(["use", "use", "result", "result", "void"])
            place = ("f", call_id, position // 11, position, 0)
            if tag == "result":
                results.append((*place, (position,)))
            else:
                uses.append((*place, "accepted" if tag == "use" else "refused", (position,)))
            events.append((tag, position))
        expected[call_id] = simulate(events)
    keys = "file string, call_id string, chunk bigint, line bigint, block int"
    calls = spark.createDataFrame(uses, f"{keys}, status string, call struct<n: bigint>")
    answers = spark.createDataFrame(results, f"{keys}, result struct<n: bigint>")
    got = {call_id: [] for call_id in sequences}
    for row in pair_calls(call_events(calls, answers), stage).collect():
        got[row.call_id].append((row.call.n, row.result and row.result.n))
        assert row.call_pos.line == row.call.n
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in expected.items()}


def test_short_ids_are_folded_in_one_step(spark):
    """Reused ids of one block at most need one staged table; one event more takes the blocks, with the same pairs."""
    rng, keys = random.Random(8), "file string, call_id string, chunk bigint, line bigint, block int"

    def run(lengths):
        uses, results, expected, labels = [], [], {}, []
        for call_id, length in lengths.items():
            tags = ["use", "use", *rng.choices(["use", "result", "void"], k=length - 2)]
            for position, tag in enumerate(tags):
                place = ("f", call_id, position // 11, position, 0)
                if tag == "result":
                    results.append((*place, (position,)))
                else:
                    uses.append((*place, "accepted" if tag == "use" else "refused", (position,)))
            expected[call_id] = simulate([(tag, position) for position, tag in enumerate(tags)])

        def stage(df, label):
            labels.append(label)
            return materialize(df, label)

        calls = spark.createDataFrame(uses, f"{keys}, status string, call struct<n: bigint>")
        answers = spark.createDataFrame(results, f"{keys}, result struct<n: bigint>")
        got = {call_id: [] for call_id in lengths}
        for row in pair_calls(call_events(calls, answers), stage).collect():
            got[row.call_id].append((row.call.n, row.result and row.result.n))
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in expected.items()}
        return labels

    short = {"a": 40, "b": BLOCK_EVENTS - 1, "c": BLOCK_EVENTS}
    assert run(short) == ["calls-by-id", "reused-calls"]
    assert "reused-states" in run(short | {"d": BLOCK_EVENTS + 1})


def test_events_without_chunk_pair_alike_in_short_and_long_ids(spark):
    """A pair completed among events of an unknown chunk is left out, however many events the id has; later ones are paired."""
    calls, answers = [], []
    for call_id, length in (("short", 4), ("long", BLOCK_EVENTS)):
        calls += [("f", call_id, None, 1, 0, "accepted", (1,)), ("f", call_id, None, 3, 0, "accepted", (3,))]
        answers += [("f", call_id, None, 2, 0, (2,)), *(("f", call_id, 0, 4 + i, 0, (4 + i,)) for i in range(length))]
    keys = "file string, call_id string, chunk bigint, line bigint, block int"
    uses = spark.createDataFrame(calls, f"{keys}, status string, call struct<n: bigint>")
    results = spark.createDataFrame(answers, f"{keys}, result struct<n: bigint>")
    got = sorted((r.call_id, r.call.n, r.result.n) for r in pair_calls(call_events(uses, results)).collect())
    assert got == [("long", 3, 4), ("short", 3, 4)]


# --- files ----------------------------------------------------------------------------

def test_offsets_across_splits(spark, tmp_path):
    lines = [("é" * (i % 50)) + ("\r" if i % 7 == 0 else "") for i in range(4000)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "skip.txt").write_text("x\n")
    (tmp_path / "empty.jsonl").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        framed = scan_lines(spark, str(tmp_path), cap=60)
        assert framed.select("chunk").distinct().count() > 3
        rows = with_line_offsets(framed).orderBy("chunk", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    offset = 0
    for row, line in zip(rows, lines, strict=True):
        text = line.removesuffix("\r")
        assert row.offset == offset
        assert row.oversize == (len(text.encode()) > 60) and row.value == (None if row.oversize else text)
        offset += len(line.encode()) + 1
    assert list_files(spark, str(tmp_path)).count() == 2
    assert scan_lines(spark, str(tmp_path / "absent")).count() == 0


def test_deep_trees_are_listed_by_many_tasks(spark, tmp_path):
    want = {}
    for number in range(120):
        folder = tmp_path / "projects" / "one" / f"p{number}" / ".hidden"
        folder.mkdir(parents=True)
        for name, size in ((f"{number}.jsonl", number), ("_empty.jsonl", 0), ("other.txt", 3)):
            (folder / name).write_text("x" * size)
            if name.endswith("jsonl"):
                want[str(folder / name)] = size
    (tmp_path / "projects" / "one" / "loop").symlink_to(tmp_path / "projects")
    got = list_files(spark, str(tmp_path / "projects"))
    assert {r.file: r.length for r in got.collect()} == want
    folders = got.select(F.regexp_replace("file", "/[^/]*$", "").alias("path")).distinct()
    assert list_folder(folders, 16).select(F.spark_partition_id()).distinct().count() > 8
    assert list_files(spark, str(tmp_path / "absent")).count() == 0


def test_catalog_discovery(spark, tmp_path):
    home, plugin, repo = tmp_path / "home", tmp_path / "plugin", tmp_path / "repo"
    for base, kind in ((home, "global"), (plugin, "plug"), (repo / ".claude", "proj")):
        for path in (f"skills/{kind}-skill/SKILL.md", f"agents/{kind}-agent.md", f"commands/{kind}-cmd.md",
                     f"skills/{kind}-skill/deep/SKILL.md", f"agents/sub/{kind}-no.md", "notes.md"):
            (base / path).parent.mkdir(parents=True, exist_ok=True)
            (base / path).write_text("x")
    (home / "plugins").mkdir()
    (home / "plugins" / "installed_plugins.json").write_text(
        json.dumps({"plugins": {"p": [{"installPath": str(plugin)}, {"installPath": ""}]}}))
    (home / "settings.json").write_text('{"mcpServers": {"global-mcp": {}}}')
    (plugin / ".mcp.json").write_text('{"mcpServers": {"broken": ')
    (repo / ".mcp.json").write_text('{"mcpServers": {"repo-mcp": {"env": {"A": "b"}}}}')
    listing = [
        {"cwd": "/work/repo", "attachment": {"type": "skill_listing", "content": "Use:\n- listed-skill: does: x\n- nocolon\nother: y"}},
        {"cwd": "/work/repo/sub", "attachment": {"type": "agent_listing_delta", "addedTypes": ["listed-agent"]}},
        {"cwd": "/work/repo", "attachment": {"type": "mcp_instructions_delta", "addedNames": ["listed-mcp", None]}},
        {"cwd": "/work/repository", "attachment": {"type": "agent_listing_delta", "addedTypes": ["foreign"]}},
        {"cwd": "/work/repo", "attachment": {"type": "agent_listing_delta", "addedTypes": ["ok", 5]}},
        {"cwd": "/work/repo", "attachment": {"type": "other", "addedTypes": ["no"]}},
    ]
    (home / "projects").mkdir()
    (home / "projects" / "s.jsonl").write_text("\n".join(json.dumps(line) for line in listing) + "\n{bad attachment\n")

    def column(name, *values):
        return spark.createDataFrame([(str(v),) for v in values], f"{name} string")

    plugins = plugin_paths(read_documents(column("path", home / "plugins" / "installed_plugins.json")))
    assert [r.base for r in plugins.collect()] == [str(plugin)]
    bases = plugins.unionByName(column("base", home, repo / ".claude", tmp_path / "no"))
    files = primitives_in_layout(list_documents(bases), bases)
    servers = mcp_servers(read_documents(mcp_documents(column("base", home), plugins, column("base", repo, tmp_path / "no"))))
    roots = spark.createDataFrame([("/work/repo",)], "root string")
    listed = listed_primitives(scan_lines(spark, str(home / "projects"), 2 * 1024 * 1024), roots)
    got = {(r.kind, r.name) for r in catalog([files, servers, listed], b"k").collect()}
    assert got == {
        *((kind, f"{p}-{s}") for p in ("global", "plug", "proj")
          for kind, s in (("skill", "skill"), ("subagent", "agent"), ("command", "cmd"))),
        ("mcp_server", "global-mcp"), ("mcp_server", "repo-mcp"), ("skill", "listed-skill"),
        ("subagent", "listed-agent"), ("mcp_server", "listed-mcp"),
    }


# --- aggregates and marts -------------------------------------------------------------

def facts(spark, *rows):
    base = {"harness": "h", "kind": "skill", "name": "a", "invoker": "user", "session_id": "s", "ts": datetime(2026, 1, 1, tzinfo=UTC)}
    return spark.createDataFrame([tuple({**base, **r}.get(f) for f in INVOCATION.fieldNames()) for r in rows], INVOCATION)


def test_aggregates(spark):
    rows = facts(spark, {"outcome": "ok"}, {}, {"outcome": "error", "session_id": "t"},
                 {"kind": "builtin_tool", "outcome": "error"}, {"kind": "session_start"}, {"kind": "session_end", "outcome": "denied_user"})
    total = summary(rows.where("kind <> 'session_end'")).first()
    assert (total.invocations, total.known, total.unknown, total.failures, total.sessions, total.error_percent) == (3, 2, 1, 1, 2, 50.0)
    assert summary(rows).first().known == 3
    empty = summary(facts(spark, {}).limit(0)).first()
    assert (empty.invocations, empty.sessions, empty.last_observed, empty.error_percent) == (0, 0, None, None)
    kept_apart = facts(spark, {"via_agent": ""}, {}, {"via_agent": "x"}, {"invoker": "model"})
    assert sorted((r.via_agent, r.invoker, r.invocations) for r in usage_by_provenance(kept_apart).collect()) == [
        ("", "model", 1), ("", "user", 2), ("x", "user", 1)]
    tiles = overview(rows.limit(0), rows.limit(0).select("name")).first()
    assert (tiles.error_rate, tiles.updated, tiles.is_empty) == ("not available", "No activity observed yet", True)


def test_one_decimal_is_exact(spark):
    pairs = [(n, d) for d in range(1, 90) for n in range(0, d + 1)] + [(3, 2000), (1, 16), (5, 16), (1, 8), (999, 1000), (1999, 2000)]
    rows = spark.createDataFrame(pairs, "n bigint, d bigint").select("n", "d", one_decimal(F.col("n") / F.col("d") * 100).alias("t"))
    for row in rows.collect():
        assert row.t == f"{row.n / row.d * 100:.1f}", row


def test_snapshot_is_refused_as_a_whole(spark, tmp_path):
    snapshots = UsageSnapshots(spark, str(tmp_path / "s"))
    assert snapshots.read().isEmpty()
    names = spark.createDataFrame([("h", "skill", "a"), ("h", "skill", "b"), ("h", "builtin_tool", "Bash"), ("h", "skill", "x/y")],
                                  "harness string, kind string, name string")
    snapshots.refresh(facts(spark, {"outcome": "error"}, {}, {"name": "unlisted"}), names, scanned=True)
    got = {r.name: (r.invocations, r.failures, r.unknown) for r in snapshots.read().collect()}
    assert got == {"a": (2, 1, 1), "b": (0, 0, 0)}
    assert [(r.label, r.unused) for r in unused_overview(snapshots.read()).collect()] == [("Skill", 1), ("Total unused", 1)]
    only = names.where("name = 'a'")
    snapshots.refresh(facts(spark, {}), only, scanned=False)
    assert {r.name for r in snapshots.read().collect()} == {"a", "b"}
    snapshots.refresh(facts(spark, {}), only, scanned=True)
    assert {r.name for r in snapshots.read().collect()} == {"a"}
    bad = spark.createDataFrame([(1, datetime(2026, 1, 1), "h", "skill", "a", 1, 2, 0, datetime(2026, 1, 1))], USAGE_SNAPSHOT)
    snapshots.table.publish(bad.unionByName(snapshots.read()))
    with pytest.raises(InvalidSnapshot):
        snapshots.read()
    assert snapshots.previous_names().isEmpty()


@pytest.mark.parametrize("counters,state", [
    ({"at": None}, "never scanned"), ({"unreadable": 1}, "collects nothing"), ({"parse_errors": 1, "events_written": 5}, "collects nothing"),
    ({"refused_projects": 1}, "collects nothing"), ({"refused_calls": 1}, "collects nothing"),
    ({"pending_calls": 3, "interrupted_calls": 2, "ambiguous_skill_runs": 1, "skipped": 4}, "collects zero"),
    ({"events_written": 1, "pending_calls": 3}, "collecting"),
])
def test_integration_state(spark, counters, state):
    row = {"at": datetime(2026, 1, 1), **{n: 0 for n in COUNTER_NAMES}, **counters}
    schema = "at timestamp, " + ", ".join(f"{n} bigint" for n in COUNTER_NAMES)
    df = spark.createDataFrame([tuple(row.values())], schema)
    states = df.select(integration_state(F.lit(True), F.lit(True)), integration_state(F.lit(False), F.lit(False)),
                       integration_state(F.lit(True), F.lit(False))).first()
    assert tuple(states) == (state, "counters unreadable", "hooks unreadable")


def test_counter_table(spark, tmp_path):
    health = ScanHealth(spark, str(tmp_path / "health"))
    assert health.diagnose().first().state == "never scanned"
    row = spark.createDataFrame([tuple(range(1, 11))], ", ".join(f"{n} bigint" for n in COUNTER_NAMES))
    health.record_scan(row, datetime(2026, 1, 2, tzinfo=UTC))
    health.record_scan(row.select(*[F.lit(0).alias(n) for n in COUNTER_NAMES]), datetime(2026, 1, 1, tzinfo=UTC))
    health.record_hooks(spark.createDataFrame([(2, 0, 1)], "installed int, removed int, kept_owned int"), datetime(2026, 1, 3, tzinfo=UTC))
    assert health.current().first().transcripts == 1 and health.hooks().first().installed == 2
    health._checked("scans", spark.read.parquet(str(tmp_path / "health/scans")).schema).withColumn("version", F.lit(9)).limit(
        1).write.mode("append").parquet(str(tmp_path / "health/scans"))
    with pytest.raises(InvalidCounters):
        health.current()
    assert health.diagnose().first().state == "counters unreadable"
