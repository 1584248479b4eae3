"""Pairing, closing and skill-run rules on small transcripts."""

import hashlib
import json
from datetime import timedelta

import pytest

from tests.support import CALL_AT, CLOSED, HOUR, NO_RULE, Run, consent_rows, REPO
from tracemill.operators.sessions import Staleness


def at(minutes=0, seconds=0):
    return (CALL_AT + timedelta(minutes=minutes, seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def entry(uuid, seconds=0, session="voyage-a", cwd="/repo", content=None, message=None, **extra):
    doc = {"uuid": uuid, "sessionId": session, "cwd": cwd, "timestamp": at(seconds=seconds), **extra}
    if content is not None or message is not None:
        doc["message"] = {**(message or {}), **({"content": content} if content is not None else {})}
    return json.dumps(doc)


def use(call="op-1", name="Bash", **input_):
    block = {"type": "tool_use", "id": call, "name": name}
    if input_:
        block["input"] = input_
    return block


def result(call="op-1", **flags):
    return {"type": "tool_result", "tool_use_id": call, **flags}


def end_turn(uuid, seconds=0, skill="tide-check", **extra):
    return entry(uuid, seconds, message={"model": "model-x", "stop_reason": "end_turn"}, attributionSkill=skill, **extra)


OPEN_CALL = entry("line-1", content=[use()])
OK_RESULT = entry("line-2", 1, content=[result(is_error=False)])
PLAIN = [
    entry("line-1", content=[use(name="mcp__harbor__lookup")], message={"model": "model-x"},
          attributionMcpServer="plugin:harbor:north", attributionSkill="ledger-work", version="1.2.3"),
    OK_RESULT,
]
SYNTAX = '{"uuid":"line-2","sessionId":"voyage-a",'
NO_UUID_RESULT = json.dumps({"sessionId": "voyage-a", "timestamp": at(seconds=1),
                             "message": {"content": [result(is_error=False)]}})
BOOKKEEPING = [
    json.dumps({"type": "banner", "sessionId": "voyage-a"}),
    json.dumps({"type": "outline", "sessionId": "voyage-a"}),
    json.dumps({"type": "tick", "operation": "enqueue", "sessionId": "voyage-a", "timestamp": at()}),
]
STRING_CONTENT = json.dumps({"uuid": "line-2", "sessionId": "voyage-a", "cwd": "/repo", "timestamp": at(seconds=1),
                             "type": "user", "message": {"role": "user", "content": "go ahead"}})

TRANSCRIPTS = {
    "plain": PLAIN,
    "reversed": PLAIN[::-1],
    "open": [OPEN_CALL],
    "result-only": [OK_RESULT],
    "two-early": [OK_RESULT, entry("line-3", 2, content=[result(is_error=True)]), OPEN_CALL],
    "repeated-result": [OPEN_CALL, OK_RESULT, entry("line-3", 2, content=[result(is_error=True)])],
    "two-blocks": [entry("line-1", content=[use("op-1"), use("op-2")]),
                   entry("line-2", 1, content=[result("op-1", is_error=False), result("op-2", is_error=True)])],
    "payload-shapes": [
        entry("e1", content=[use("c1", "Bash"), use("c2", "Task", subagent_type="hull-inspector"),
                             use("c3", "Skill", skill="tide-check")]),
        entry("e2", 1, content=[result("c1", is_error=False)], toolUseResult="free text"),
        entry("e3", 2, content=[result("c2", is_error=False)], toolUseResult=[{"type": "text"}]),
        entry("e4", 3, content=[result("c3", is_error=False)], toolUseResult={"interrupted": True}),
    ],
    "unknown-outcome": [OPEN_CALL, entry("line-2", 1, content=[result()])],
    "denials": [
        entry("e1", content=[use("c1"), use("c2"), use("c3")]),
        entry("e2", 1, content=[result("c1", is_error=True)], toolDenialKind="permission-rule"),
        entry("e3", 1, content=[result("c2", is_error=True)], toolDenialKind="user-rejected"),
        entry("e4", 1, content=[result("c3", is_error=True)], toolDenialKind="other"),
    ],
    "skill-run": [end_turn("line-1")],
    "covered-run": [entry("line-1", content=[use(name="Skill", skill="tide-check")]),
                    end_turn("line-2", 1), end_turn("line-3", 2), OK_RESULT.replace("line-2", "line-5")],
    "two-sessions": [end_turn("line-1"), end_turn("line-2", 1).replace("voyage-a", "voyage-b")],
    "repeated-runs": [end_turn("line-3", 2), end_turn("line-1"), end_turn("line-2", 1)],
    "sidechain": [end_turn("line-1", isSidechain=True)],
    "agent-only": [entry("line-1", message={"stop_reason": "end_turn"}, attributionAgent="hull-inspector")],
    "task-without-type": [entry("line-1", content=[use(name="Task")])],
    "skill-without-name": [entry("line-1", content=[use(name="Skill")]), OK_RESULT],
    "nameless-unconsented": [entry("line-1", cwd="/elsewhere", content=[use(name="Task")])],
    "refused-discards-early": [OK_RESULT, entry("line-1", content=[use(name="Task")]),
                               entry("line-3", 2, content=[use()])],
    "blind-syntax": [OPEN_CALL, SYNTAX],
    "blind-blank": [OPEN_CALL, ""],
    "blind-no-uuid": [OPEN_CALL, NO_UUID_RESULT],
    "blind-trailing": [OPEN_CALL, OK_RESULT + " x"],
    "blind-timestamp": [OPEN_CALL, entry("line-2").replace(at(), "2021-05-04 09:30:00")],
    "bookkeeping": [OPEN_CALL, *BOOKKEEPING],
    "string-content": [OPEN_CALL, STRING_CONTENT],
    "oversize": [OPEN_CALL, entry("line-2", 1, content=[result(is_error=False, pad="x" * 5000)])],
    "reused-id": [OPEN_CALL, OK_RESULT, entry("line-3", 2, content=[use()]),
                  entry("line-4", 3, content=[result(is_error=True)])],
    "overwritten": [OPEN_CALL, entry("line-3", 2, content=[use()])],
    "scoped-skill": [entry("line-1", content=[use(name="Skill", skill="docks/east:launch")]), OK_RESULT],
    "hostile-tool": [entry("line-1", content=[use(name="usr/local/bin")])],
}


@pytest.fixture(scope="module")
def closed(spark):
    return Run(spark, TRANSCRIPTS, CLOSED, cap=4096)


@pytest.fixture(scope="module")
def unruled(spark):
    return Run(spark, TRANSCRIPTS, NO_RULE, cap=4096)


def only(run, name):
    assert len(run.records[name]) == 1, run.records[name]
    return run.records[name][0]


def key(*parts):
    return hashlib.sha256(("claude-code\0" + "\x1f".join(parts)).encode()).hexdigest()


def stamp(row):
    return row.ts.strftime("%Y-%m-%dT%H:%M:%SZ")


def test_plain_pair(unruled):
    row = only(unruled, "plain")
    assert (row.kind, row.name, row.package, row.via_skill, row.outcome) == (
        "mcp_tool", "mcp__harbor__lookup", "harbor", "ledger-work", "ok")
    assert (row.event_id, stamp(row), row.repo) == (key("line-1", "op-1"), at(seconds=1), REPO)
    assert (row.harness_version, row.model, row.invoker) == ("1.2.3", "model-x", "model")


def test_line_order_does_not_matter(unruled):
    drop = lambda row: {k: v for k, v in row.asDict().items() if not k.startswith("src_")}
    assert drop(only(unruled, "plain")) == drop(only(unruled, "reversed"))


def test_open_call_waits_without_a_rule_and_ends_interrupted_with_it(unruled, closed):
    assert unruled.records["open"] == [] and unruled.counters["open"].pending_calls == 1
    row = only(closed, "open")
    assert (row.outcome, stamp(row), row.event_id) == ("interrupted", at(), key("line-1", "op-1"))
    assert (closed.counters["open"].pending_calls, closed.counters["open"].interrupted_calls) == (0, 1)


def test_results_alone_yield_nothing(unruled):
    assert unruled.records["result-only"] == []
    assert unruled.counters["result-only"].skipped


def test_first_of_two_early_results_wins(unruled):
    row = only(unruled, "two-early")
    assert (row.outcome, stamp(row)) == ("ok", at(seconds=1))


def test_repeated_result_is_ignored(unruled):
    assert only(unruled, "repeated-result").outcome == "ok"


def test_two_calls_in_one_entry(unruled):
    ids = {row.event_id for row in unruled.records["two-blocks"]}
    assert len(ids) == 2 and key("line-1") not in ids
    assert sorted(row.outcome for row in unruled.records["two-blocks"]) == ["error", "ok"]


def test_payload_shapes(unruled):
    got = {row.name: (row.kind, row.outcome) for row in unruled.records["payload-shapes"]}
    assert got == {"Bash": ("builtin_tool", "ok"), "hull-inspector": ("subagent", "ok"),
                   "tide-check": ("skill", "interrupted")}
    assert unruled.counters["payload-shapes"].parse_errors == 0


def test_outcomes(unruled):
    assert only(unruled, "unknown-outcome").outcome is None
    assert [r.outcome for r in sorted(unruled.records["denials"], key=lambda r: r.src_pos)] == [
        "denied_policy", "denied_user", "error"]


def test_skill_runs(unruled, closed):
    assert unruled.records["skill-run"] == []
    row = only(closed, "skill-run")
    assert (row.kind, row.name, row.invoker, row.outcome, row.event_id) == (
        "skill", "tide-check", "user", None, key("line-1"))
    assert only(closed, "covered-run").outcome == "ok"
    assert closed.counters["covered-run"].ambiguous_skill_runs == 0
    assert len(closed.records["two-sessions"]) == 2
    assert only(closed, "repeated-runs").event_id == key("line-1")
    assert closed.counters["repeated-runs"].ambiguous_skill_runs == 2
    assert closed.records["sidechain"] == [] and closed.records["agent-only"] == []


def test_refusals(closed):
    assert closed.counters["task-without-type"].refused_calls == 1
    assert not closed.counters["task-without-type"].skipped
    assert closed.counters["nameless-unconsented"].refused_calls == 0
    assert closed.counters["hostile-tool"].refused_calls == 1
    assert only(closed, "skill-without-name").name == "Skill"


def test_refused_call_discards_an_early_result(unruled):
    assert unruled.records["refused-discards-early"] == []
    assert unruled.counters["refused-discards-early"].pending_calls == 1


@pytest.mark.parametrize("name", ["blind-syntax", "blind-blank", "blind-no-uuid", "blind-trailing", "blind-timestamp"])
def test_blind_line_keeps_the_file_open(closed, name):
    counters = closed.counters[name]
    assert (counters.malformed, counters.blind, counters.pending_calls) == (1, 1, 1)
    assert closed.records[name] == []


@pytest.mark.parametrize("name,malformed", [("bookkeeping", 3), ("string-content", 1), ("oversize", 1)])
def test_inspectable_lines_do_not_blind(closed, name, malformed):
    assert closed.counters[name].parse_errors == malformed
    assert only(closed, name).outcome == "interrupted"


def test_reused_ids_are_folded_in_order(closed):
    got = [(r.event_id, r.outcome) for r in closed.records["reused-id"]]
    assert got == [(key("line-1", "op-1"), "ok"), (key("line-3", "op-1"), "error")]
    assert only(closed, "overwritten").event_id == key("line-3", "op-1")


def test_scoped_names_are_digested(closed):
    import hmac

    digest = hmac.new(b"key of the harbour", b"docks/east", hashlib.sha256).hexdigest()[:12]
    assert only(closed, "scoped-skill").name == f"scope-{digest}:launch"


def test_no_stored_value_carries_a_separator(closed):
    for rows in closed.records.values():
        for row in rows:
            for name, value in row.asDict().items():
                if not name.startswith("src_") and isinstance(value, str):
                    assert "/" not in value and "\\" not in value


def test_silence_not_call_age_closes_a_session(spark):
    text = json.dumps({"uuid": "line-2", "sessionId": "voyage-a", "cwd": "/repo", "timestamp": at(180),
                       "message": {"content": [{"type": "text"}]}})
    late = lambda line, minutes: line.replace(at(seconds=0), at(minutes))
    quiet = {
        "alive": [OPEN_CALL, text],
        "inside": [entry("line-1", content=[use()]).replace(at(), at(179))],
        "bookkeeping": [OPEN_CALL, late(BOOKKEEPING[2], 150)],
        "mistyped": [OPEN_CALL, late(STRING_CONTENT.replace(at(seconds=1), at()), 150)],
        "bad-uuid": [OPEN_CALL, late(entry("not a token"), 150)],
        "boundary": [entry("line-1", content=[use()]).replace(at(), at(121))],
        "past": [entry("line-1", content=[use()]).replace(at(), at(120))],
    }
    run = Run(spark, quiet, Staleness(HOUR, CALL_AT + timedelta(minutes=181)))
    for name in ("alive", "inside", "bookkeeping", "mistyped", "bad-uuid", "boundary"):
        assert run.counters[name].pending_calls == 1, name
    assert only(run, "past").outcome == "interrupted"


def test_collection_window(spark):
    consent = consent_rows(spark, (REPO, "/repo", CALL_AT))
    early = OPEN_CALL.replace(at(), at(-1))
    lines = {"before": [early, OK_RESULT], "at": [OPEN_CALL, OK_RESULT]}
    window = Run(spark, lines, consent=consent, scope="window")
    assert window.records["before"] == [] and len(window.records["at"]) == 1
    history = Run(spark, lines, consent=consent)
    assert len(history.records["before"]) == 1


def test_without_a_key_scoped_names_are_refused(spark):
    run = Run(spark, {"f": TRANSCRIPTS["scoped-skill"], "plain": PLAIN}, name_key=None)
    assert run.records["f"] == [] and run.counters["f"].refused_calls == 1
    assert only(run, "plain").name == "mcp__harbor__lookup"
