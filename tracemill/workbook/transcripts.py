"""Transcripts written from the events table, read back through the whole derivation."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.classify import kind_for, outcome_from, package_from_attribution, primitive_name
from tracemill.operators.calls import acting_entries, project_calls, skill_candidates
from tracemill.operators.consent import attach_consent, resolve_directories
from tracemill.operators.sessions import Staleness
from tracemill.plans.derive import (
    DeriveOptions,
    Derivation,
    derive,
    file_counters,
    incomplete_files,
    total_counters,
)
from tracemill.session import ROWS_A_FILE, materialize
from tracemill.sources.lines import feed_lines
from tracemill.sources.transcripts import decode_entries, explode_blocks
from tracemill.workbook.registry import query

SALT = b"workbook salt"
NAME_KEY = b"workbook name key"
QUIET = Staleness(timedelta(hours=24), datetime(2024, 1, 31, 12, tzinfo=timezone.utc))
OPTIONS = DeriveOptions(SALT, NAME_KEY, QUIET)
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _shape(events: DataFrame) -> DataFrame:
    user, value = F.col("user_id"), F.col("value")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("id"), user.alias("u"), F.col("ts").cast("timestamp").alias("ts"), value.alias("v"),
        F.col("event_type").alias("et"), k.alias("k"),
        F.concat(F.lit("f"), F.floor(user / 2)).alias("file"), F.concat(F.lit("s"), user).alias("session"),
        F.concat(F.lit("/repo/r"), user % 10, F.lit("/src")).alias("cwd"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(value * 1000).cast("bigint") * 1000).alias("ended"),
    )


def event_feed(events: DataFrame) -> DataFrame:
    """A line feed (file, offset, value): a call line per event, most with a result line.

    Signups are finished skill turns instead. Every twentieth call never ends, every
    twentieth result comes before its call, some lines are routine bookkeeping, and one
    file in eight has broken lines.
    """
    e = _shape(events)
    et, k, n = F.col("et"), F.col("k"), F.col("id")
    uuid, call_id = F.concat(F.lit("e"), n), F.concat(F.lit("c"), n)
    common = [F.col("session").alias("sessionId"), F.col("cwd")]
    null = F.lit(None).cast("string")
    tool = (
        F.when(et == "click", "Bash").when(et == "view", "Skill").when(et == "purchase", "Task")
        .when(et == "error", F.concat(F.lit("mcp__srv"), k % 3, F.lit("__t"), k % 2))
    )
    text = F.struct(F.lit("text").alias("type"), null.alias("id"), null.alias("name"),
                    F.struct(null.alias("skill"), null.alias("subagent_type")).alias("input"))
    use = F.struct(
        F.lit("tool_use").alias("type"), call_id.alias("id"), tool.alias("name"),
        F.struct(
            F.when(et == "view", F.concat(F.lit("skill-"), k % 5)).alias("skill"),
            F.when((et == "purchase") & (k % 9 != 0), F.concat(F.lit("agent-"), k % 4)).alias("subagent_type"),
        ).alias("input"),
    )
    stamp = F.date_format("ts", _STAMP).alias("timestamp")
    calls = e.where(et != "signup").select(
        "file", (n * 1000).alias("offset"),
        F.to_json(F.struct(
            uuid.alias("uuid"), *common, stamp, F.lit("2.0.1").alias("version"),
            F.when(et == "error", F.concat(F.lit("plugin:pkg"), k % 3, F.lit(":x"))).alias("attributionMcpServer"),
            F.struct(F.lit("model-a").alias("model"), F.array(text, use).alias("content")).alias("message"),
        )).alias("value"),
    )
    turns = e.where(et == "signup").select(
        "file", (n * 1000).alias("offset"),
        F.to_json(F.struct(
            uuid.alias("uuid"), *common, stamp, F.concat(F.lit("skill-"), k % 5).alias("attributionSkill"),
            (k % 6 == 0).alias("isSidechain"),
            F.struct(F.lit("end_turn").alias("stop_reason"), F.lit("model-a").alias("model")).alias("message"),
        )).alias("value"),
    )
    answer = F.struct(
        F.lit("tool_result").alias("type"), call_id.alias("tool_use_id"),
        F.when(F.col("v") < 50, None).otherwise(F.col("v") < 150).alias("is_error"),
    )
    payload = F.when(k % 13 == 0, F.to_json(F.struct(F.lit(True).alias("interrupted")))).when(
        k % 13 == 1, F.lit('"{\\"interrupted\\":true}"'))
    result_json = F.to_json(F.struct(
        F.concat(F.lit("r"), n).alias("uuid"), *common, F.date_format("ended", _STAMP).alias("timestamp"),
        F.when(k % 23 == 0, "permission-rule").when(k % 29 == 0, "user-rejected").alias("toolDenialKind"),
        F.struct(F.array(answer).alias("content")).alias("message"),
    ))
    with_payload = F.when(
        payload.isNotNull(),
        F.concat(F.lit('{"toolUseResult":'), payload, F.lit(","), F.substr(result_json, F.lit(2))),
    ).otherwise(result_json)
    results = e.where((et != "signup") & (n % 20 != 0)).select(
        "file", (n * 1000 + F.when(n % 20 == 1, -400).otherwise(500)).alias("offset"), with_payload.alias("value"))
    bookkeeping = e.where(n % 20 == 2).select(
        "file", (n * 1000 + 700).alias("offset"),
        F.to_json(F.struct(F.lit("queue-operation").alias("type"), F.col("session").alias("sessionId"),
                           F.date_format("ended", _STAMP).alias("timestamp"))).alias("value"))
    broken = e.where((F.col("u") % 64 == 3) & (n % 97 == 0)).select(
        "file", (n * 1000 + 800).alias("offset"), F.lit('{"uuid":"x",').alias("value"))
    lines = calls.unionByName(turns).unionByName(results).unionByName(bookkeeping).unionByName(broken)
    # Transcripts are stored text; reading them must not re-run the code that writes them. An event has two lines at most but for
    # a few; dealt out, every file holds about as many, and so the tasks that parse them are even.
    files = max(1, -(-2 * events.count() // ROWS_A_FILE))
    return materialize(lines.repartition(files), "feed")


def event_consent(events: DataFrame) -> DataFrame:
    """The first eight of ten repositories consented."""
    repos = events.select((F.col("user_id") % 10).alias("r")).distinct().where("r < 8")
    root = F.concat(F.lit("/repo/r"), "r")
    return repos.select(
        F.col("r").cast("int").alias("entry"), F.md5(root).alias("id"), root.alias("root"),
        F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("case_insensitive"),
        F.lit(None).cast("timestamp").alias("collect_from"),
    )


def decoded(events: DataFrame) -> DataFrame:
    return materialize(decode_entries(feed_lines(event_feed(events))), "entries")


def derived_events(events: DataFrame) -> tuple[DataFrame, Derivation]:
    entries = decoded(events)
    return entries, derive(entries, event_consent(events), OPTIONS, materialize)


EVENTS_SQL = """e AS (
  SELECT event_id AS id, user_id AS u, ts, value AS v, event_type AS et, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         'f' || (user_id // 2) AS file, 's' || user_id AS session,
         ts + to_microseconds(CAST(floor(value * 1000) AS BIGINT) * 1000) AS ended FROM events
), calls AS (
  SELECT *, CASE WHEN u % 10 >= 8 THEN 'skipped' WHEN et = 'purchase' AND k % 9 = 0 THEN 'refused' ELSE 'accepted' END AS status,
    CASE et WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'skill-' || (k % 5) WHEN 'purchase' THEN 'agent-' || (k % 4)
         ELSE 'mcp__srv' || (k % 3) || '__t' || (k % 2) END AS name,
    CASE et WHEN 'click' THEN 'builtin_tool' WHEN 'view' THEN 'skill' WHEN 'purchase' THEN 'subagent' ELSE 'mcp_tool' END AS kind,
    CASE WHEN et = 'error' THEN 'pkg' || (k % 3) END AS package,
    CASE WHEN k % 23 = 0 THEN 'denied_policy' WHEN k % 29 = 0 THEN 'denied_user' WHEN k % 13 = 0 THEN 'interrupted'
         WHEN v < 50 THEN NULL WHEN v < 150 THEN 'error' ELSE 'ok' END AS outcome
  FROM e WHERE et <> 'signup'
), seen AS (
  SELECT file, session, id * 1000 AS off, ts AS seen_at FROM e
  UNION ALL SELECT file, session, id * 1000 + CASE WHEN id % 20 = 1 THEN -400 ELSE 500 END, ended FROM calls WHERE id % 20 <> 0
  UNION ALL SELECT file, session, id * 1000 + 700, ended FROM e WHERE id % 20 = 2
), activity AS (SELECT file, session, max(seen_at) AS last_activity, min(off) AS first_offset FROM seen GROUP BY ALL
), blind AS (SELECT DISTINCT file FROM e WHERE u % 64 = 3 AND id % 97 = 0
), closed AS (SELECT file, session FROM activity WHERE last_activity < TIMESTAMP '2024-01-30 12:00:00'
              AND file NOT IN (SELECT file FROM blind)
), runs AS (
  SELECT file, session, 'skill-' || (k % 5) AS name, u, sha256('claude-code' || chr(0) || 'e' || id) AS event_id, ts FROM e
  WHERE et = 'signup' AND k % 6 <> 0 AND u % 10 < 8
), collapsed AS (
  SELECT file, session, name, any_value(u) AS u, min(ts) AS ts, first(event_id ORDER BY ts, event_id) AS event_id, count(*) - 1 AS extra
  FROM runs GROUP BY file, session, name
), uncovered AS (
  SELECT * FROM collapsed c WHERE (file, session) IN (SELECT file, session FROM closed)
    AND NOT EXISTS (SELECT 1 FROM calls i WHERE i.status = 'accepted' AND i.kind = 'skill' AND i.file = c.file
                    AND i.session = c.session AND i.name = c.name)
), ended_calls AS (
  SELECT *, id % 20 = 0 AS is_open, (file, session) IN (SELECT (file, session) FROM closed) AS is_closed FROM calls
), records AS (
  SELECT sha256('claude-code' || chr(0) || 'e' || id || chr(31) || 'c' || id) AS event_id,
         CASE WHEN is_open THEN ts ELSE ended END AS ts, session AS session_id, md5('/repo/r' || (u % 10)) AS repo, kind, name,
         package, 'model-a' AS model, '2.0.1' AS harness_version, 'model' AS invoker,
         CASE WHEN is_open THEN 'interrupted' ELSE outcome END AS outcome, file AS src_file
  FROM ended_calls WHERE status = 'accepted' AND (NOT is_open OR is_closed)
  UNION ALL
  SELECT event_id, ts, session, md5('/repo/r' || (u % 10)), 'skill', name, NULL, 'model-a', NULL, 'user', NULL, file FROM uncovered
)"""

RECORD_COLUMNS = ["event_id", "ts", "session_id", "repo", "kind", "name", "package", "model", "harness_version",
                  "invoker", "outcome"]


@query("transcript_records", f"WITH {EVENTS_SQL} SELECT {', '.join(RECORD_COLUMNS)}, src_file FROM records")
def _(spark, tables):
    _, derived = derived_events(tables("events"))
    return derived.records.select(*RECORD_COLUMNS, "src_file")


_COUNTERS = f"""WITH {EVENTS_SQL}, per AS (
  SELECT f.file,
    (SELECT count(*) FROM e WHERE e.file = f.file AND id % 20 = 2) AS bookkeeping,
    (SELECT count(*) FROM e WHERE e.file = f.file AND u % 64 = 3 AND id % 97 = 0) AS blind,
    (SELECT count(*) FROM calls c WHERE c.file = f.file AND status = 'refused') AS refused_calls,
    (SELECT count(*) FROM ended_calls c WHERE c.file = f.file AND status = 'accepted' AND is_open AND NOT is_closed) AS pending_calls,
    (SELECT count(*) FROM ended_calls c WHERE c.file = f.file AND status = 'accepted' AND is_open AND is_closed) AS interrupted_calls,
    (SELECT coalesce(sum(extra), 0) FROM uncovered c WHERE c.file = f.file) AS ambiguous_skill_runs,
    (SELECT count(*) FROM records r WHERE r.src_file = f.file) AS parsed
  FROM (SELECT DISTINCT file FROM e) f)"""


@query("file_counters", f"""{_COUNTERS}
SELECT file, bookkeeping + blind AS parse_errors, bookkeeping, blind, refused_calls, pending_calls, interrupted_calls,
       CAST(ambiguous_skill_runs AS BIGINT) AS ambiguous_skill_runs, parsed, parsed = 0 AND refused_calls = 0 AS skipped
FROM per""")
def _(spark, tables):
    entries, derived = derived_events(tables("events"))
    files = entries.groupBy("file").agg(F.sum("nbytes").alias("length"))
    return file_counters(files, entries, derived).select(
        "file", "parse_errors", "bookkeeping", "blind", "refused_calls", "pending_calls", "interrupted_calls",
        "ambiguous_skill_runs", "parsed", "skipped")


@query("scan_totals", f"""{_COUNTERS}
SELECT count(*) AS transcripts, 0::BIGINT AS unreadable, CAST(sum(bookkeeping + blind) AS BIGINT) AS parse_errors,
       count(*) FILTER (parsed = 0 AND refused_calls = 0) AS skipped, CAST(sum(refused_calls) AS BIGINT) AS refused_calls,
       CAST(sum(pending_calls) AS BIGINT) AS pending_calls, CAST(sum(interrupted_calls) AS BIGINT) AS interrupted_calls,
       CAST(sum(ambiguous_skill_runs) AS BIGINT) AS ambiguous_skill_runs FROM per""")
def _(spark, tables):
    entries, derived = derived_events(tables("events"))
    files = entries.groupBy("file").agg(F.sum("nbytes").alias("length"))
    return total_counters(file_counters(files, entries, derived)).select(
        "transcripts", "unreadable", "parse_errors", "skipped", "refused_calls", "pending_calls", "interrupted_calls",
        "ambiguous_skill_runs")


@query("skipped_transcripts", f"{_COUNTERS} SELECT file FROM per WHERE parsed = 0 AND refused_calls = 0")
def _(spark, tables):
    entries, derived = derived_events(tables("events"))
    files = entries.groupBy("file").agg(F.sum("nbytes").alias("length"))
    return file_counters(files, entries, derived).where("skipped").select("file")


@query("incomplete_files", f"""{_COUNTERS}
SELECT file, CAST(substr(file, 2) AS INT) % 5 = 2 AS failed,
       CASE WHEN CAST(substr(file, 2) AS INT) % 5 = 2 THEN 1 ELSE bookkeeping + blind END AS parse_errors,
       CASE WHEN CAST(substr(file, 2) AS INT) % 5 = 2 THEN 0 ELSE parsed END AS parsed,
       CASE WHEN CAST(substr(file, 2) AS INT) % 5 = 2 THEN 0 ELSE pending_calls + interrupted_calls END AS open_calls,
       CAST(substr(file, 2) AS INT) % 5 <> 2 AND parsed = 0 AND refused_calls = 0 AS skipped
FROM per""")
def _(spark, tables):
    """Every fifth transcript is longer in the listing than what was read of it: it fails as a whole."""
    entries = decoded(tables("events"))
    short = F.substr("file", F.lit(2)).cast("int") % 5 == 2
    files = entries.groupBy("file").agg(F.sum("nbytes").alias("read")).select(
        "file", (F.col("read") + F.when(short, 2).otherwise(-1)).alias("length"))
    incomplete = materialize(incomplete_files(files, entries), "incomplete")
    whole = entries.join(incomplete, "file", "left_anti")
    derived = derive(whole, event_consent(tables("events")), OPTIONS, materialize)
    return file_counters(files, whole, derived, incomplete).select(
        "file", "failed", "parse_errors", "parsed", (F.col("pending_calls") + F.col("interrupted_calls")).alias("open_calls"), "skipped")


@query("entry_classification", f"""WITH {EVENTS_SQL}
SELECT file, 'entry' AS status, false AS blind, count(*) AS lines FROM (
  SELECT file FROM e UNION ALL SELECT file FROM calls WHERE id % 20 <> 0) GROUP BY file
UNION ALL SELECT file, 'malformed', false, count(*) FROM e WHERE id % 20 = 2 GROUP BY file
UNION ALL SELECT file, 'malformed', true, count(*) FROM e WHERE u % 64 = 3 AND id % 97 = 0 GROUP BY file""")
def _(spark, tables):
    return decoded(tables("events")).groupBy("file", "status", "blind").agg(F.count(F.lit(1)).alias("lines"))


@query("content_blocks", f"""WITH {EVENTS_SQL}
SELECT 'e' || id AS uuid, 1 AS block, 'tool_use' AS type, 'c' || id AS ref FROM calls
UNION ALL SELECT 'r' || id, 0, 'tool_result', 'c' || id FROM calls WHERE id % 20 <> 0""")
def _(spark, tables):
    return explode_blocks(decoded(tables("events"))).select(
        "uuid", "b.block", "b.type", F.coalesce("b.id", "b.tool_use_id").alias("ref"))


def _acting(events: DataFrame) -> DataFrame:
    acting = acting_entries(decoded(events))
    directories = resolve_directories(acting.select("cwd"), event_consent(events), SALT)
    return materialize(attach_consent(acting, directories, "history"), "acting")


@query("call_projection", f"""WITH {EVENTS_SQL}
SELECT 'c' || id AS call_id, status, CASE WHEN status = 'accepted' THEN name END AS name,
       CASE WHEN status = 'accepted' THEN kind END AS kind FROM calls""")
def _(spark, tables):
    calls = project_calls(_acting(tables("events")), NAME_KEY, "claude-code")
    return calls.select("call_id", "status", F.col("call.name").alias("name"), F.col("call.kind").alias("kind"))


@query("skill_candidates", f"WITH {EVENTS_SQL} SELECT file, session, name, event_id, ts FROM runs")
def _(spark, tables):
    return skill_candidates(_acting(tables("events")), NAME_KEY, "claude-code").select(
        "file", "session", "name", "record.event_id", "record.ts")


def _words(conversations: DataFrame) -> DataFrame:
    """Conversation turns recast as raw call attributes."""
    n = F.col("conv_id") * 100 + F.col("turn")
    tool = (
        F.when(n % 5 == 0, "Skill").when(n % 5 == 1, "Task")
        .when(n % 5 == 2, F.concat(F.lit("mcp__"), F.when(n % 2 == 0, F.col("role")).otherwise(F.lit(""))))
        .when(n % 5 == 3, F.lower("role")).otherwise(F.concat(F.lit("a/"), "role"))
    )
    return conversations.select(
        n.alias("n"), tool.alias("tool"),
        F.when(n % 3 == 0, F.concat(F.lit(" "), "role", F.lit("-run "))).when(n % 3 == 1, F.lit("")).alias("skill"),
        F.when(n % 4 != 0, F.concat(F.col("role"), F.lit(":"), n % 7)).otherwise(F.col("text")).alias("subagent"),
        F.when(n % 2 == 0, F.concat(F.lit("plugin:"), "role", F.when(n % 6 == 0, ":x").otherwise(""))).otherwise(F.col("role")).alias("server"),
        F.when(n % 11 == 0, "permission-rule").when(n % 13 == 0, "user-rejected").when(n % 17 == 0, "other").alias("denial"),
        (n % 7 == 0).alias("interrupted"), F.when(n % 3 != 2, n % 3 == 0).alias("is_error"),
    )


_NAME_RULE = r"regexp_matches({0}, '\A[A-Za-z0-9][A-Za-z0-9._:@+-]{{0,127}}\z') AND NOT regexp_matches({0}, '\A[A-Za-z]:')"


@query("call_classification", rf"""WITH w AS (
  SELECT conv_id * 100 + turn AS n, role, text FROM conversations
), a AS (
  SELECT *, CASE n % 5 WHEN 0 THEN 'Skill' WHEN 1 THEN 'Task' WHEN 2 THEN 'mcp__' || CASE WHEN n % 2 = 0 THEN role ELSE '' END
            WHEN 3 THEN lower(role) ELSE 'a/' || role END AS tool,
    CASE n % 3 WHEN 0 THEN role || '-run' WHEN 1 THEN '' END AS skill,
    CASE WHEN n % 4 <> 0 THEN role || ':' || (n % 7) END AS subagent FROM w
)
SELECT n, CASE WHEN tool = 'Skill' THEN 'skill' WHEN tool = 'Task' THEN 'subagent'
               WHEN starts_with(tool, 'mcp__') AND strlen(tool) > 5 THEN 'mcp_tool' ELSE 'builtin_tool' END AS kind,
  CASE WHEN tool = 'Skill' AND coalesce(skill, '') <> '' THEN skill WHEN tool = 'Task' THEN
         CASE WHEN subagent IS NOT NULL THEN subagent WHEN {_NAME_RULE.format("trim(text)")} THEN trim(text) END
       WHEN contains(tool, '/') THEN NULL ELSE tool END AS name,
  CASE WHEN n % 6 = 0 THEN role END AS package,
  CASE WHEN n % 11 = 0 THEN 'denied_policy' WHEN n % 13 = 0 THEN 'denied_user' WHEN n % 7 = 0 THEN 'interrupted'
       WHEN n % 3 = 0 THEN 'error' WHEN n % 3 = 1 THEN 'ok' END AS outcome
FROM a""")
def _(spark, tables):
    w = _words(tables("conversations"))
    return w.select(
        "n", kind_for(F.col("tool")).alias("kind"),
        primitive_name(F.col("tool"), F.col("skill"), F.col("subagent"), NAME_KEY).alias("name"),
        package_from_attribution(F.col("server")).alias("package"),
        outcome_from(F.col("denial"), F.col("interrupted"), F.col("is_error")).alias("outcome"),
    )
