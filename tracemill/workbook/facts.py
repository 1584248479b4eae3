"""The events table as invocation facts, and the aggregates over them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.classify import is_failure
from tracemill.functions.digests import call_event_key, event_key, hmac_pads
from tracemill.functions.domains import bounded_name, bounded_token, bounded_version, derived_name
from tracemill.operators.positions import with_positions
from tracemill.operators.usage import (
    counted,
    order_usage,
    outcome_histogram,
    ratio,
    ratio_holds,
    ratio_percent,
    summary,
    usage_by_primitive,
    usage_by_provenance,
)
from tracemill.operators.validation import validate
from tracemill.plans.health import integration_state
from tracemill.plans.marts import error_cell, headline, last_observed, overview
from tracemill.schemas import INVOCATION
from tracemill.workbook.registry import query


def event_facts(events: DataFrame) -> DataFrame:
    """Invocation records made of the events table, one per event."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (
        F.when(F.col("event_type") == "view", "skill")
        .when(F.col("event_type") == "purchase", "subagent")
        .when(F.col("event_type") == "error", "mcp_tool")
        .when(F.col("event_type") == "signup", "command")
        .otherwise("builtin_tool")
    )
    value = F.col("value")
    outcome = (
        F.when(value < 5, None)
        .when(value < 20, "error").when(value < 25, "timeout").when(value < 30, "denied_user")
        .when(value < 35, "interrupted").when(value < 40, "not_found").when(value < 45, "bad_args")
        .when(value < 50, "denied_policy").otherwise("ok")
    )
    user = F.col("user_id")
    invoker = F.when(user % 3 == 0, "user").when(user % 3 == 1, "model").otherwise("auto")
    made = {
        "schema_version": F.lit(1),
        "event_id": event_key(F.lit("events"), F.col("event_id").cast("string")),
        "ts": F.col("ts"),
        "harness": F.lit("events"),
        "session_id": F.concat(F.lit("u"), user),
        "repo": F.md5(F.concat(F.lit("r"), user % 10)),
        "kind": kind,
        "name": F.concat(F.col("event_type"), F.lit("-"), k % 7),
        "via_agent": F.when(user % 2 == 0, F.concat(F.lit("agent-"), user % 4)).otherwise(F.lit("")),
        "invoker": invoker,
        "outcome": outcome,
    }
    return events.select(
        *[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INVOCATION.fields]
    )


FACTS = """
facts AS (
  SELECT sha256('events' || chr(0) || event_id) AS event_id, ts, 'events' AS harness,
         'u' || user_id AS session_id,
         CASE event_type WHEN 'view' THEN 'skill' WHEN 'purchase' THEN 'subagent'
              WHEN 'error' THEN 'mcp_tool' WHEN 'signup' THEN 'command' ELSE 'builtin_tool' END AS kind,
         event_type || '-' || (CAST(json_extract(props, '$.k') AS BIGINT) % 7) AS name,
         CASE WHEN user_id % 2 = 0 THEN 'agent-' || (user_id % 4) ELSE '' END AS via_agent,
         CASE user_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'model' ELSE 'auto' END AS invoker,
         CASE WHEN value < 5 THEN NULL WHEN value < 20 THEN 'error' WHEN value < 25 THEN 'timeout'
              WHEN value < 30 THEN 'denied_user' WHEN value < 35 THEN 'interrupted'
              WHEN value < 40 THEN 'not_found' WHEN value < 45 THEN 'bad_args'
              WHEN value < 50 THEN 'denied_policy' ELSE 'ok' END AS outcome
  FROM events
), counted AS (
  SELECT * FROM facts WHERE kind NOT IN ('session_start', 'builtin_tool')
)"""
_FAILED = "outcome IN ('error', 'timeout', 'interrupted', 'not_found', 'bad_args')"
_COUNTS = f"""count(*) AS invocations, count(outcome) AS known,
       count(*) FILTER (outcome IS NULL) AS unknown, count(*) FILTER ({_FAILED}) AS failures"""
_PERCENT = f"count(*) FILTER ({_FAILED}) / nullif(count(outcome), 0) * 100 AS error_percent"


@query("usage_by_provenance", f"""WITH {FACTS}
SELECT name, kind, harness, invoker, via_agent, {_COUNTS},
       count(DISTINCT session_id) AS sessions, max(ts) AS last_used, {_PERCENT}
FROM counted GROUP BY name, kind, harness, invoker, via_agent
ORDER BY invocations DESC, harness, name, invoker, via_agent, kind""")
def _(spark, tables):
    return order_usage(usage_by_provenance(event_facts(tables("events"))))


@query("activity_summary", f"""WITH {FACTS}
SELECT {_COUNTS}, count(DISTINCT session_id) AS sessions, max(ts) AS last_observed, {_PERCENT} FROM counted""")
def _(spark, tables):
    return summary(event_facts(tables("events")))


@query("outcome_histogram", f"""WITH {FACTS}
SELECT outcome, count(*) AS invocations FROM counted WHERE outcome IS NOT NULL GROUP BY outcome""")
def _(spark, tables):
    return outcome_histogram(event_facts(tables("events")))


@query("usage_by_primitive", f"""WITH {FACTS}
SELECT harness, kind, name, count(*) AS invocations, count(*) FILTER ({_FAILED}) AS failures,
       count(*) FILTER (outcome IS NULL) AS unknown, max(ts) AS last_used
FROM counted GROUP BY harness, kind, name""")
def _(spark, tables):
    return usage_by_primitive(event_facts(tables("events")))


@query("error_ratios", f"""WITH {FACTS}
SELECT name, invoker, via_agent, kind, count(*) FILTER ({_FAILED}) AS numerator, count(outcome) AS denominator,
       count(*) FILTER (outcome IS NULL) AS excluded, count(*) AS total, {_PERCENT.replace('error_percent', 'percent')},
       true AS holds
FROM counted GROUP BY name, invoker, via_agent, kind""")
def _(spark, tables):
    usage = usage_by_provenance(event_facts(tables("events")))
    r = F.col("ratio")
    return usage.withColumn("ratio", ratio("failures", "known", "unknown", "invocations")).select(
        "name", "invoker", "via_agent", "kind", "ratio.*", ratio_percent(r).alias("percent"), ratio_holds(r).alias("holds")
    )


@query("terminal_filter", f"""WITH {FACTS}
SELECT kind, count(*) AS kept FROM counted GROUP BY kind""")
def _(spark, tables):
    return counted(event_facts(tables("events"))).groupBy("kind").agg(F.count(F.lit(1)).alias("kept"))


@query("failure_predicate", f"""WITH {FACTS}
SELECT outcome, coalesce({_FAILED}, false) AS failed, count(*) AS n FROM facts GROUP BY ALL""")
def _(spark, tables):
    facts = event_facts(tables("events"))
    return facts.groupBy("outcome", is_failure(F.col("outcome")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query("recent_usage", f"""WITH {FACTS}
SELECT harness, kind, name, count(*) AS invocations, count(*) FILTER ({_FAILED}) AS failures,
       count(*) FILTER (outcome IS NULL) AS unknown, max(ts) AS last_used
FROM counted WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY harness, kind, name""")
def _(spark, tables):
    return usage_by_primitive(event_facts(tables("events")), datetime(2024, 1, 24, tzinfo=timezone.utc))


@query("headline_numbers", f"""WITH {FACTS}
SELECT count(*) AS invocations, count(DISTINCT session_id) AS sessions FROM counted""")
def _(spark, tables):
    return headline(event_facts(tables("events")))


@query("last_observed", f"""WITH {FACTS}
SELECT coalesce(strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ'), 'not observed') AS last_observed FROM counted""")
def _(spark, tables):
    return last_observed(event_facts(tables("events")))


@query("overview_tiles", f"""WITH {FACTS}, t AS (
  SELECT {_COUNTS}, count(DISTINCT session_id) AS sessions, max(ts) AS last, {_PERCENT} FROM counted)
SELECT invocations, sessions,
       CASE WHEN error_percent IS NULL THEN 'not available' ELSE printf('%.1f', error_percent) || '%' END AS error_rate,
       failures || ' / ' || known || ' known; ' || unknown || ' excluded' AS error_detail,
       coalesce(strftime(last, '%b %d'), '-') AS last_observed,
       coalesce('Last observed ' || strftime(last, '%Y-%m-%d %H:%M'), 'No activity observed yet') AS updated,
       invocations = 0 AND (SELECT count(*) FROM part) = 0 AS is_empty FROM t""")
def _(spark, tables):
    return overview(event_facts(tables("events")), tables("part").select("p_partkey"))


@query("error_rate_text", f"""WITH {FACTS}
SELECT name, session_id, count(*) FILTER ({_FAILED}) AS failures,
       CASE WHEN count(*) FILTER ({_FAILED}) = 0 THEN '0'
            ELSE count(*) FILTER ({_FAILED}) || ' (' ||
                 printf('%.1f', count(*) FILTER ({_FAILED}) / nullif(count(outcome), 0) * 100) || '%)' END AS errors
FROM counted GROUP BY name, session_id""")
def _(spark, tables):
    per_session = counted(event_facts(tables("events"))).groupBy("name", "session_id").agg(
        F.count_if(is_failure(F.col("outcome"))).alias("failures"), F.count("outcome").alias("known"))
    return per_session.select("name", "session_id", "failures", error_cell(F.col("failures"), F.col("known")).alias("errors"))


@query("event_keys", """
SELECT event_id, sha256('events' || chr(0) || event_id) AS run_key,
       sha256('events' || chr(0) || 'e' || event_id || chr(31) || 'c' || user_id) AS call_key FROM events""")
def _(spark, tables):
    harness = F.lit("events")
    return tables("events").select(
        "event_id",
        event_key(harness, F.col("event_id").cast("string")).alias("run_key"),
        call_event_key(harness, F.concat(F.lit("e"), "event_id"), F.concat(F.lit("c"), "user_id")).alias("call_key"),
    )


@query("record_validation", """
SELECT CASE WHEN event_id % 11 = 0 THEN 'required field' WHEN event_id % 13 = 0 THEN 'optional field'
            WHEN event_id % 23 = 0 THEN 'source' WHEN event_id % 17 = 0 THEN 'outcome'
            WHEN event_id % 19 = 0 THEN 'duration' ELSE 'valid' END AS verdict, count(*) AS records
FROM events GROUP BY 1""")
def _(spark, tables):
    events = tables("events")
    facts = event_facts(events)
    numbered = events.select(event_key(F.lit("events"), F.col("event_id").cast("string")).alias("event_id"),
                             F.col("event_id").alias("nth"))
    n = F.col("nth")
    spoiled = facts.join(numbered, "event_id").select(
        *[c for c in facts.columns if c not in ("name", "model", "outcome", "duration_ms", "source")],
        F.when(n % 11 == 0, F.concat(F.lit("a/"), "name")).otherwise(F.col("name")).alias("name"),
        F.when(n % 13 == 0, "two words").alias("model"),
        F.when(n % 17 == 0, "fine").otherwise(F.col("outcome")).alias("outcome"),
        F.when(n % 19 == 0, F.lit(-1)).cast("bigint").alias("duration_ms"),
        F.when(n % 23 == 0, "web").alias("source"),
    )
    verdict = F.coalesce("invalid_reason", F.lit("valid")).alias("verdict")
    return validate(spoiled).groupBy(verdict).agg(F.count(F.lit(1)).alias("records"))


_TRIM = r"regexp_replace(word, '\A[\t\n\x0B\f\r\x{85}\p{Z}]+|[\t\n\x0B\f\r\x{85}\p{Z}]+\z', '', 'g')"


@query("bounded_domains", rf"""WITH words AS (
  SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents
  UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'customer', c_name || chr(10) FROM customer
), trimmed AS (SELECT lang, {_TRIM} AS w FROM words), judged AS (
  SELECT lang, w,
    regexp_matches(w, '\A[A-Za-z0-9][A-Za-z0-9._:@+-]{{0,127}}\z') AND NOT regexp_matches(w, '\A[A-Za-z]:') AS n,
    regexp_matches(w, '\A[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}\z') AS t,
    regexp_matches(w, '\A[A-Za-z0-9][A-Za-z0-9._+:-]{{0,127}}\z') AND NOT regexp_matches(w, '\A[A-Za-z]:') AS v
  FROM trimmed)
SELECT lang AS origin, count(*) AS words, count(*) FILTER (n) AS names, count(*) FILTER (t) AS tokens,
       count(*) FILTER (v) AS versions, count(DISTINCT CASE WHEN n THEN w END) AS distinct_names
FROM judged GROUP BY lang""")
def _(spark, tables):
    words = (
        tables("documents").select(F.col("lang").alias("origin"), F.explode(F.split("text", " ")).alias("word"))
        .unionByName(tables("pages").select(F.lit("url").alias("origin"), F.col("url").alias("word")))
        .unionByName(tables("customer").select(F.lit("customer").alias("origin"), F.concat("c_name", F.lit("\n")).alias("word")))
    )
    judged = words.select(
        "origin", bounded_name(F.col("word")).alias("name"), bounded_token(F.col("word")).alias("token"),
        bounded_version(F.col("word")).alias("version"),
    )
    return judged.groupBy("origin").agg(
        F.count(F.lit(1)).alias("words"), F.count("name").alias("names"), F.count("token").alias("tokens"),
        F.count("version").alias("versions"), F.countDistinct("name").alias("distinct_names"),
    )


def sql_hmac(key: bytes, text: str) -> str:
    """HMAC-SHA256 of a text expression in DuckDB SQL."""
    inner, outer = hmac_pads(key)
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({text}))))"


NAME_KEY = b"workbook name key"


@query("scoped_names", rf"""WITH refs AS (
  SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS scope,
         CASE WHEN page_id % 3 = 0 THEN 'run' ELSE 'p' || page_id END AS part FROM pages
  UNION ALL SELECT 1000000 + c_custkey, 'seg/' || lower(c_mktsegment), c_name FROM customer)
SELECT page_id AS ref,
       CASE WHEN page_id % 5 = 0 THEN part WHEN page_id % 7 = 0 THEN NULL
            WHEN contains(part, '#') THEN NULL
            WHEN strlen(scope || ':' || part) > 128 THEN NULL
            WHEN NOT contains(scope, '/') THEN scope || ':' || part
            WHEN ends_with(scope, '/') OR contains(scope, '//') OR contains(scope, ':') THEN NULL
            ELSE 'scope-' || substr({sql_hmac(NAME_KEY, 'scope')}, 1, 12) || ':' || part END AS name
FROM (SELECT page_id, scope, CASE WHEN page_id % 5 = 0 AND contains(part, '#') THEN NULL ELSE part END AS part FROM refs)""")
def _(spark, tables):
    refs = tables("pages").select(
        F.col("page_id").alias("ref"), F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("scope"),
        F.when(F.col("page_id") % 3 == 0, "run").otherwise(F.concat(F.lit("p"), "page_id")).alias("part"),
    ).unionByName(tables("customer").select(
        (F.lit(1000000) + F.col("c_custkey")).alias("ref"), F.concat(F.lit("seg/"), F.lower("c_mktsegment")).alias("scope"),
        F.col("c_name").alias("part"),
    ))
    value = (
        F.when(F.col("ref") % 5 == 0, F.col("part"))
        .when(F.col("ref") % 7 == 0, F.concat(F.lit("/"), "scope", F.lit(":"), "part"))
        .otherwise(F.concat("scope", F.lit(":"), "part"))
    )
    return refs.select("ref", derived_name(value, NAME_KEY).alias("name"))


@query("event_positions", f"""WITH {FACTS}
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM facts""")
def _(spark, tables):
    facts = event_facts(tables("events")).select("ts", "event_id")
    return with_positions(facts, ["ts", "event_id"]).select("event_id", "position")


@query("integration_states", """WITH days AS (
  SELECT CAST(ts AS DATE) AS day, user_id % 5 AS source, count(*) FILTER (event_type = 'error' AND value > 300) AS parse_errors,
         count(*) FILTER (event_type = 'view' AND value > 350) AS refused_calls,
         count(*) FILTER (event_type = 'purchase' AND value < 50) AS events_written
  FROM events GROUP BY 1, 2)
SELECT day, source, CASE WHEN parse_errors > 0 OR refused_calls > 0 THEN 'collects nothing'
       WHEN events_written = 0 THEN 'collects zero' ELSE 'collecting' END AS state FROM days""")
def _(spark, tables):
    kind, value = F.col("event_type"), F.col("value")
    days = tables("events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 5).alias("source")).agg(
        F.max("ts").alias("at"),
        F.count_if((kind == "error") & (value > 300)).alias("parse_errors"),
        F.count_if((kind == "view") & (value > 350)).alias("refused_calls"),
        F.count_if((kind == "purchase") & (value < 50)).alias("events_written"),
        F.lit(0).alias("unreadable"), F.lit(0).alias("refused_projects"),
    )
    return days.select("day", "source", integration_state(F.lit(True), F.lit(True)).alias("state"))
