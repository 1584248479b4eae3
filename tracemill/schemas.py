"""Schemas and enumerations of the data model.

Everything below the "fixed values" lines must keep these exact spellings, because
stored records and consent tables written elsewhere carry them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Format versions.
RECORD_VERSION = 1
CONSENT_VERSION = 1
SNAPSHOT_VERSION = 1
COUNTERS_VERSION = 3

# The harness whose transcripts are read, unless a job names another.
DEFAULT_HARNESS = "claude-code"

# The transcript line cap in bytes of readers with a line buffer. No cap is in force unless a job
# passes one.
TRANSCRIPT_LINE_CAP = 1024 * 1024

# Enumerations of an invocation record.
KINDS = [
    "skill",
    "subagent",
    "mcp_tool",
    "mcp_server",
    "command",
    "plugin",
    "builtin_tool",
    "hook",
    "session_start",
    "session_end",
]
SOURCES = ["marketplace", "local", "builtin"]
INVOKERS = ["user", "model", "auto"]
OUTCOMES = [
    "ok",
    "error",
    "denied_policy",
    "denied_user",
    "timeout",
    "interrupted",
    "not_found",
    "bad_args",
]
FAILURES = ["error", "timeout", "interrupted", "not_found", "bad_args"]

# Kinds a usage snapshot may list.
SNAPSHOT_KINDS = ["skill", "subagent", "mcp_tool", "mcp_server", "command", "plugin", "hook"]

INVOCATION = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("harness", T.StringType()),
        T.StructField("harness_version", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("package", T.StringType()),
        T.StructField("package_version", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("via_skill", T.StringType()),
        T.StructField("via_agent", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("effort", T.StringType()),
        T.StructField("invoker", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)
INVOCATION_COLUMNS = INVOCATION.fieldNames()

# A framed transcript line. (chunk, line) orders the lines of one file: chunk is the
# start of the input split (or a coarse byte bucket of a feed), line orders inside it.
LINES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("nbytes", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("oversize", T.BooleanType()),
    ]
)

USAGE_SNAPSHOT = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("refreshed_at", T.TimestampType()),
        T.StructField("harness", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("invocations", T.LongType()),
        T.StructField("failures", T.LongType()),
        T.StructField("unknown", T.LongType()),
        T.StructField("last_used", T.TimestampType()),
    ]
)

COUNTER_NAMES = [
    "transcripts",
    "unreadable",
    "parse_errors",
    "skipped",
    "events_written",
    "refused_projects",
    "refused_calls",
    "pending_calls",
    "interrupted_calls",
    "ambiguous_skill_runs",
]
SCAN_COUNTERS = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("at", T.TimestampType())]
    + [T.StructField(name, T.LongType()) for name in COUNTER_NAMES]
)
HOOK_NAMES = ["installed", "removed", "kept_owned"]
HOOK_COUNTERS = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("at", T.TimestampType())]
    + [T.StructField(name, T.LongType()) for name in HOOK_NAMES]
)
