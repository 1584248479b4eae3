"""Project transcript entries onto calls, results and skill-run candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.classify import (
    kind_for,
    outcome_from,
    package_from_attribution,
    primitive_name,
)
from tracemill.functions.digests import call_event_key, event_key
from tracemill.functions.domains import bounded_name, bounded_token, bounded_version, derived_name
from tracemill.schemas import INVOCATION, RECORD_VERSION
from tracemill.sources.transcripts import explode_blocks


def candidate_shape() -> Column:
    """A finished, attributed turn of the main conversation."""
    return F.coalesce(
        (F.col("stop_reason") == "end_turn") & (F.col("via_skill") != "") & ~F.col("sidechain"),
        F.lit(False),
    )


def acting_entries(entries: DataFrame) -> DataFrame:
    """Valid entries that hold a tool call or a skill-run candidate: the ones consent decides on."""
    has_use = F.exists("blocks", lambda b: b["type"] == "tool_use")
    return entries.where((F.col("status") == "entry") & (has_use | candidate_shape()))


def project_calls(acting: DataFrame, name_key: bytes | None, harness: str) -> DataFrame:
    """Tool-use blocks as (file, call_id, position, status, session, name, call).

    ``acting`` carries (repo, consented). The order of the gates is part of the result:
    an unusable id or session, then missing consent, make a call skipped; only a call
    past those can be refused for its name. One CASE expression fixes that order.
    """
    blocks = explode_blocks(acting).where(F.col("b.type") == "tool_use")
    raw_id = F.coalesce("b.id", F.lit(""))
    staged = blocks.select(
        "file",
        "chunk",
        "line",
        F.col("b.block").alias("block"),
        raw_id.alias("raw_id"),
        bounded_token(raw_id).alias("token_id"),
        F.col("seen_session").alias("session"),
        "consented",
        "repo",
        "ts",
        "uuid",
        F.coalesce("b.name", F.lit("")).alias("tool"),
        primitive_name(F.coalesce("b.name", F.lit("")), F.col("b.skill"), F.col("b.subagent_type"), name_key).alias("name"),
        bounded_version(F.col("version")).alias("version"),
        bounded_name(F.col("model")).alias("model"),
        derived_name(F.col("via_skill"), name_key).alias("via_skill"),
        derived_name(F.col("via_agent"), name_key).alias("via_agent"),
        package_from_attribution(F.col("mcp_server")).alias("package"),
    )
    status = (
        F.when(F.col("token_id").isNull() | F.col("session").isNull(), F.lit("skipped"))
        .when(~F.col("consented"), F.lit("skipped"))
        .when(F.col("name").isNull(), F.lit("refused"))
        .otherwise(F.lit("accepted"))
    )
    call = F.struct(
        call_event_key(F.lit(harness), F.col("uuid"), F.col("token_id")).alias("event_id"),
        F.col("session").alias("session_id"),
        F.col("ts"),
        F.lit(harness).alias("harness"),
        F.col("version").alias("harness_version"),
        kind_for(F.col("tool")).alias("kind"),
        F.col("name"),
        F.col("package"),
        F.col("via_skill"),
        F.col("via_agent"),
        F.col("model"),
        F.lit("model").alias("invoker"),
        F.col("repo"),
    )
    return staged.withColumn("status", status).select(
        "file",
        # A voided call is matched by the id as written; an accepted one by its token.
        F.when(F.col("status") == "accepted", F.col("token_id")).otherwise(F.col("raw_id")).alias("call_id"),
        "chunk",
        "line",
        "block",
        "status",
        "session",
        "name",
        F.when(F.col("status") == "accepted", call).alias("call"),
    )


def project_results(entries: DataFrame) -> DataFrame:
    """Tool-result blocks as (file, call_id, position, result<ts, outcome>)."""
    blocks = explode_blocks(
        entries.select("file", "chunk", "line", "ts", "status", "denial", "interrupted", "blocks")
    ).where(F.col("b.type") == "tool_result")
    return blocks.select(
        "file",
        F.coalesce("b.tool_use_id", F.lit("")).alias("call_id"),
        "chunk",
        "line",
        F.col("b.block").alias("block"),
        F.struct(
            "ts", outcome_from(F.col("denial"), F.col("interrupted"), F.col("b.is_error")).alias("outcome")
        ).alias("result"),
    )


def addressable(rows: DataFrame) -> DataFrame:
    """Rows whose call id an accepted call could have; others can never meet one."""
    return rows.where(bounded_token(F.col("call_id")) == F.col("call_id"))


def invocation(call: str, ts: Column, outcome: Column) -> list[Column]:
    """The fact columns of a finished call: its own fields, the given instant and outcome."""
    known = {
        "schema_version": F.lit(RECORD_VERSION),
        "ts": ts,
        "outcome": outcome,
    }
    own = {
        "event_id", "harness", "harness_version", "session_id", "repo", "kind", "name",
        "package", "via_skill", "via_agent", "model", "invoker",
    }
    columns = []
    for field in INVOCATION.fields:
        if field.name in known:
            value = known[field.name]
        elif field.name in own:
            value = F.col(f"{call}.{field.name}")
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return columns


def skill_candidates(acting: DataFrame, name_key: bytes | None, harness: str) -> DataFrame:
    """Candidate skill runs as (file, session, name, record): user invoked, outcome unknown."""
    named = acting.where(candidate_shape()).select(
        "file",
        F.col("seen_session").alias("session"),
        derived_name(F.col("via_skill"), name_key).alias("name"),
        "ts",
        "uuid",
        "repo",
        "consented",
        bounded_version(F.col("version")).alias("harness_version"),
        bounded_name(F.col("model")).alias("model"),
    )
    kept = named.where(F.col("name").isNotNull() & F.col("session").isNotNull() & F.col("consented"))
    run = F.struct(
        event_key(F.lit(harness), F.col("uuid")).alias("event_id"),
        F.col("session").alias("session_id"),
        F.col("ts"),
        F.lit(harness).alias("harness"),
        F.col("harness_version"),
        F.lit("skill").alias("kind"),
        F.col("name"),
        F.lit(None).cast("string").alias("package"),
        F.lit(None).cast("string").alias("via_skill"),
        F.lit(None).cast("string").alias("via_agent"),
        F.col("model"),
        F.lit("user").alias("invoker"),
        F.col("repo"),
    )
    return kept.select("file", "session", "name", run.alias("record"))
