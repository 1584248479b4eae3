"""Classification rules of a call and of a stored record, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.domains import bounded_name, derived_name
from tracemill.schemas import FAILURES


def kind_for(tool: Column) -> Column:
    return (
        F.when(tool == "Skill", F.lit("skill"))
        .when(tool == "Task", F.lit("subagent"))
        .when(tool.startswith("mcp__") & (F.octet_length(tool) > 5), F.lit("mcp_tool"))
        .otherwise(F.lit("builtin_tool"))
    )


def primitive_name(tool: Column, skill: Column, subagent_type: Column, key: bytes | None) -> Column:
    """Name a call is counted under; NULL when it has to be refused.

    A ``Task`` never falls back to its tool name.
    """
    return (
        F.when((tool == "Skill") & (F.coalesce(skill, F.lit("")) != ""), derived_name(skill, key))
        .when(tool == "Task", derived_name(F.coalesce(subagent_type, F.lit("")), key))
        .otherwise(bounded_name(tool))
    )


def package_from_attribution(server: Column) -> Column:
    """``plugin:<package>:...`` names the package; anything else names none."""
    package = F.regexp_extract(server, r"(?s)\Aplugin:([^:]*):", 1)
    return bounded_name(package)


def outcome_from(denial: Column, interrupted: Column, is_error: Column) -> Column:
    """First matching rule wins; NULL is "the harness did not say"."""
    return (
        F.when(denial == "permission-rule", F.lit("denied_policy"))
        .when(denial == "user-rejected", F.lit("denied_user"))
        .when(interrupted, F.lit("interrupted"))
        .when(is_error, F.lit("error"))
        .when(~is_error, F.lit("ok"))
    )


def is_failure(outcome: Column) -> Column:
    """Denials are known outcomes but not failures."""
    return F.coalesce(outcome.isin(FAILURES), F.lit(False))


def is_counted(kind: Column) -> Column:
    """Records every aggregate starts from: terminal, and not a built-in tool."""
    return ~kind.isin("session_start", "builtin_tool")
