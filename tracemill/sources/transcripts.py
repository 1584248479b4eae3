"""Decode framed transcript lines into narrow, typed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.domains import bounded_token
from tracemill.sources import typed_json as J
from tracemill.sources.catalog_files import ATTACHMENT, announced_names, may_announce

# The text fields of an entry, as (JSON path, column).
TEXT_FIELDS = [
    ("uuid", "uuid"),
    ("sessionId", "session"),
    ("cwd", "cwd"),
    ("version", "version"),
    ("attributionMcpServer", "mcp_server"),
    ("attributionMcpTool", "mcp_tool"),
    ("attributionAgent", "via_agent"),
    ("attributionSkill", "via_skill"),
    ("toolDenialKind", "denial"),
    ("message.model", "model"),
    ("message.stop_reason", "stop_reason"),
]

RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parse_instant(text: Column) -> Column:
    """RFC 3339 instant at microsecond precision (further digits are cut), else NULL."""
    micros = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(micros))


def _blocks(opened: Column) -> Column:
    """Content blocks with their typed fields, from their members.

    One step after the other: a lambda's variable is computed once, an expression inside it
    every time it is mentioned.
    """
    given = F.transform(opened, lambda own: F.struct(own.alias("own"), J.members(own["input"], "skill", "subagent_type").alias("input")))
    return F.transform(given, _block)


def _block(opened: Column, position: Column) -> Column:
    own, given = opened["own"], opened["input"]
    kind, call_id, tool, answers = (J.leaf(own[n], "STRING", "string") for n in ("type", "id", "name", "tool_use_id"))
    failed = J.leaf(own["is_error"], "BOOLEAN", "boolean")
    skill, subagent = (J.leaf(given[n], "STRING", "string") for n in ("skill", "subagent_type"))
    fits = J.all_fit(
        J.members_fit(own["input"], given),
        *(f.fits for f in (kind, call_id, tool, answers, failed, skill, subagent)),
    )
    return F.struct(
        position.cast("int").alias("block"),
        kind.value.alias("type"),
        call_id.value.alias("id"),
        tool.value.alias("name"),
        answers.value.alias("tool_use_id"),
        failed.value.alias("is_error"),
        skill.value.alias("skill"),
        subagent.value.alias("subagent_type"),
        fits.alias("fits"),
    )


def _once(rows: DataFrame, passthrough: list[str], **made: Column) -> DataFrame:
    """Columns computed once per row, behind a one-row generator.

    Filters that consumers add are pushed down to here but not through it, so no condition
    ever parses a line a second time.
    """
    return rows.select(*passthrough, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _made(rows: DataFrame, passthrough: list[str], **made: Column) -> DataFrame:
    """Columns as a plain projection; Spark keeps it apart from the next one where that mentions a column more than once."""
    return rows.select(*passthrough, *[c.alias(n) for n, c in made.items()])


def decode_entries(lines: DataFrame, announced: bool = False) -> DataFrame:
    """One row per line with its typed fields and a three-way verdict.

    ``status`` is entry, malformed or oversize. ``blind`` marks a line that could have
    hidden the end of a call: broken syntax, a timestamp that does not parse, or a
    malformed line that still shows a tool result. ``seen_session``/``seen_ts`` name the
    session activity a line proves, even when the line has no entry.

    Each line is parsed once. Only identifiers, flags and instants leave this step;
    prompt and result text stay behind. With ``announced`` the column of that name holds
    the (cwd, kind, name) that a session listing announces, NULL for any other line.
    """
    passthrough = [c for c in lines.columns if c not in ("value", "oversize")]
    kept = [*passthrough, "oversize"]
    top = dict.fromkeys([path.split(".")[0] for path, _ in TEXT_FIELDS] + ["isSidechain", "timestamp", "toolUseResult"])
    if announced:
        top["attachment"] = None
    listing = {"_lists": may_announce(F.col("value"))} if announced else {}
    parsed = _made(lines, kept, _text=F.col("value"), _read=J.read(F.col("value"), *top), **listing)
    opened = parsed.select(*kept, *listing, J.opened(F.col("_text"), F.col("_read")).alias("_doc"))
    line = F.col("_line")
    given = {"_given": J.members(line["attachment"], *ATTACHMENT)} if announced else {}
    opened = opened.select(*kept, *listing, F.col("_doc.sound").alias("_sound"), F.col("_doc.root").alias("_line")).select(
        *kept, *listing, "_sound", "_line",
        J.members(line["message"], "model", "stop_reason", "content").alias("_message"),
        J.members(line["toolUseResult"], "interrupted").alias("_result"),
        *(c.alias(n) for n, c in given.items()),
    )
    if announced:
        names = announced_names(line["cwd"], line["attachment"], F.col("_given"))
        opened = _made(opened, [*kept, "_sound", "_line", "_message", "_result"], announced=F.when(F.col("_lists"), names))
        passthrough, kept = [*passthrough, "announced"], [*kept, "announced"]
    message = F.col("_message")
    content = J.objects(message["content"], "type", "id", "name", "tool_use_id", "is_error", "input")
    opened = opened.select("*", content.value.alias("_members"), content.fits.alias("_content_fits")).select(
        *kept, "_sound", "_line", "_message", "_result", "_content_fits", _blocks(F.col("_members")).alias("_blocks"))
    text = {}
    for path, name in TEXT_FIELDS:
        holder = message if path.startswith("message.") else line
        text[name] = J.leaf(holder[path.removeprefix("message.")], "STRING", "string")
    sidechain = J.leaf(line["isSidechain"], "BOOLEAN", "boolean")
    stamp = J.leaf(line["timestamp"], "STRING", "string")
    interrupted = J.leaf(F.col("_result")["interrupted"], "BOOLEAN", "boolean")
    typed = _made(
        opened, kept,
        syntax_ok=F.col("_sound"),
        **{name: f.value for name, f in text.items()},
        sidechain=sidechain.value,
        stamp=stamp.value,
        stamp_fits=stamp.fits,
        interrupted=F.coalesce(interrupted.value, F.lit(False)),
        content=F.coalesce("_blocks", F.array()),
        fits=J.all_fit(
            *(f.fits for f in text.values()), sidechain.fits, J.members_fit(line["message"], message), F.col("_content_fits")
        ),
    )

    zero = F.lit("0001-01-01T00:00:00Z").cast("timestamp")
    names = [name for _, name in TEXT_FIELDS]
    carried = {n: F.col(n) for n in (*names, "syntax_ok", "sidechain", "interrupted")}
    dated = _made(
        typed, kept, **carried,
        instant=parse_instant(F.col("stamp")),
        stamp_absent=F.col("stamp_fits") & F.col("stamp").isNull(),
        seen=bounded_token(F.col("session")),
        uuid_ok=bounded_token(F.col("uuid")).isNotNull(),
        fits=F.col("fits") & F.forall("content", lambda block: block["fits"]),
        shows_result=F.exists("content", lambda block: F.coalesce(block["type"] == "tool_result", F.lit(False))),
        relevant=F.transform(
            F.filter("content", lambda block: F.coalesce(block["type"].isin("tool_use", "tool_result"), F.lit(False))),
            lambda block: block.dropFields("fits"),
        ),
    )
    # A wrongly typed stamp reads as NULL, so it has no instant and is not absent.
    stamp_ok = F.col("stamp_absent") | F.col("instant").isNotNull()
    ts = F.when(F.col("instant") != zero, F.col("instant"))
    entry = (
        F.col("syntax_ok") & stamp_ok & F.col("fits") & ts.isNotNull()
        & (F.coalesce(F.col("session"), F.lit("")) != "") & F.coalesce("uuid_ok", F.lit(False))
    )
    blind = ~F.col("syntax_ok") | ~stamp_ok | (~entry & F.col("shows_result"))
    keep = ["uuid", "cwd", "version", "mcp_server", "via_agent", "via_skill", "denial", "model", "stop_reason"]
    judged = _made(
        dated, kept, **{n: F.col(n) for n in (*keep, "fits", "sidechain", "interrupted", "seen", "relevant")},
        instant=ts,
        status=F.when(F.col("oversize"), F.lit("oversize")).when(entry, F.lit("entry")).otherwise(F.lit("malformed")),
        blind=~F.col("oversize") & F.coalesce(blind, F.lit(True)),
    )
    # The one generator of the step: behind it, as in a stage too long to compile, expressions are interpreted.
    judged = _once(judged, kept, **{n: F.col(n) for n in judged.columns if n not in kept})
    is_entry = F.col("status") == "entry"
    return judged.select(
        *passthrough,
        "status",
        "blind",
        F.when(F.col("instant").isNotNull(), F.col("seen")).alias("seen_session"),
        F.when(F.col("seen").isNotNull(), F.col("instant")).alias("seen_ts"),
        *(F.when(is_entry, F.col(name)).alias(name) for name in keep),
        F.when(is_entry, F.col("instant")).alias("ts"),
        F.when(is_entry, F.coalesce("sidechain", F.lit(False))).alias("sidechain"),
        F.when(is_entry, F.col("interrupted")).alias("interrupted"),
        F.when(is_entry, F.col("relevant")).alias("blocks"),
        malformed_reason().alias("malformed_reason"),
    )


def malformed_reason() -> Column:
    """Finer split of the malformed count: routine bookkeeping, blind, mistyped, oversize."""
    return (
        F.when(F.col("oversize"), F.lit("oversize"))
        .when(F.col("status") == "entry", None)
        .when(F.col("blind"), F.lit("blind"))
        .when(~F.col("fits"), F.lit("mistyped"))
        .otherwise(F.lit("bookkeeping"))
    )


def explode_blocks(entries: DataFrame) -> DataFrame:
    """One row per tool-use or tool-result block of the valid entries, order kept."""
    valid = entries.where((F.col("status") == "entry") & (F.size("blocks") > 0))
    return valid.withColumn("b", F.explode("blocks")).drop("blocks")
