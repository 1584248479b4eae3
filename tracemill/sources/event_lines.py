"""Import records kept as one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.sessions import with_line_offsets
from tracemill.operators.validation import validate
from tracemill.schemas import INVOCATION, INVOCATION_COLUMNS
from tracemill.sources import typed_json as J
from tracemill.sources.transcripts import parse_instant


def decode_records(lines: DataFrame) -> DataFrame:
    """Valid records of (file, chunk, line, value) rows; anything else is left out.

    Empty strings of optional fields become NULL, the one spelling of "absent".
    """
    doc = F.col("doc")
    fields = {}
    for field in INVOCATION.fields:
        path = f"{J.ROOT}.{field.name}"
        if field.dataType.typeName() in ("long", "integer"):
            fields[field.name] = J.integer(doc, path)
        else:
            fields[field.name] = J.string(doc, path)
    optional = {"harness_version", "package", "package_version", "via_skill", "via_agent", "model", "effort"}
    columns = []
    for field in INVOCATION.fields:
        value = fields[field.name].value
        if field.name == "ts":
            value = parse_instant(value)
        elif field.name in optional:
            value = F.nullif(value, F.lit(""))
        columns.append(value.cast(field.dataType).alias(field.name))
    keep = [c for c in lines.columns if c not in ("value", "oversize")]
    parsed = lines.select(*keep, J.parse(F.col("value")).alias("doc"))
    fits = doc.isNotNull() & J.all_fit(*(f.fits for f in fields.values()))
    # The one-row generator keeps later filters from parsing a line again.
    typed = parsed.select(*keep, F.inline(F.array(F.struct(fits.alias("fits"), *columns)))).where("fits").drop("fits")
    return validate(typed).where("invalid_reason is null").drop("invalid_reason")


def complete_lines(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines ended by a newline; ``sizes`` is (file, length).

    The byte after the last line tells: a file that ends in a newline is exactly as long
    as its lines with theirs.
    """
    ends = with_line_offsets(lines.select("file", "chunk", "line", "nbytes"))
    partial = ends.join(sizes, "file").where(F.col("offset") + F.col("nbytes") > F.col("length"))
    return lines.join(partial.select("file", "chunk", "line"), ["file", "chunk", "line"], "left_anti")


def read_event_lines(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records of complete lines, with (file, chunk, line) as their write order."""
    return decode_records(complete_lines(lines, sizes)).select(
        *INVOCATION_COLUMNS, "file", "chunk", "line"
    )
