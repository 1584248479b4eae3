"""Strictly typed reads out of a JSON variant.

``from_json`` would turn a number into a string and silently drop a bad field. These
builders return the value together with whether the JSON type was the expected one;
an absent field or a JSON null is always acceptable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# A document is parsed as the first element of an array closed by this marker. The JSON
# parser stops at the end of the first value, so text after a complete object would pass
# unnoticed; inside the array it breaks the syntax or hides the marker.
_END = "end-of-document"
ROOT = "$[0]"


def parse(text: Column) -> Column:
    """The document as a variant whose root is at ``ROOT``; NULL when the syntax is broken."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    closed = (F.try_variant_get(wrapped, "$[1]", "string") == _END) & F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return F.when(closed, wrapped)


_MARK = "end-of-document"
# The syntax that ``parse`` accepts: strict JSON.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# A variant is bounded; a longer text is first parsed as a whole, as its members alone could still fit.
_WHOLE_BYTES = 8 * 1024 * 1024


def read(text: Column, *names: str) -> Column:
    """The named members of the object that ``text`` holds, each a variant of its own, for :func:`opened`; nothing else is built."""
    fields = ", ".join(f"`{n}`: variant" for n in (*names, _MARK))
    return F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{_MARK}":true}}]')), f"array<struct<{fields}>>", _STRICT)


def opened(text: Column, found: Column) -> Column:
    """(sound, root) of a text from which ``found`` was read: does :func:`parse` accept it, and its members, NULL of anything but an object."""
    ended = F.coalesce(F.try_variant_get(F.get(found, F.lit(1))[_MARK], "$", "boolean"), F.lit(False))
    plain = found.isNotNull() & (F.octet_length(text) <= _WHOLE_BYTES) & ~text.contains(_MARK)
    sound = F.when(plain, (F.size(found) == 2) & ended).otherwise(parse(text).isNotNull())
    return F.struct(sound.alias("sound"), F.when(sound, F.get(found, F.lit(0))).alias("root"))


@dataclass(frozen=True)
class Typed:
    value: Column
    fits: Column


def _present(raw: Column) -> Column:
    return raw.isNotNull() & ~F.is_variant_null(raw)


def scalar(doc: Column, path: str, json_type: str, sql_type: str) -> Typed:
    raw = F.try_variant_get(doc, path, "variant")
    shape = F.schema_of_variant(raw)
    matches = shape == json_type
    return Typed(
        F.when(matches, F.try_variant_get(doc, path, sql_type)),
        raw.isNull() | shape.isin(json_type, "VOID"),
    )


def leaf(raw: Column, json_type: str, sql_type: str) -> Typed:
    """A variant that stands for one field: its value if it has the JSON type."""
    shape = F.schema_of_variant(raw)
    return Typed(
        F.when(shape == json_type, F.try_variant_get(raw, "$", sql_type)),
        raw.isNull() | shape.isin(json_type, "VOID"),
    )


def members(raw: Column, *names: str) -> Column:
    """The named members of a JSON object as a struct of variants, in one step; NULL for anything else."""
    return F.try_variant_get(raw, "$", f"struct<{', '.join(f'`{n}`: variant' for n in names)}>")


def members_fit(raw: Column, found: Column) -> Column:
    """Is ``raw``, from which ``found`` was taken, an object, absent or a JSON null?"""
    return found.isNotNull() | raw.isNull() | F.coalesce(F.is_variant_null(raw), F.lit(False))


def string(doc: Column, path: str) -> Typed:
    return scalar(doc, path, "STRING", "string")


def boolean(doc: Column, path: str) -> Typed:
    return scalar(doc, path, "BOOLEAN", "boolean")


def integer(doc: Column, path: str) -> Typed:
    return scalar(doc, path, "BIGINT", "bigint")


def is_object(value: Column) -> Column:
    """Null-safe test that a variant holds a JSON object; nothing nested is copied."""
    return F.coalesce(F.try_variant_get(value, "$", "struct<_: variant>").isNotNull(), F.lit(False))


def object_fits(doc: Column, path: str) -> Column:
    raw = F.try_variant_get(doc, path, "variant")
    return ~F.coalesce(_present(raw), F.lit(False)) | is_object(raw)


def elements(doc: Column, path: str) -> Typed:
    """A JSON array as an array of variants."""
    raw = F.try_variant_get(doc, path, "variant")
    items = F.try_variant_get(doc, path, "array<variant>")
    return Typed(items, ~F.coalesce(_present(raw), F.lit(False)) | items.isNotNull())


def objects(raw: Column, *names: str) -> Typed:
    """A JSON array of objects as their named members; it fits if its elements are objects or JSON nulls, which read as NULL."""
    items = elements(raw, "$")
    found = F.try_variant_get(raw, "$", f"array<struct<{', '.join(f'`{n}`: variant' for n in names)}>>")
    # Only an element without members is looked at again.
    nulls = F.forall(items.value, lambda item: is_object(item) | F.coalesce(F.is_variant_null(item), F.lit(False)))
    whole = F.size(F.array_compact(found)) == F.size(found)
    return Typed(found, items.fits & F.when(found.isNull() | whole, F.lit(True)).otherwise(nulls))


def string_list(doc: Column, path: str) -> Typed:
    """A JSON array of strings; a null element reads as the empty string."""
    items = elements(doc, path)
    shape_ok = F.forall(
        items.value, lambda item: F.coalesce(F.schema_of_variant(item), F.lit("VOID")).isin("STRING", "VOID")
    )
    values = F.transform(
        items.value, lambda item: F.coalesce(F.try_variant_get(item, "$", "string"), F.lit(""))
    )
    return Typed(values, items.fits & F.coalesce(shape_ok, F.lit(True)))


def strings(raw: Column) -> Typed:
    """A JSON array of strings that stands for one field, as in :func:`string_list`; its type is looked at once, not that of each element."""
    shape = F.schema_of_variant(raw)
    values = F.transform(F.try_variant_get(raw, "$", "array<string>"), lambda item: F.coalesce(item, F.lit("")))
    return Typed(values, raw.isNull() | shape.isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"))


def all_fit(*fits: Column) -> Column:
    result = F.lit(True)
    for fit in fits:
        result = result & fit
    return result
