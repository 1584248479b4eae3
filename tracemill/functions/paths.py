"""Lexical path arithmetic on absolute paths, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_absolute(path: Column) -> Column:
    """Shortest equivalent spelling of an absolute path; NULL for a relative one."""
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        parts,
        empty,
        lambda seen, part: F.when(
            part == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))
        ).otherwise(F.concat(seen, F.array(part))),
    )
    kept = F.when(F.array_contains(parts, ".."), resolved).otherwise(parts)
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/")))


def ancestors(cleaned: Column) -> Column:
    """Every path that encloses ``cleaned`` element-wise, itself included."""
    parts = F.split(cleaned, "/")
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")),
        )
    )


def separator_prefixes(path: Column) -> Column:
    """The path itself and whatever stands before each ``/`` in it, without cleaning."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
