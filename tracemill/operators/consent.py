"""Resolve working directories against consented roots, and audit the consent table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.digests import hmac_hex
from tracemill.functions.paths import ancestors, clean_absolute, separator_prefixes

# Collection scopes: everything ever recorded, or only what lies inside the window a
# repository was registered with.
WHOLE_HISTORY = "history"
CONSENTED_WINDOW = "window"


def root_spellings(consent: DataFrame) -> DataFrame:
    """One row per spelling (root or alias): entry, id, collect_from, spelling, fold, key.

    ``key`` is what an ancestor of a working directory has to equal; it is lower-cased
    when the entry ignores case.
    """
    spelled = consent.select(
        "entry",
        "id",
        "collect_from",
        F.coalesce("case_insensitive", F.lit(False)).alias("fold"),
        F.posexplode(F.concat(F.array("root"), F.coalesce("aliases", F.array().cast("array<string>")))).alias(
            "spelling_no", "spelling"
        ),
    )
    return spelled.withColumn("key", _fold_key(F.col("fold"), F.col("spelling")))


def _fold_key(fold: Column, path: Column) -> Column:
    return F.when(fold, F.lower(path)).otherwise(path)


def resolve_directories(cwds: DataFrame, consent: DataFrame, salt: bytes) -> DataFrame:
    """cwd -> (cwd, root, repo, matched, collect_from): longest enclosing root wins.

    ``cwds`` needs a ``cwd`` column; duplicates are collapsed before anything else, so
    the cost follows the number of distinct directories. "Is an ancestor of" becomes an
    equality on exploded ancestors: a plain equi-join that Spark broadcasts only when
    the consent side measures small, and hash- or sort-merges otherwise. A directory
    under no root gets its own keyed digest and matched = false; one that is not
    absolute gets neither.
    """
    distinct = cwds.where(F.col("cwd").isNotNull()).select("cwd").distinct()
    cleaned = distinct.withColumn("clean", clean_absolute(F.col("cwd")))
    probes = cleaned.where(F.col("clean").isNotNull()).select(
        "cwd", F.explode(F.array(F.lit(False), F.lit(True))).alias("fold"), "clean"
    )
    probes = probes.select(
        "cwd", "fold", F.explode(ancestors(_fold_key(F.col("fold"), F.col("clean")))).alias("key")
    )
    # The longest spelling wins, then table order.
    rank = F.struct(-F.octet_length("spelling"), "entry", "spelling_no")
    best = (
        probes.join(root_spellings(consent), ["fold", "key"])
        .groupBy("cwd")
        .agg(F.min_by(F.struct("spelling", "id", "collect_from"), rank).alias("hit"))
    )
    own = F.substr(hmac_hex(salt, F.col("clean")), F.lit(1), F.lit(32))
    return cleaned.join(best, "cwd", "left").select(
        "cwd",
        F.col("hit.spelling").alias("root"),
        F.coalesce(F.col("hit.id"), own).alias("repo"),
        F.col("hit").isNotNull().alias("matched"),
        F.col("hit.collect_from").alias("collect_from"),
    )


def attach_consent(rows: DataFrame, directories: DataFrame, scope: str) -> DataFrame:
    """Add (repo, consented) to rows that carry (cwd, ts).

    ``scope`` = "history" ignores collection windows; "window" keeps an instant that is
    not before the window of its repository. The join key is skewed when one directory
    dominates; the directory side is one row per key, so adaptive execution can split
    the hot partition of the row side freely.
    """
    joined = rows.join(directories.select("cwd", "repo", "matched", "collect_from"), "cwd", "left")
    inside = F.coalesce(F.col("ts") >= F.col("collect_from"), F.lit(True))
    allowed = F.coalesce("matched", F.lit(False))
    if scope == CONSENTED_WINDOW:
        allowed = allowed & inside
    elif scope != WHOLE_HISTORY:
        raise ValueError(f"unknown collection scope {scope!r}")
    return joined.withColumn("consented", allowed).drop("matched", "collect_from")


def under_roots(rows: DataFrame, roots: DataFrame, column: str = "cwd") -> DataFrame:
    """Rows whose path equals one of ``roots(root)`` or lies below it; no cleaning, no case fold.

    Distinct paths are tested once, and only then filter the rows.
    """
    paths = rows.select(column).distinct()
    hits = (
        paths.select(column, F.explode(separator_prefixes(F.col(column))).alias("root"))
        .join(roots.select("root").distinct(), "root", "left_semi")
        .select(column)
        .distinct()
    )
    return rows.join(hits, column, "left_semi")


def _shared_values(exploded: DataFrame, value: str) -> DataFrame:
    """Values that more than one entry carries, by a combining count (never a window)."""
    return exploded.groupBy(value).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(value)


def ambiguous_entries(consent: DataFrame) -> DataFrame:
    """entry numbers of all members of a set that shares an id, a root or a spelling.

    A spelling an entry repeats itself counts twice, too.
    """
    spelled = root_spellings(consent)
    by_id = consent.join(_shared_values(consent, "id"), "id", "left_semi").select("entry")
    by_root = consent.join(_shared_values(consent, "root"), "root", "left_semi").select("entry")
    by_spelling = spelled.join(_shared_values(spelled, "spelling"), "spelling", "left_semi").select("entry")
    return by_id.union(by_root).union(by_spelling).distinct()


def nested_roots(consent: DataFrame) -> DataFrame:
    """Audit: (entry, id, relation, other_id) for roots that enclose one another.

    ``relation`` is "inside" when another entry's spelling is an ancestor of (or equal
    to) one of this entry's, "contains" for the reverse. Case is ignored when either
    entry ignores it. Entries are matched against one aggregated row per spelling, so a
    spelling shared by very many entries still costs one row; ``other_id`` is the id of
    the earliest conflicting entry in the table.
    """
    spelled = root_spellings(consent)
    inner = spelled.select("entry", "id", "fold", F.explode(ancestors(F.col("spelling"))).alias("above"))
    inside = _enclosing(inner, spelled)
    contains = _enclosed(spelled, inner)
    return inside.unionByName(contains)


def _probe_rows(rows: DataFrame, path: str) -> DataFrame:
    """Each row under the keys it may match: exactly, or case-folded.

    mode "exact" meets every other entry on the exact text. mode "mine" meets every
    other entry on lower-case text because this entry folds; mode "theirs" meets only
    folding entries on lower-case text.
    """
    modes = F.when(F.col("fold"), F.array(F.lit("mine"))).otherwise(
        F.array(F.lit("exact"), F.lit("theirs"))
    )
    exploded = rows.withColumn("mode", F.explode(modes))
    key = F.when(F.col("mode") == "exact", F.col(path)).otherwise(F.lower(F.col(path)))
    return exploded.withColumn("key", key)


def _target_groups(rows: DataFrame, path: str) -> DataFrame:
    """One row per (mode, key): how many entries stand there and the two earliest."""
    modes = F.when(
        F.col("fold"), F.array(F.lit("exact"), F.lit("mine"), F.lit("theirs"))
    ).otherwise(F.array(F.lit("exact"), F.lit("mine")))
    exploded = rows.withColumn("mode", F.explode(modes))
    key = F.when(F.col("mode") == "exact", F.col(path)).otherwise(F.lower(F.col(path)))
    members = exploded.select("mode", key.alias("key"), "entry", "id").distinct()
    first = members.groupBy("mode", "key").agg(
        F.min(F.struct("entry", "id")).alias("first")
    )
    rest = members.join(
        first.select("mode", "key", F.col("first.entry").alias("entry")),
        ["mode", "key", "entry"],
        "left_anti",
    )
    second = rest.groupBy("mode", "key").agg(F.min(F.struct("entry", "id")).alias("second"))
    return first.join(second, ["mode", "key"], "left")


def _relation(probes: DataFrame, targets: DataFrame, relation: str) -> DataFrame:
    met = probes.join(targets, ["mode", "key"])
    mine = F.col("entry") == F.col("first.entry")
    other = F.when(mine, F.col("second")).otherwise(F.col("first"))
    found = met.withColumn("other", other).where(F.col("other").isNotNull())
    return found.groupBy("entry", "id").agg(
        F.lit(relation).alias("relation"), F.min("other").getField("id").alias("other_id")
    )


def _enclosing(inner: DataFrame, spelled: DataFrame) -> DataFrame:
    return _relation(_probe_rows(inner, "above"), _target_groups(spelled, "spelling"), "inside")


def _enclosed(spelled: DataFrame, inner: DataFrame) -> DataFrame:
    return _relation(_probe_rows(spelled, "spelling"), _target_groups(inner, "above"), "contains")
