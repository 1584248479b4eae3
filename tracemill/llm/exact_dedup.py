"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each step only looks at rows whose group of the step before has a second member. The tables of surviving
lengths and of surviving (length, prefix) pairs hold one row per group, not per document, and every join that
decides about rows is on narrow columns: no text is shuffled. A group that holds a third of all rows combines
before its shuffle; the join back to its rows is one that adaptive execution can split.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import merged, one_of_equal, squeezed, stage

PREFIX_CHARS = 64


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS,
           digest_all: bool = False) -> DataFrame:
    """Group rows whose texts are equal without white space, and choose the one that stays.

    Returns one row per input row: ``doc_id``, ``keep_id`` (the row with the most code points in its original
    text, then the smallest id), ``group_size``, ``kept`` and ``text_sha256``. The digest is null for rows that
    had no partner by length or prefix, unless ``digest_all`` asks for all of them.

    * a null text counts as empty; empty and white-space texts are one group
    * ties in length go to the smallest id; a null id comes last
    * rows repeating an id with an equal text count in ``group_size``; of those with the chosen id one is kept
    * an empty table gives an empty result; other columns of ``docs``, whatever their names, are not read
    """
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        squeezed(F.col(f"`{text_col}`")).alias("norm"),
        F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)).alias("points"),
    ).withColumn("size", F.char_length("norm"))

    lengths = stage(base.groupBy("size").count().where("count > 1").select("size"), "lengths")
    prefixed = base.withColumn("prefix", F.xxhash64(F.substring("norm", 1, prefix_chars)))
    prefixes = stage(
        prefixed.select("size", "prefix").join(lengths, "size", "left_semi")
        .groupBy("size", "prefix").count().where("count > 1").select("size", "prefix", F.lit(True).alias("shared")),
        "prefixes",
    )

    full = F.sha2(F.encode("norm", "UTF-8"), 256)
    if digest_all:
        prefixed = prefixed.withColumn("text_sha256", full)
    columns = ["doc_id", "size", "prefix", "points", *(["text_sha256"] if digest_all else ["norm"])]
    judged = prefixed.select(*columns).join(prefixes, ["size", "prefix"], "left")
    if not digest_all:
        judged = judged.withColumn("text_sha256", F.when(F.col("shared"), full))
    # The staged number tells rows of one id apart.
    rows = stage(judged.select("doc_id", "points", "text_sha256", F.col("shared").isNotNull().alias("shared"),
                               F.monotonically_increasing_id().alias("row")), "digests")

    # Two combining steps: fixed-width aggregates over all rows, the choice over what is left of a group.
    by_points = rows.where("shared").groupBy("text_sha256", "points").agg(
        F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("first"))
    groups = by_points.groupBy("text_sha256").agg(
        F.sum("rows").alias("group_size"), F.max_by("first.doc_id", "points").alias("best_id"),
        F.max_by("first.row", "points").alias("best_row"),
    ).where("group_size > 1").withColumnRenamed("text_sha256", "group_digest")
    joined = rows.join(groups, F.col("shared") & (F.col("text_sha256") == F.col("group_digest")), "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("best_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.coalesce(F.col("row") == F.col("best_row"), F.lit(False))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    (id, digest) of those that go are joined to the rows; of rows that share both, one is left.
    """
    pairs = stage(
        refine(docs, id_col, text_col, digest_all=True).groupBy("doc_id", "text_sha256")
        .agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"),
        "gone",
    )
    gone = pairs.where("not stays").select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_digest"))
    digest = F.sha2(F.encode(squeezed(F.col(f"`{text_col}`")), "UTF-8"), 256)
    marked = docs.withColumn("__digest", digest)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__gone_id")) & (F.col("__digest") == F.col("__gone_digest"))
    left = marked.join(merged(gone), same, "left_anti").drop("__digest")
    again = stage(pairs.where("stays").select(F.col("doc_id").alias("__again_id")).distinct(), "again")
    return one_of_equal(left, again, id_col, text_col)
