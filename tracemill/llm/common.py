"""Shared by the training-data operators: words, tables, staging, small column helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import configure, materialize

#: White space is these six characters and nothing else; a word is a run of anything else.
SPACE_CHARS = " \t\n\x0b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Rows of whole texts handed to a Python worker at once: keeps a batch small where texts are long.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: UTC, adaptive execution, small Arrow batches."""
    configure(spark)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: no recomputation, no lost lineage."""
    return materialize(df, f"llm-{label}")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    spaces = F.translate(text, SPACE_CHARS[1:], " " * 5)
    return F.coalesce(F.size(F.array_remove(F.split(spaces, " "), "")).cast("long"), F.lit(0).cast("long"))


def squeezed(text: Column) -> Column:
    """A text without any white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def merged(side: DataFrame) -> DataFrame:
    """A table of ids about to be joined to whole rows: always by a sorted merge.

    Whether such a table is small enough to broadcast depends on the corpus. One plan at every size: the rows are
    shuffled once, and no executor holds all ids.
    """
    return side.hint("merge")


def one_of_equal(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows that share id and text (white space aside) one, with the longest original; ``repeated`` holds their ids.

    Combines before its shuffle: thousands of copies of one row never meet in one task.
    """
    if repeated.isEmpty():
        return docs
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__again_id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.join(merged(repeated), same, "left_semi").groupBy(
        F.col(f"`{id_col}`").alias("__id"), F.sha2(F.encode(squeezed(text), "UTF-8"), 256).alias("__digest"),
    ).agg(F.max_by(row, F.coalesce(F.char_length(text), F.lit(0))).alias("__row")).select("__row.*")
    return docs.join(merged(repeated), same, "left_anti").union(once)


def like_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with exactly the given columns, in that order."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
