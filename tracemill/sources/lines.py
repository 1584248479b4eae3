"""Transcript files and line feeds, framed into one row per line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.schemas import LINES
from tracemill.session import settings
from tracemill.sources.folders import TASKS_PER_CORE, list_tree

# Byte width of the coarse bucket that stands for an input split on a feed.
FEED_CHUNK_BYTES = 64 * 1024 * 1024


def strip_return(value: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.when(
        value.endswith("\r"), F.substr(value, F.lit(1), F.char_length(value) - 1)
    ).otherwise(value)


def frame(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """Strip carriage returns; with a ``cap``, mark lines over so many bytes and drop their text. Blank lines stay.

    ``raw`` has (file, chunk, line, nbytes, value) where nbytes counts the newline.
    """
    text = strip_return(F.col("value"))
    oversize = F.lit(False) if cap is None else F.octet_length(text) > cap
    passthrough = [c for c in raw.columns if c not in ("value", "oversize")]
    return raw.select(
        *passthrough,
        F.when(~oversize, text).alias("value"),
        oversize.alias("oversize"),
    )


def scan_lines(
    spark: SparkSession,
    path: str,
    cap: int | None = None,
    glob: str = "*.jsonl",
) -> DataFrame:
    """Every line of every matching file below ``path``; an absent folder is zero lines.

    Splits of one large file are read by many tasks. ``line`` grows inside a split,
    ``chunk`` is where the split starts, so (chunk, line) is file order. A file that fails
    midway yields the lines before the fault; ``incomplete_files`` finds it by its length.
    """
    # Spark lists each folder of a level in a task of its own; a task of many folders costs far less to start.
    tasks = spark.sparkContext.defaultParallelism * TASKS_PER_CORE
    try:
        with settings(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=tasks):
            text = (
                spark.read.option("recursiveFileLookup", "true")
                .option("pathGlobFilter", glob)
                .option("ignoreMissingFiles", "true")
                .option("ignoreCorruptFiles", "true")
                .option("lineSep", "\n")
                .text(path)
            )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LINES)
    raw = text.select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("line"),
        (F.octet_length("value") + F.lit(1)).cast("bigint").alias("nbytes"),
        F.col("value"),
    )
    return frame(raw, cap)


def plain_path(uri: Column) -> Column:
    """A ``file:`` URI as an ordinary path, its escapes resolved; other schemes stay."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"\Afile:/*", "/")


def list_files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, length) of the matching files, empty ones included; contents are never read.

    A listed file with bytes of which no line was read (no permission, or a name Spark's
    file sources hide) shows up as unreadable in the counters.
    """
    return list_tree(spark, path, glob)


def feed_lines(feed: DataFrame, cap: int | None = None) -> DataFrame:
    """Frame a line feed of (file, offset, value) rows, batch or streaming.

    The feed names byte offsets itself, so nothing has to be summed up.
    """
    raw = feed.select(
        "file",
        F.expr(f"offset div {FEED_CHUNK_BYTES}").alias("chunk"),
        F.col("offset").cast("bigint").alias("line"),
        (F.octet_length("value") + F.lit(1)).cast("bigint").alias("nbytes"),
        F.col("offset").cast("bigint").alias("offset"),
        "value",
    )
    return frame(raw, cap)
