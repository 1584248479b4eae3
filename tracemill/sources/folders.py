"""List folders and read small documents inside Spark tasks.

Spark's file sources leave out empty files and every name that starts with a dot or an
underscore. Both matter here: an empty transcript is still a transcript, and project
settings live in dot folders. So folders are listed by tasks, one level of the tree after
the other, each level dealt out anew: a tree below one top folder is listed by as many
tasks as a wide one, and a task passes on what it finds in frames of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import materialize

_FOUND = "path string, length bigint, is_folder boolean"
#: Entries passed on at once; tasks of a level for each core.
FRAME_ENTRIES, TASKS_PER_CORE = 4096, 4
#: Stores that tasks can open by themselves; any other is listed by Spark's own reader.
OPENED = re.compile(r"\A(/|(file|s3|s3a|gs|gcs|hdfs|abfs|abfss):)")


def _plain(uri: str) -> str:
    return re.sub(r"\Afile:/*", "/", uri)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _found(uri: str) -> Iterator[tuple[str, int, bool]]:
    """Entries of the folder ``uri``, spelled with the prefix the caller used; nothing when it is absent."""
    uri = _plain(uri)
    system, root = _open(uri)
    base, cut = uri.rstrip("/"), len(root.rstrip("/"))
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        is_folder = info.type == fs.FileType.Directory
        # A link to a folder may lead back up: it is not followed.
        if not (is_folder and isinstance(system, fs.LocalFileSystem) and os.path.islink(info.path)):
            yield base + info.path[cut:], info.size or 0, is_folder


def _list(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple[str, int, bool]] = []
    for frame in frames:
        for path in frame["path"]:
            for entry in _found(path):
                rows.append(entry)
                if len(rows) == FRAME_ENTRIES:
                    yield pd.DataFrame(rows, columns=["path", "length", "is_folder"])
                    rows = []
    yield pd.DataFrame(rows, columns=["path", "length", "is_folder"])


def list_folder(folders: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, length, is_folder) of what lies in each of ``folders(path)``, dealt out to so many tasks."""
    tasks = tasks or folders.sparkSession.sparkContext.defaultParallelism
    return folders.select("path").repartition(tasks, F.col("path")).mapInPandas(_list, _FOUND)


def list_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(file, length) of all files below ``root`` whose name matches, empty ones included.

    One job for each level of the tree. In a store that only Spark can open, empty files and names that its readers
    hide are not seen.
    """
    name = F.element_at(F.split("path", "/"), -1)
    if not OPENED.match(root):
        seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        return seen.select(F.col("path").alias("file"), "length")
    most = spark.sparkContext.defaultParallelism * TASKS_PER_CORE
    level, folders = spark.createDataFrame([(root,)], "path string"), 1
    files = spark.createDataFrame([], "path string, length bigint")
    while folders:
        found = materialize(list_folder(level, min(folders, most)), "listing")
        files = files.unionByName(found.where("not is_folder").select("path", "length"))
        level = found.where("is_folder").select("path")
        folders = level.count()
    return files.where(name.like(_like(glob))).select(F.col("path").alias("file"), "length")


def _like(glob: str) -> str:
    """A ``*`` glob as a LIKE pattern."""
    return glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for uri in frame["path"]:
            system, path = _open(_plain(uri))
            if system.get_file_info(path).type != fs.FileType.File:
                continue
            with system.open_input_stream(path) as stream:
                rows.append((uri, stream.read().decode("utf-8", "replace")))
        yield pd.DataFrame(rows, columns=["path", "value"])


def read_documents(paths: DataFrame) -> DataFrame:
    """(path, value) of the small configuration documents at ``paths(path)``; a missing one is no row."""
    return paths.select("path").distinct().mapInPandas(_read, "path string, value string")


def write_files(lines: DataFrame, root: str) -> int:
    """Write the ``value`` of ``lines(path, value)``, a line each, to the files below ``root`` that ``path`` names, and count the files.

    A file's rows must lie together and in order in one task. Tasks write files in place, without a start of other programs or a
    move for each; a task that runs again writes the same files again.
    """
    folder = _plain(root).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        rows = (row for batch in batches for row in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True))
        written = 0
        for path, group in groupby(rows, key=lambda row: row[0]):
            system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{base}/{path}") as out:
                while some := list(islice(group, FRAME_ENTRIES)):
                    out.write("".join(f"{value or ''}\n" for _, value in some).encode())
            written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    return lines.select("path", "value").mapInArrow(write, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
