"""Session settings the jobs rely on, and durable scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUNTIME_SETTINGS = {
    # Transcript instants are UTC; every formatted timestamp depends on this.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Expressions too large for the JIT compiler run faster outside one generated method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tracemill") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session (a test) without
    that setting gets a folder on this machine; anywhere else executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if not existing:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracemill-"))
        existing = spark.sparkContext.getCheckpointDir()
    return existing.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of one file of a scratch table. Spark never splits a row group, and text packs so well that one holds millions of lines.
ROWS_A_FILE = 50_000


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    Cuts the lineage, so a lost executor re-reads the table instead of re-running
    the upstream scan, and several consumers share one evaluation. Files are bounded by
    rows, so that the tasks of the next step are even however the table was written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema: StructType = df.schema
    df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **given: object) -> Iterator[None]:
    """Session settings that hold inside only; ``__`` in a name stands for the dot."""
    names = {key.replace("__", "."): str(value) for key, value in given.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def releasing_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes inside give their shuffle files back as soon as they end, not when the driver happens to collect its garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt out to tasks of about so many rows, for steps that make many rows of each; their number follows the input."""
    return df.repartition(max(1, -(-df.count() // rows)))


def evened(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if one of its tasks holds more than twice its share of the rows, as when Spark may not split a large file."""
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = tasks.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = 2 * rows / df.sparkSession.sparkContext.defaultParallelism
    return df if most <= max(ROWS_A_FILE, share) else df.repartition(-(-rows // ROWS_A_FILE))


def lazy(df: DataFrame, label: str = "") -> DataFrame:
    """The staging function for small inputs: leave the plan as it is."""
    return df
