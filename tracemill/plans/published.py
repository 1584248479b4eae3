"""Tables replaced as a whole: readers see the old version or the new one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_if_present(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, or no rows when nothing was ever written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


_POINTER = StructType().add("published_at", "timestamp").add("version", "long")


class PublishedTable:
    """Version folders next to a folder of pointers, one per version; the highest version counts.

    A version is written completely before its pointer appears, so a job that dies in
    between leaves the previous version in force. Pointers are found by listing them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def version(self) -> int:
        pointers = read_if_present(self.spark, f"{self.root}/pointer", _POINTER).inputFiles()
        return max((int(path.rsplit("/version=", 1)[1].split("/")[0]) for path in pointers), default=0)

    def path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def read(self) -> DataFrame:
        version = self.version()
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path(version))

    def point_to(self, version: int) -> int:
        row = self.spark.range(1).select(F.current_timestamp().alias("published_at"))
        row.write.mode("overwrite").parquet(f"{self.root}/pointer/version={version}")
        return version

    def publish(self, rows: DataFrame) -> int:
        version = self.version() + 1
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self.path(version))
        return self.point_to(version)
