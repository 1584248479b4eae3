"""Which event ids are stored: segments of an index whose cost of a look-up follows the ids looked up.

A batch is its own segment at first: its data folder. When enough segments of about one size have gathered they are
merged into one, cut into folders by the first hexadecimal digits of the id and sorted inside; the larger a segment,
the more digits. Ids are digests, so folders are even, and a look-up of n ids opens at most n folders of bounded size
in each of a logarithmic number of segments, whatever the store holds. A look-up of very many ids reads all folders:
then the batch itself is of the order of the store.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracemill.operators.validation import packed, unpacked

#: Ids that one folder of a segment holds, at most and about; segments of one size that are merged; digits at most.
LEAF_IDS, FANOUT, MAX_DIGITS = 65_536, 8, 3
_IDS = StructType([StructField("event_id", StringType()), StructField("attempt", LongType())])


@dataclass(frozen=True)
class Segment:
    """Ids below ``folder``; those written by a ``dead`` attempt no longer count. 0 digits: no folders by digits."""

    number: int
    folder: str
    rows: int
    digits: int
    dead: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class IdIndex:
    spark: SparkSession
    root: str
    leaf_ids: int = LEAF_IDS

    def digits(self, rows: int) -> int:
        found = 0
        while found < MAX_DIGITS and rows > self.leaf_ids * 16**found:
            found += 1
        return found

    def tier(self, rows: int) -> int:
        found = 0
        while rows > self.leaf_ids * FANOUT**found:
            found += 1
        return found

    def _read(self, segment: Segment, prefixes: list[str] | None) -> DataFrame:
        schema = StructType([*_IDS.fields, StructField("prefix", StringType())]) if segment.digits else _IDS
        rows = self.spark.read.schema(schema).option("basePath", segment.folder.split("/batch_id=")[0]).parquet(segment.folder)
        if segment.digits and prefixes is not None:
            wanted = sorted({p[:segment.digits] for p in prefixes})
            if len(wanted) < 16**segment.digits:
                rows = rows.where(F.col("prefix").isin(wanted))
        if segment.dead:
            rows = rows.where(~F.col("attempt").isin(segment.dead))
        return rows.select("event_id", "attempt")

    def stored(self, segments: list[Segment], prefixes: list[str]) -> DataFrame:
        """Stored ids, at least all that begin with one of the given prefixes (of ``MAX_DIGITS`` digits)."""
        return self._union([self._read(s, prefixes) for s in segments if s.rows]).select("event_id")

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = self.spark.createDataFrame([], _IDS)
        for part in parts:
            out = out.unionByName(part)
        return out

    def due(self, segments: list[Segment]) -> list[Segment]:
        """Segments to merge now: a batch too large for one folder alone, else a full set of one size."""
        for segment in segments:
            if self.digits(segment.rows) > segment.digits:
                return [segment]
        tiers: dict[int, list[Segment]] = {}
        for segment in segments:
            tiers.setdefault(self.tier(segment.rows), []).append(segment)
        return next((same for _, same in sorted(tiers.items()) if len(same) >= FANOUT), [])

    def merge(self, segments: list[Segment], number: int) -> Segment:
        """Write the ids of some segments as one; it is in force once the caller has committed it."""
        rows = self._union([self._read(s, None) for s in segments if s.rows])
        total = sum(s.rows for s in segments)
        digits, folder = self.digits(total), f"{self.root}/segment={number}"
        if digits:
            # The ids are shuffled as bytes, half as wide.
            cut = packed(rows.withColumn("prefix", F.substring("event_id", 1, digits))).repartition("prefix")
            written = unpacked(cut.sortWithinPartitions("prefix", "event_id")).write.partitionBy("prefix")
        else:
            written = rows.coalesce(1).write
        written.mode("overwrite").option("compression", "zstd").parquet(folder)
        return Segment(number, folder, total, digits)
