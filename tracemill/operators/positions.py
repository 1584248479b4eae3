"""A dense 1-based rank over the whole table in a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import materialize

_ROW_BITS = 33


def with_positions(rows: DataFrame, order: list[str], column: str = "position") -> DataFrame:
    """Number all rows 1..n by ``order`` without one task ever seeing them all.

    A distributed range sort is written out once, each sorted partition is numbered on its
    own, and the few partition sizes are summed to the base of each. ``order`` must be
    unique per row, which also keeps the ranges even when a leading column is constant.
    """
    numbered = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    frozen = materialize(numbered, "positions")
    part = F.shiftright("_id", _ROW_BITS)
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = frozen.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per sort partition: the window below never holds data rows.
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return (
        frozen.withColumn("_part", part)
        .join(bases, "_part")
        .withColumn(column, (F.col("_base") + row + 1).cast("bigint"))
        .drop("_id", "_part", "_base")
    )
