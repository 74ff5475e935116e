"""Block assignment: in arrival order, a point's block is the running maximum of its aligned start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.schema import DEFAULT_DURATION_MS

SEQ_CHUNK = 1 << 20


def assign_blocks(points: DataFrame, duration_ms: int | Column | None = DEFAULT_DURATION_MS, seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """Add block_start to points(series_key, epoch, seq, ts, ...).

    A late point stays in the block that is open when it arrives. duration_ms
    None means one block per (series, epoch), starting at its first timestamp; a
    column gives every series its own duration.

    The running maximum is taken in two levels, over ranges of seq_chunk
    sequence numbers and then inside each, so that a series that holds a large
    part of all points is spread over many tasks: the partial aggregate gives
    one maximum per range, a window over those few rows carries them forward,
    and the inner window never holds more than one range.
    """
    if duration_ms is None:
        first = points.groupBy("series_key", "epoch").agg(F.min_by("ts", "seq").alias("block_start"))
        return points.join(first, ["series_key", "epoch"])
    if not isinstance(duration_ms, Column) and duration_ms <= 0:
        raise ValueError("the block duration must be positive")
    floor = F.col("ts") - F.pmod(F.col("ts"), F.lit(duration_ms))
    cut = points.withColumns({"_floor": floor, "_range": F.floor(F.col("seq") / F.lit(seq_chunk)).cast("bigint")})
    keys = ["series_key", "epoch"]
    tops = cut.groupBy(*keys, "_range").agg(F.max("_floor").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("_carried", F.max("_top").over(before)).drop("_top")
    inner = Window.partitionBy(*keys, "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(carried, [*keys, "_range"])
        .withColumn("block_start", F.greatest("_carried", F.max("_floor").over(inner)))
        .drop("_floor", "_range", "_carried")
    )


def block_order() -> Window:
    return Window.partitionBy("series_key", "epoch", "block_start").orderBy("seq")


def with_deltas(assigned: DataFrame) -> DataFrame:
    """Add rn, delta and dod within each block; delta is null on the first point, dod on the first two."""
    w = block_order()
    return assigned.withColumns({"rn": F.row_number().over(w), "delta": F.col("ts") - F.lag("ts").over(w)}).withColumn(
        "dod", F.col("delta") - F.lag("delta").over(w)
    )
