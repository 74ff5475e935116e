"""Derived analytics over points: describe, first rows, relative ranges, duration, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.bits import double_bits


def describe(points: DataFrame, variable: str = "value") -> DataFrame:
    v = F.col(f"`{variable}`")
    return points.groupBy("series_key").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first n points of each series in arrival order (the limit is the feature)."""
    w = Window.partitionBy("series_key").orderBy("seq")
    return points.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def sort_points(points: DataFrame, *tie: str) -> DataFrame:
    """By time, then by the given columns (arrival order by default)."""
    return points.orderBy("ts", *(tie or ("seq",)))


def first_window(points: DataFrame, delta_ms: int) -> DataFrame:
    """Points of [first, first + delta] where first is the first to arrive, not the earliest."""
    first = points.groupBy("series_key").agg(F.min_by("ts", "seq").alias("_first"))
    return points.join(first, "series_key").filter(F.col("ts").between(F.col("_first"), F.col("_first") + delta_ms)).drop("_first")


def duration_hours(points: DataFrame) -> DataFrame:
    """From the first to the last to arrive."""
    span = F.max_by("ts", "seq") - F.min_by("ts", "seq")
    return points.groupBy("series_key").agg((span / 3_600_000).alias("hours"))


def series_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("series_key").agg(F.count("*").alias("total_points"))


def locf(points: DataFrame, variable: str) -> DataFrame:
    """Step display: the last known value carried forward."""
    w = Window.partitionBy("series_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(variable, F.last(F.col(f"`{variable}`"), ignorenulls=True).over(w))


def images(points: DataFrame, variables: Sequence[str]) -> DataFrame:
    return points.withColumns({v: double_bits(F.col(f"`{v}`")) for v in variables})


def mismatches(left: DataFrame, right: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows that two decoded point sets don't share, by key, place and bit image: empty means bit-perfect and in order."""
    cols = [c for c in ("series_key", "epoch", "block_start", "pos", "ts") if c in left.columns and c in right.columns] + list(variables)
    a, b = images(left, variables).select(*cols), images(right, variables).select(*cols)
    return a.exceptAll(b).unionByName(b.exceptAll(a))
