"""Compression statistics, codec comparison and code histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.bits import dod_bucket
from chronoloom.operators.assign import with_deltas


def _measures(total: Column, raw: Column, packed: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "compression_ratio": F.when(packed > 0, raw / packed).otherwise(zero),
        "savings_percent": F.when(raw > 0, (1 - packed / raw) * 100).otherwise(zero),
        "bits_per_point": F.when(total > 0, packed * 8 / total).otherwise(zero),
    }


def series_stats(sizes: DataFrame, num_variables: int = 1, size_column: str = "size_bytes") -> DataFrame:
    """Per series: points, variables, blocks, raw and packed bytes, ratio, savings, bits per point; zero where undefined."""
    out = sizes.groupBy("series_key").agg(
        F.sum("n").alias("total_points"), F.count("*").alias("num_blocks"), F.coalesce(F.sum(size_column), F.lit(0)).alias("compressed_bytes")
    )
    out = out.withColumns({"num_variables": F.lit(num_variables).cast("bigint"), "original_bytes": F.col("total_points") * (8 + 8 * num_variables)})
    return with_measures(out)


def with_measures(sums: DataFrame) -> DataFrame:
    return sums.withColumns(_measures(F.col("total_points"), F.col("original_bytes"), F.col("compressed_bytes")))


def store_stats(per_series: DataFrame) -> DataFrame:
    """One row over all series."""
    out = per_series.agg(
        F.count("*").alias("num_series"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_points", "num_blocks", "original_bytes", "compressed_bytes")),
    )
    measures = _measures(F.col("total_points"), F.col("original_bytes"), F.col("compressed_bytes"))
    return out.withColumns({k: measures[k] for k in ("compression_ratio", "savings_percent")})


def codec_comparison(sizes: DataFrame, num_variables: int = 1, csv_bytes: int | None = None) -> DataFrame:
    """Standard against guarded per series, with a total row (series_key null), from one pass over both folds."""
    out = sizes.rollup("series_key").agg(
        F.sum("n").alias("points"), F.sum("standard_bytes").alias("standard_bytes"), F.sum("guarded_bytes").alias("guarded_bytes")
    )
    raw = F.col("points") * (8 + 8 * num_variables)
    cols = {"original_bytes": raw, "diff_bytes": F.col("standard_bytes") - F.col("guarded_bytes")}
    cols["improvement_percent"] = F.when(F.col("standard_bytes") > 0, (F.col("standard_bytes") - F.col("guarded_bytes")) * 100 / F.col("standard_bytes")).otherwise(0.0)
    for c in ("standard", "guarded"):
        m = _measures(F.col("points"), raw, F.col(f"{c}_bytes"))
        cols |= {f"{c}_ratio": m["compression_ratio"], f"{c}_savings": m["savings_percent"], f"{c}_bits_per_point": m["bits_per_point"]}
    if csv_bytes is not None:
        cols |= {"csv_bytes": F.lit(csv_bytes), "csv_ratio": F.lit(csv_bytes) / F.col("standard_bytes")}
    return out.withColumns(cols)


def dod_histogram(assigned: DataFrame) -> DataFrame:
    """How many third and later points of each series fall in each delta-of-delta bucket."""
    rows = with_deltas(assigned).filter("dod is not null")
    return rows.groupBy("series_key", dod_bucket(F.col("dod")).alias("bucket")).agg(F.count("*").alias("points"))


def xor_classes(sizes: DataFrame, codecs: Sequence[str] = ("standard", "guarded")) -> DataFrame:
    """Counts of equal, reused-window and new-window values per series and codec."""
    kinds = [f"'{c}', {c}_same, {c}_reuse, {c}_fresh" for c in codecs]
    long = sizes.selectExpr("series_key", f"stack({len(kinds)}, {', '.join(kinds)}) as (codec, same, reuse, fresh)")
    return long.groupBy("series_key", "codec").agg(*(F.sum(c).alias(c) for c in ("same", "reuse", "fresh")))


def csv_bytes(spark, path: str) -> DataFrame:
    """The size of the raw files, for a ratio against text."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("csv_bytes"))


def final_comparison(named: dict[str, DataFrame]) -> DataFrame:
    """Points, variables, ratio and savings of several data sets' series_stats, one row per series, under the data set's name.

    A data set without any series has one row of nulls, as an absent one is shown too.
    """
    out = None
    for name, stats in named.items():
        label = stats.sparkSession.createDataFrame([(name,)], "dataset string")
        cols = stats.select("series_key", "total_points", "num_variables", *(F.round(c, 2).alias(c) for c in ("compression_ratio", "savings_percent")))
        rows = label.join(cols, F.lit(True), "left")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no data sets to compare")
    return out
