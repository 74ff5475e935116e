"""Schemas and ingest validation for points, blocks and the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DURATION_MS = 7_200_000
KEYS = ("series_key", "epoch", "block_start")

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("series_key", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("min_ts", T.LongType()),
        T.StructField("max_ts", T.LongType()),
        T.StructField("codec", T.StringType()),
        T.StructField("bit_len", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
BLOCK_COLUMNS = tuple(BLOCK_SCHEMA.fieldNames())

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("series_key", T.StringType()),
        T.StructField("variable_names", T.ArrayType(T.StringType())),
        T.StructField("block_duration_ms", T.LongType()),
        T.StructField("created_seq", T.LongType()),
    ]
)


def points_schema(variables: Sequence[str]) -> T.StructType:
    fields = [
        T.StructField("series_key", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("ts", T.LongType()),
    ]
    return T.StructType(fields + [T.StructField(v, T.DoubleType()) for v in variables])


def check_variables(variables: Sequence[str]) -> list[str]:
    """Variable names are ordered, at least one, without repeats."""
    names = list(variables)
    if not names:
        raise ValueError("a series needs at least one variable")
    if len(set(names)) != len(names):
        raise ValueError(f"repeated variable names: {names}")
    return names


def validate_points(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Keep the point columns; a null key, seq, ts or value raises, naming its column."""
    names = check_variables(variables)
    missing = [c for c in ("series_key", "seq", "ts", *names) if c not in df.columns]
    if missing:
        raise ValueError(f"points lack the columns {missing}")

    def required(c: str, kind: str):
        col = F.col(f"`{c}`").cast(kind)
        return F.when(col.isNull(), F.raise_error(F.lit(f"null in column {c}")).cast(kind)).otherwise(col).alias(c)

    extra = [F.col("epoch").cast("int").alias("epoch")] if "epoch" in df.columns else [F.lit(0).alias("epoch")]
    return df.select(
        required("series_key", "string"), *extra, required("seq", "bigint"), required("ts", "bigint"), *(required(v, "double") for v in names)
    )
