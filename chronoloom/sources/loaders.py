"""CSV loaders: all columns are read as text and cast with try_, so bad rows drop out as whole rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.times import zoned_millis

#: Fixed values of the room climate file: variable names of columns 4 to 11.
ROOM_VARIABLES = ("temp", "humidity", "light1", "light2", "occupancy", "activity", "door", "window")
#: Digits with an optional fraction and exponent, or nan and infinities, as a float parser without suffixes takes them.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def _double(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def _lines(spark: SparkSession, path: str, width: int, header: bool) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE", enforceSchema=True)


def _finish(df: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """seq follows the file's order; it is only an order within one file, which Spark's CSV scan numbers front to back."""
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("ts", *variables)])  # dropna would take NaN as missing
    rows = df.withColumn("seq", F.monotonically_increasing_id()).filter(good)
    return rows.select(F.lit(key).alias("series_key"), "seq", "ts", *variables)


def load_univariate_csv(spark: SparkSession, path: str, series_key: str, variable: str = "value", tz: str = "UTC") -> DataFrame:
    """A header, then wall-clock time and value; short and unparsable rows are skipped."""
    raw = _lines(spark, path, 2, True)
    return _finish(raw.select(zoned_millis(F.col("_c0"), tz).alias("ts"), _double(F.col("_c1")).alias(variable)), series_key, [variable])


def load_cpu_csv(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    return load_univariate_csv(spark, path, "cpu_load", "cpu_load", tz)


def load_named_csv(spark: SparkSession, path: str, series_key: str, tz: str = "UTC") -> DataFrame:
    """Columns timestamp and value by header name, in any position; a missing path raises."""
    raw = spark.read.csv(path, header=True)
    return _finish(raw.select(zoned_millis(F.col("timestamp"), tz).alias("ts"), _double(F.col("value")).alias("value")), series_key, ["value"])


def load_room_climate_csv(spark: SparkSession, path: str, variables: Sequence[str] = ROOM_VARIABLES) -> DataFrame:
    """Positional: epoch ms in column 1, eight values in columns 4 to 11; the first row is dropped, short rows are skipped."""
    raw = _lines(spark, path, 12, True)
    ts = F.when(F.col("_c1").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("_c1").try_cast("bigint")).alias("ts")
    values = [_double(F.col(f"_c{4 + i}")).alias(v) for i, v in enumerate(variables)]
    return _finish(raw.select(ts, *values), "room_climate", list(variables))
