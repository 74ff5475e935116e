"""A store of many series: Parquet tables for the catalog, sealed blocks and points not yet sealed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.assign import assign_blocks
from chronoloom.operators.blocks import MAX_TS, pack, range_query
from chronoloom.operators.stats import series_stats, store_stats, with_measures
from chronoloom.schema import BLOCK_SCHEMA, CATALOG_SCHEMA, DEFAULT_DURATION_MS, check_variables, points_schema, validate_points

OPEN_SCHEMA = "series_key string, epoch int, seq bigint, ts bigint, values array<double>"


class SeriesStore:
    """create, insert, query, list, scan, flush and statistics.

    Three Parquet tables hold all series: catalog, open and blocks. Series may
    differ in width, as open points keep their values in an array. Blocks are
    written by key ranges, so a query of one series skips the other files by
    their statistics. All series of a store share the codec. Inserted points
    stay in the open table until a flush; a query sees both. A flush seals every
    open point of a series under its epoch, which hides the points from then on,
    and the next insert starts a new epoch. Flushes and statistics are one plan
    each, however many series there are.
    """

    def __init__(self, spark: SparkSession, root: str, codec: str = "standard"):
        self.spark, self.root, self.codec = spark, root.rstrip("/"), codec
        self._write(self._frame(CATALOG_SCHEMA), "catalog", "ignore")

    def _frame(self, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, mode: str = "append") -> None:
        df.write.mode(mode).parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self._frame(schema)

    def catalog(self) -> DataFrame:
        return self._read("catalog", CATALOG_SCHEMA)

    def create_series(self, key: str, variables: Sequence[str] = ("value",), duration_ms: int = DEFAULT_DURATION_MS) -> None:
        names = check_variables(variables)
        if duration_ms <= 0:
            raise ValueError("the block duration must be positive")
        if self.get_series(key) is not None:
            raise ValueError(f"series {key} exists")
        row = [(key, names, duration_ms, self.catalog().count())]
        self._write(self.spark.createDataFrame(row, CATALOG_SCHEMA), "catalog")

    def get_series(self, key: str):
        """The catalog row of one series, or None."""
        return self.catalog().filter(F.col("series_key") == key).first()

    def _known(self, key: str):
        row = self.get_series(key)
        if row is None:
            raise KeyError(key)
        return row

    def list_series(self) -> DataFrame:
        return self.catalog().select("series_key", "created_seq").orderBy("created_seq")

    def insert(self, key: str, points: DataFrame) -> None:
        """Append points(seq, ts, variables) to one series; seq must go on from earlier inserts."""
        names = self._known(key).variable_names
        checked = validate_points(points.withColumn("series_key", F.lit(key)), names)
        last = self._sealed(key).agg(F.max("epoch")).first()[0]
        values = F.array(*(F.col(f"`{v}`") for v in names)).alias("values")
        self._write(checked.select("series_key", F.lit(0 if last is None else last + 1).alias("epoch"), "seq", "ts", values), "open")

    def _of(self, df: DataFrame, key: str | None) -> DataFrame:
        return df if key is None else df.filter(F.col("series_key") == key)

    def _sealed(self, key: str | None = None) -> DataFrame:
        return self._of(self._read("blocks", BLOCK_SCHEMA), key)

    def _open_blocks(self, key: str | None = None) -> DataFrame:
        """The points of epochs later than the last sealed one, packed by each series' own duration."""
        sealed = self._sealed(key).groupBy("series_key").agg(F.max("epoch").alias("_sealed"))
        points = self._of(self._read("open", OPEN_SCHEMA), key).join(sealed, "series_key", "left")
        left = points.filter(F.col("_sealed").isNull() | (F.col("epoch") > F.col("_sealed"))).drop("_sealed")
        dated = left.join(self._of(self.catalog(), key).select("series_key", "block_duration_ms"), "series_key")
        return pack(assign_blocks(dated, F.col("block_duration_ms")), None, self.codec, by_range=True)

    def all_blocks(self, key: str | None = None) -> DataFrame:
        """Sealed and open blocks of one series or of all; reading never changes what is open."""
        return self._sealed(key).unionByName(self._open_blocks(key))

    def blocks(self, key: str) -> DataFrame:
        return self.all_blocks(self._known(key).series_key)

    def flush(self, key: str) -> None:
        """Seal the open points of one series."""
        self._write(self._open_blocks(self._known(key).series_key), "blocks")

    def flush_all(self) -> None:
        """Seal the open points of all series in one job."""
        self._write(self._open_blocks(), "blocks")

    def query(self, key: str, t0: int, t1: int, compat_pruning: bool = False) -> DataFrame:
        """Inclusive range; no rows for an unknown series."""
        row = self.get_series(key)
        if row is None:
            return self._frame(points_schema(["value"]))
        return range_query(self.all_blocks(key), row.variable_names, t0, t1, duration_ms=row.block_duration_ms, compat_pruning=compat_pruning)

    def query_all(self, key: str) -> DataFrame:
        return self.query(key, 0, MAX_TS)

    def scan_all(self):
        """(key, blocks) in creation order; all_blocks() is the same as one table."""
        for row in self.list_series().toLocalIterator():
            yield row.series_key, self.all_blocks(row.series_key)

    def series_stats(self, key: str) -> DataFrame:
        return series_stats(self.blocks(key), len(self._known(key).variable_names))

    def every_series_stats(self) -> DataFrame:
        """series_stats of all series in one aggregate; a series without points has zeros."""
        sums = series_stats(self.all_blocks()).select("series_key", "total_points", "num_blocks", "compressed_bytes")
        width = F.size("variable_names").cast("bigint").alias("num_variables")
        out = self.catalog().select("series_key", width).join(sums, "series_key", "left").na.fill(0)
        return with_measures(out.withColumn("original_bytes", F.col("total_points") * (8 + 8 * F.col("num_variables"))))

    def total_stats(self) -> DataFrame:
        """Over all series, empty ones included."""
        return store_stats(self.every_series_stats())
