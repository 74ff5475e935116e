"""Registered queries over the driver's tables, with their SQL.

events: series = event_type, order of arrival = event_id, blocks of one day.
lineitem: four variables per point, series = l_suppkey, sorted by ship date.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.bits import clz64, ctz64, dod_bucket, dod_cost, double_bits, format_bytes, from_twos_complement, leading, twos_complement
from chronoloom.functions.times import wall_millis
from chronoloom.operators import analytics
from chronoloom.operators.assign import assign_blocks, with_deltas
from chronoloom.operators.blocks import pack, query_all, range_query, unpack
from chronoloom.operators.sizing import block_sizes, with_xor
from chronoloom.operators.stats import codec_comparison, csv_bytes, dod_histogram, final_comparison, series_stats, store_stats, xor_classes
from chronoloom.schema import KEYS, validate_points

DAY = 86_400_000
LINE_VARIABLES = ("quantity", "price", "discount", "tax")
T0, T1 = 1_704_672_000_000, 1_705_449_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return validate_points(
        e.select(F.col("event_type").alias("series_key"), F.col("event_id").alias("seq"), wall_millis(F.col("ts")).alias("ts"), "value"), ["value"]
    )


def assigned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_blocks(event_points(spark, sf_dir), DAY)


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq is the row's number within its supplier, ordered by ship date and then by every column."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    ranked = li.withColumn("seq", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)))
    cols = dict(zip(LINE_VARIABLES, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), strict=True))
    return validate_points(
        ranked.select(F.col("l_suppkey").cast("string").alias("series_key"), "seq", wall_millis(F.col("l_shipdate")).alias("ts"), *(F.col(c).alias(v) for v, c in cols.items())),
        LINE_VARIABLES,
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def scan_points(spark, sf_dir):
    return event_points(spark, sf_dir).select("series_key", "seq", "ts", "value")


def assign_events(spark, sf_dir):
    return assigned_events(spark, sf_dir).select("series_key", "seq", "ts", "block_start")


def assign_late(spark, sf_dir):
    late = event_points(spark, sf_dir).withColumn("seq", F.col("seq") % 97 * 1_000_000_000 + F.col("seq"))
    return assign_blocks(late, DAY, seq_chunk=1_000_000_000).select("series_key", "seq", "ts", "block_start")


def ts_deltas(spark, sf_dir):
    return with_deltas(assigned_events(spark, sf_dir)).select("series_key", "seq", "delta", "dod")


def dod_costs(spark, sf_dir):
    d = F.col("dod")
    rows = with_deltas(assigned_events(spark, sf_dir)).filter(d.isNotNull())
    return rows.select("series_key", "seq", dod_bucket(d).alias("bucket"), dod_cost(d).cast("bigint").alias("cost"))


def dod_buckets(spark, sf_dir):
    return dod_histogram(assigned_events(spark, sf_dir))


def twos(spark, sf_dir):
    d = F.col("dod")
    rows = with_deltas(assigned_events(spark, sf_dir)).filter(d.isNotNull())
    u = twos_complement(d, 32)
    return rows.select("series_key", "seq", u.alias("u"), from_twos_complement(u, 32).alias("back"))


def value_xor(spark, sf_dir):
    return with_xor(assigned_events(spark, sf_dir), ["value"]).select("series_key", "seq", "vb", "x")


def xor_window(spark, sf_dir):
    x = F.col("x")
    rows = with_xor(assigned_events(spark, sf_dir), ["value"]).filter(x != 0)
    return rows.select(
        "series_key", "seq", *(e.cast("bigint").alias(n) for n, e in (("clz", clz64(x)), ("ctz", ctz64(x)), ("l", leading(x)), ("m", F.col("m"))))
    )


def _sizes(codec):
    def query(spark, sf_dir):
        s = block_sizes(assigned_events(spark, sf_dir), ["value"], [codec])
        return s.select("series_key", "block_start", "n", F.col(f"{codec}_bits").alias("bits"), F.col(f"{codec}_bytes").alias("bytes"))

    return query


def event_sizes(spark, sf_dir):
    return block_sizes(assigned_events(spark, sf_dir))


def series_statistics(spark, sf_dir):
    return _rounded(series_stats(event_sizes(spark, sf_dir), 1, "standard_bytes"), "compression_ratio", "savings_percent", "bits_per_point")


def store_statistics(spark, sf_dir):
    return _rounded(store_stats(series_stats(event_sizes(spark, sf_dir), 1, "standard_bytes")), "compression_ratio", "savings_percent")


def compare_codecs(spark, sf_dir):
    rates = [f"{c}_{k}" for c in ("standard", "guarded") for k in ("ratio", "savings", "bits_per_point")]
    return _rounded(codec_comparison(event_sizes(spark, sf_dir)), "improvement_percent", *rates)


def classes(spark, sf_dir):
    return xor_classes(event_sizes(spark, sf_dir))


def _blocks(spark, sf_dir, codec="standard"):
    return pack(assigned_events(spark, sf_dir), ["value"], codec)


def packed_sizes(spark, sf_dir):
    """The kernel's own sizes, which must equal the fold's."""
    return _blocks(spark, sf_dir, "guarded").select("series_key", "block_start", "n", "min_ts", "max_ts", F.col("bit_len").alias("bits"), F.col("size_bytes").alias("bytes"))


def _decoded(points: DataFrame) -> DataFrame:
    return points.select("series_key", "ts", double_bits(F.col("value")).alias("vb"))


def range_events(spark, sf_dir):
    return _decoded(range_query(_blocks(spark, sf_dir), ["value"], T0, T1))


def range_compat(spark, sf_dir):
    return _decoded(range_query(_blocks(spark, sf_dir), ["value"], T0, T1, duration_ms=DAY, compat_pruning=True))


def range_one_series(spark, sf_dir):
    return _decoded(range_query(_blocks(spark, sf_dir), ["value"], T0, T1, series_key="click"))


def query_everything(spark, sf_dir):
    return _decoded(query_all(_blocks(spark, sf_dir, "guarded"), ["value"]))


def _roundtrip(codec):
    def query(spark, sf_dir):
        p = unpack(_blocks(spark, sf_dir, codec), ["value"])
        return p.select("series_key", "block_start", "pos", "ts", double_bits(F.col("value")).alias("vb"))

    return query


def multivariate_sizes(spark, sf_dir):
    s = block_sizes(assign_blocks(line_points(spark, sf_dir), 20 * DAY), LINE_VARIABLES)
    return s.select("series_key", "block_start", "n", "standard_bits", "guarded_bits")


def multivariate_roundtrip(spark, sf_dir):
    p = unpack(pack(assign_blocks(line_points(spark, sf_dir), 20 * DAY), LINE_VARIABLES, "guarded"), LINE_VARIABLES)
    return analytics.images(p, LINE_VARIABLES).select("series_key", "ts", *LINE_VARIABLES)


def describe_series(spark, sf_dir):
    return _rounded(analytics.describe(event_points(spark, sf_dir)), "mean")


def sort_points(spark, sf_dir):
    return analytics.sort_points(event_points(spark, sf_dir), "value", "seq").select("series_key", "seq", "ts", "value")


def first_points(spark, sf_dir):
    return analytics.first_points(event_points(spark, sf_dir), 5).select("series_key", "seq", "ts", "value")


def first_window(spark, sf_dir):
    return analytics.first_window(event_points(spark, sf_dir), 3_600_000).select("series_key", "seq", "ts", "value")


def duration_hours(spark, sf_dir):
    return _rounded(analytics.duration_hours(event_points(spark, sf_dir)), "hours")


def list_series(spark, sf_dir):
    return event_points(spark, sf_dir).groupBy("series_key").agg(F.min("seq").alias("created_seq"))


def series_counts(spark, sf_dir):
    return analytics.series_counts(event_points(spark, sf_dir))


def codecs_agree(spark, sf_dir):
    """Rows on which the two codecs decode differently, counted per kind: all zero."""
    a, b = (unpack(_blocks(spark, sf_dir, c), ["value"]) for c in ("standard", "guarded"))
    return analytics.mismatches(a, b, ["value"]).agg(F.count("*").alias("mismatches"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def framed_roundtrip(spark, sf_dir):
    from chronoloom.sources.formats import query_framed, write_series_files

    folder = scratch(spark, "framed")
    write_series_files(_blocks(spark, sf_dir), folder, ["value"]).write.mode("overwrite").format("noop").save()
    return _decoded(query_framed(spark, folder, ["value"], 0, (1 << 63) - 1))


def csv_roundtrip(spark, sf_dir):
    """Points written as text and read back by the univariate loader; times are cut to seconds there."""
    from chronoloom.sources.loaders import load_univariate_csv

    folder = scratch(spark, "csv")
    e = table(spark, sf_dir, "events")
    rows = e.select(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("value").cast("string"))
    rows.write.option("header", True).csv(folder)
    return load_univariate_csv(spark, folder, "events").select("series_key", "ts", double_bits(F.col("value")).alias("vb"))


def raw_roundtrip(spark, sf_dir):
    from chronoloom.sources.formats import read_raw, write_series_files

    folder = scratch(spark, "raw")
    write_series_files(_blocks(spark, sf_dir), folder, ["value"], framed=False, duration_ms=DAY).write.mode("overwrite").format("noop").save()
    return read_raw(spark, folder).select("series_key", "block_start", "n", F.col("size_bytes").alias("bytes"))


def store_roundtrip(spark, sf_dir):
    """create, two inserts around a flush, then a range query over sealed and open blocks of one series."""
    from chronoloom.plans.store import SeriesStore

    store = SeriesStore(spark, scratch(spark, "store"))
    store.create_series("click", ["value"], DAY)
    points = event_points(spark, sf_dir).filter("series_key = 'click'").select("seq", "ts", "value")
    half = points.agg(F.expr("percentile_disc(0.5) within group (order by seq)").alias("h"))
    cut = points.join(half, how="cross")
    store.insert("click", cut.filter("seq <= h").drop("h"))
    store.flush_all()
    store.insert("click", cut.filter("seq > h").drop("h"))
    return _decoded(store.query("click", T0, T1))


def stream_ingest(spark, sf_dir):
    """The last block of each series stays open in state; all earlier ones come out sealed."""
    from chronoloom.streaming.ingest import stream_blocks

    folder = scratch(spark, "stream")
    event_points(spark, sf_dir).drop("epoch").write.parquet(f"{folder}/in")
    source = spark.readStream.schema("series_key string, seq bigint, ts bigint, value double").parquet(f"{folder}/in")
    q = (
        stream_blocks(source, ["value"], DAY).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("series_key", "block_start", "n", F.col("bit_len").alias("bits"))


def bit_stream(spark, sf_dir):
    """A stream of single bits, bit fields, reserved, patched and whole words and raw bytes per event, and what is read back."""
    import pyarrow as pa

    from chronoloom.operators.codec import BitSink, BitSource

    def kernel(batches):
        for batch in batches:
            out = []
            for kind, seq, ts in zip(*(batch[c].to_pylist() for c in ("series_key", "seq", "ts")), strict=True):
                s = BitSink()
                s.bit(1)
                s.bits(seq % 8, 3)
                at = s.reserve_u32()
                s.i64(ts)
                s.u64(seq)
                s.raw(kind.encode())
                s.patch_u32(at, seq)
                r = BitSource(s.getvalue())
                row = {"seq": seq, "stream": s.getvalue().hex(), "bits": s.bit_length(), "bytes": s.byte_length(), "peeked": r.peek(), "head": r.bits(4)}
                row |= {"u32": r.u32(), "i64": r.i64(), "u64": r.u64(), "bits_left": r.bits_remaining, "tail": r.raw(len(kind.encode())).decode()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out)

    schema = "seq bigint, stream string, bits bigint, bytes bigint, peeked bigint, head bigint, u32 bigint, i64 bigint, u64 bigint, bits_left bigint, tail string"
    return event_points(spark, sf_dir).select("series_key", "seq", "ts").mapInArrow(kernel, schema)


def single_block(spark, sf_dir):
    """One block per series, whatever its length."""
    s = block_sizes(assign_blocks(event_points(spark, sf_dir), None), ["value"], ["guarded"])
    return s.select("series_key", "block_start", "n", F.col("guarded_bits").alias("bits"))


def locf(spark, sf_dir):
    """Every third value is missing and takes the last one before it."""
    holes = event_points(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 3 != 0, F.col("value")))
    return analytics.locf(holes, "value").select("series_key", "seq", "value")


def formatted_sizes(spark, sf_dir):
    s = series_stats(event_sizes(spark, sf_dir), 1, "standard_bytes")
    return s.select("series_key", format_bytes(F.col("original_bytes")).alias("original"), format_bytes(F.col("compressed_bytes")).alias("compressed"))


def csv_ratio(spark, sf_dir):
    """Bytes of the events' times and ids as text against the blocks' bytes."""
    folder = scratch(spark, "text")
    event_points(spark, sf_dir).select(F.concat_ws(",", "ts", "seq").alias("line")).write.text(folder)
    packed = event_sizes(spark, sf_dir).agg(F.sum("standard_bytes").alias("compressed_bytes"))
    return csv_bytes(spark, folder).join(packed, F.lit(True)).withColumn("ratio", F.round(F.col("csv_bytes") / F.col("compressed_bytes"), 6))


def compare_datasets(spark, sf_dir):
    """Univariate events beside four-variable line items and a data set that isn't there."""
    lines = block_sizes(assign_blocks(line_points(spark, sf_dir), 20 * DAY), LINE_VARIABLES, ["standard"])
    whole = lines.withColumn("series_key", F.lit("lineitem"))
    none = series_stats(event_sizes(spark, sf_dir).filter("false"), 1, "standard_bytes")
    return final_comparison(
        {"events": series_stats(event_sizes(spark, sf_dir), 1, "standard_bytes"), "lineitem": series_stats(whole, 4, "standard_bytes"), "absent": none}
    )


def room_csv(spark, sf_dir):
    """Line items in the twelve positional columns of the room file, every seventh row with an unreadable value."""
    from chronoloom.sources.loaders import load_room_climate_csv

    folder = scratch(spark, "room")
    li = table(spark, sf_dir, "lineitem")
    bad = F.when(F.col("l_orderkey") % 7 == 0, F.lit("x")).otherwise(F.col("l_linenumber").cast("string"))
    whole = [F.col(c).cast("bigint").cast("string") for c in ("l_quantity", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_quantity", "l_partkey")]
    zero = F.lit("0")
    cells = [zero, F.col("l_orderkey").cast("string"), zero, zero, *whole, bad]
    li.select(*(c.alias(f"c{i}") for i, c in enumerate(cells))).write.option("header", True).csv(folder)
    p = load_room_climate_csv(spark, folder)
    return p.select("ts", "temp", "humidity", "light1", "light2", "occupancy", "activity", "door", "window")


def named_csv(spark, sf_dir):
    """Columns found by their header names, in another order, between others."""
    from chronoloom.sources.loaders import load_named_csv

    folder = scratch(spark, "named")
    e = table(spark, sf_dir, "events")
    wall = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    e.select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("value"), wall).write.option("header", True).csv(folder)
    return load_named_csv(spark, folder, "named").select("series_key", "ts", "value")


def _framed_folder(spark, sf_dir, blocks=None):
    from chronoloom.sources.formats import write_series_files

    folder = scratch(spark, "framed")
    write_series_files(_blocks(spark, sf_dir) if blocks is None else blocks, folder, ["value"]).write.mode("overwrite").format("noop").save()
    return folder


def framed_text_range(spark, sf_dir):
    """Framed files of all series between two wall-clock texts of another time zone."""
    from chronoloom.sources.formats import query_framed

    folder = _framed_folder(spark, sf_dir)
    return _decoded(query_framed(spark, folder, ["value"], "2024-01-08 02:00:00", "2024-01-17 02:00:00", tz="Europe/Bucharest"))


def framed_damaged(spark, sf_dir):
    """Blocks cut to 20 bytes: the first point of each is kept, and the next block is read."""
    from chronoloom.sources.formats import query_framed

    folder = _framed_folder(spark, sf_dir, _blocks(spark, sf_dir).withColumn("payload", F.substring("payload", 1, 20)))
    return _decoded(query_framed(spark, folder, ["value"], 0, (1 << 63) - 1, damaged="keep"))


def _filled_store(spark, sf_dir):
    """A univariate series, one of two variables and an empty one; the first is flushed in between."""
    from chronoloom.plans.store import SeriesStore

    store = SeriesStore(spark, scratch(spark, "store"))
    store.create_series("click", ["value"], DAY)
    store.create_series("empty", ["value"], DAY)
    store.create_series("two wide", ["value", "id"], DAY)
    p = event_points(spark, sf_dir)
    store.insert("click", p.filter("series_key = 'click'").select("seq", "ts", "value"))
    store.flush_all()
    store.insert("two wide", p.filter("series_key <> 'click'").select("seq", "ts", "value", F.col("seq").cast("double").alias("id")))
    return store


def store_totals(spark, sf_dir):
    """Sealed and open blocks of series of different widths, in one aggregate."""
    return _filled_store(spark, sf_dir).every_series_stats().select("series_key", "num_variables", "total_points", "num_blocks", "original_bytes")


def store_catalog(spark, sf_dir):
    """Series in creation order with their variables, what a scan of all finds of each, and an absent key."""
    store = _filled_store(spark, sf_dir)
    store.flush_all()
    found = None
    for key, blocks in store.scan_all():
        row = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("points")).withColumn("series_key", F.lit(key))
        found = row if found is None else found.unionByName(row)
    absent = store.query("absent", T0, T1).agg(F.count("*").alias("points")).select(F.lit("absent").alias("series_key"), F.lit(0).cast("bigint").alias("blocks"), "points")
    names = store.catalog().select("series_key", "created_seq", F.concat_ws(",", "variable_names").alias("variables"))
    return found.unionByName(absent).join(names, "series_key", "left")


def store_wide_range(spark, sf_dir):
    """A range of the series of two variables, which is still open."""
    p = _filled_store(spark, sf_dir).query("two wide", T0, T1)
    return p.select("series_key", "ts", double_bits(F.col("value")).alias("vb"), F.col("id").cast("bigint").alias("id"))


QUERIES = {
    "scan_points": scan_points,
    "assign_blocks": assign_events,
    "assign_blocks_late": assign_late,
    "ts_delta_dod": ts_deltas,
    "dod_cost": dod_costs,
    "dod_buckets": dod_buckets,
    "twos_complement": twos,
    "value_xor": value_xor,
    "xor_window": xor_window,
    "block_sizes_standard": _sizes("standard"),
    "block_sizes_guarded": _sizes("guarded"),
    "packed_sizes": packed_sizes,
    "series_stats": series_statistics,
    "store_stats": store_statistics,
    "codec_comparison": compare_codecs,
    "xor_classes": classes,
    "range_query": range_events,
    "range_query_compat": range_compat,
    "range_query_series": range_one_series,
    "query_all": query_everything,
    "roundtrip_standard": _roundtrip("standard"),
    "roundtrip_guarded": _roundtrip("guarded"),
    "codecs_agree": codecs_agree,
    "multivariate_sizes": multivariate_sizes,
    "multivariate_roundtrip": multivariate_roundtrip,
    "describe_series": describe_series,
    "sort_points": sort_points,
    "first_points": first_points,
    "first_window": first_window,
    "duration_hours": duration_hours,
    "list_series": list_series,
    "series_counts": series_counts,
    "framed_roundtrip": framed_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "raw_roundtrip": raw_roundtrip,
    "store_roundtrip": store_roundtrip,
    "stream_ingest": stream_ingest,
    "bit_stream": bit_stream,
    "single_block": single_block,
    "locf": locf,
    "formatted_sizes": formatted_sizes,
    "csv_ratio": csv_ratio,
    "final_comparison": compare_datasets,
    "room_csv": room_csv,
    "named_csv": named_csv,
    "framed_text_range": framed_text_range,
    "framed_damaged": framed_damaged,
    "store_totals": store_totals,
    "store_catalog": store_catalog,
    "store_wide_range": store_wide_range,
}

_P = "p as (select event_type as series_key, event_id as seq, (epoch_us(ts) // 1000)::bigint as ts, value from events)"
_A = (
    _P + f", b as (select *, max(ts - ((ts % {DAY}) + {DAY}) % {DAY}) over (partition by series_key order by seq rows unbounded preceding) as block_start from p)"
)
_W = "(partition by series_key, block_start order by seq)"
_D = _A + f", d0 as (select *, row_number() over {_W} as rn, ts - lag(ts) over {_W} as delta from b), d as (select *, delta - lag(delta) over {_W} as dod from d0)"
_COST = (
    "case when dod = 0 then 1 when dod between -64 and 63 then 9 when dod between -256 and 255 then 12 when dod between -2048 and 2047 then 16 else 36 end"
)
_BUCKET = "case when dod = 0 then 'zero' when dod between -64 and 63 then 'w7' when dod between -256 and 255 then 'w9' when dod between -2048 and 2047 then 'w12' else 'w32' end"


def _bits(c: str) -> str:
    return f"({c}::double)::bit::bigint"


def _clz(c: str) -> str:
    return f"(64 - length(ltrim({c}::bit::varchar, '0')))"


def _ctz(c: str) -> str:
    return f"(64 - length(rtrim({c}::bit::varchar, '0')))"


_X = _D + f", x0 as (select *, {_bits('value')} as vb from d), x as (select *, xor(vb, lag(vb) over {_W}) as x from x0)"


def _fold(windows: str, guarded: bool) -> str:
    """Bits and class counts of an ordered list of {b, l, t, s, r, f} whose head is the initial state."""
    fits = "a.l <> 255 and e.l >= a.l and e.t >= a.t" + (" and not ((64 - a.l - a.t) - (64 - e.l - e.t) > 11)" if guarded else "")
    return f"""list_reduce({windows}, lambda a, e: case
        when e.l = -1 then {{'b': a.b + 1, 'l': a.l, 't': a.t, 's': a.s + 1, 'r': a.r, 'f': a.f}}
        when {fits} then {{'b': a.b + 2 + 64 - a.l - a.t, 'l': a.l, 't': a.t, 's': a.s, 'r': a.r + 1, 'f': a.f}}
        else {{'b': a.b + 13 + 64 - e.l - e.t, 'l': e.l, 't': e.t, 's': a.s, 'r': a.r, 'f': a.f + 1}} end)"""


def _state(length: str, trail: str) -> str:
    return f"{{'b': 0::bigint, 'l': ({length})::bigint, 't': ({trail})::bigint, 's': 0::bigint, 'r': 0::bigint, 'f': 0::bigint}}"


_SIZES = (
    _X
    + f""", w as (select *, case when x = 0 then -1 else least(31, {_clz("x")}) end as l, case when x = 0 then 0 else {_ctz("x")} end as t from x),
 g as (select series_key, block_start, count(*) as n, min(ts) as min_ts, max(ts) as max_ts,
   sum(case when rn = 1 then 128 when rn = 2 then 64 else {_COST} end)::bigint as fixed,
   list_prepend({_state("255", "0")}, coalesce(list({_state("l", "t")} order by seq) filter (where rn > 1), [])) as ws from w group by all),
 f as (select *, {_fold("ws", False)} as sf, {_fold("ws", True)} as gf from g),
 s as (select *, fixed + sf.b as standard_bits, fixed + gf.b as guarded_bits from f),
 z as (select *, (standard_bits + 7) // 8 as standard_bytes, (guarded_bits + 7) // 8 as guarded_bytes from s)"""
)
_STATS = _SIZES + """, st as (select series_key, sum(n)::bigint as total_points, count(*) as num_blocks, sum(standard_bytes)::bigint as compressed_bytes,
  1::bigint as num_variables, sum(n)::bigint * 16 as original_bytes from z group by 1)"""
_ROUND = "select series_key, block_start, row_number() over (partition by series_key, block_start order by seq) - 1 as pos, ts, " + _bits("value") + " as vb from b"
_NOT_LAST = "select series_key, block_start, n, standard_bits as bits from z qualify block_start < max(block_start) over (partition by series_key)"


def _line_sql(tail: str) -> str:
    order = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
    return f"""with p as (select l_suppkey::varchar as series_key, row_number() over (partition by l_suppkey order by {order}) as seq, (epoch_us(l_shipdate) // 1000)::bigint as ts,
     l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem) {tail}"""


def _multi_sizes_sql() -> str:
    d = 20 * DAY
    cols = "quantity price discount tax".split()
    x = ", ".join(f"xor({_bits(c)}, lag({_bits(c)}) over {_W}) as x_{c}" for c in cols)
    lists = ", ".join(
        f"list_prepend({_state('255', '0')}, coalesce(list({_state(f'case when x_{c} = 0 then -1 else least(31, {_clz(f"x_{c}")}) end', f'case when x_{c} = 0 then 0 else {_ctz(f"x_{c}")} end')} order by seq) filter (where rn > 1), [])) as w_{c}"
        for c in cols
    )
    total = lambda g: " + ".join(f"({_fold(f'w_{c}', g)}).b" for c in cols)
    return _line_sql(f""", b as (select *, max(ts - ((ts % {d}) + {d}) % {d}) over (partition by series_key order by seq rows unbounded preceding) as block_start from p),
     d0 as (select *, row_number() over {_W} as rn, ts - lag(ts) over {_W} as delta, {x} from b), d as (select *, delta - lag(delta) over {_W} as dod from d0),
     g as (select series_key, block_start, count(*) as n, sum(case when rn = 1 then 320 when rn = 2 then 64 else {_COST} end)::bigint as fixed, {lists} from d group by all)
     select series_key, block_start, n, fixed + {total(False)} as standard_bits, fixed + {total(True)} as guarded_bits from g""")


_VB = "series_key, ts, " + _bits("value") + " as vb"
_RATES = """round(case when total_points > 0 then compressed_bytes * 8 / total_points else 0 end, 6) as bits_per_point,"""
_RATIO = "round(case when compressed_bytes > 0 then original_bytes / compressed_bytes else 0 end, 6) as compression_ratio"
_SAVE = "round(case when original_bytes > 0 then (1 - compressed_bytes / original_bytes) * 100 else 0 end, 6) as savings_percent"
_IN = f"ts between {T0} and {T1}"
_WHOLE = _SIZES.replace(_A, _P + ", b as (select *, arg_min(ts, seq) over (partition by series_key) as block_start from p)")
_TWO = "case when series_key = 'click' then 'click' else 'two wide' end"
_MERGED = f"""p as (select {_TWO} as series_key, seq, ts, value from (select event_type as series_key, event_id as seq, (epoch_us(ts) // 1000)::bigint as ts, value from events)),
  b as (select *, max(ts - ((ts % {DAY}) + {DAY}) % {DAY}) over (partition by series_key order by seq rows unbounded preceding) as block_start from p)"""


def _units(c: str) -> str:
    steps = " ".join(f"when {c} < {1024 ** (k + 1)} then printf('%.2f {u}', {c} / {1024**k}::double)" for k, u in enumerate(("B", "KB", "MB", "GB")))
    return f"case {steps} else printf('%.2f TB', {c} / {1024**4}::double) end"


def _line_stats() -> str:
    return f"""select 'lineitem' as series_key, sum(n)::bigint as total_points, 4::bigint as num_variables, sum(n)::bigint * 40 as original_bytes,
      sum((standard_bits + 7) // 8)::bigint as compressed_bytes from ({_multi_sizes_sql()})"""


ORACLE_SQL = {
    "scan_points": f"with {_P} select * from p",
    "assign_blocks": f"with {_A} select series_key, seq, ts, block_start from b",
    "assign_blocks_late": f"""with p as (select event_type as series_key, event_id % 97 * 1000000000 + event_id as seq, (epoch_us(ts) // 1000)::bigint as ts from events)
      select series_key, seq, ts, max(ts - ts % {DAY}) over (partition by series_key order by seq rows unbounded preceding) as block_start from p""",
    "ts_delta_dod": f"with {_D} select series_key, seq, delta, dod from d",
    "dod_cost": f"with {_D} select series_key, seq, {_BUCKET} as bucket, ({_COST})::bigint as cost from d where dod is not null",
    "dod_buckets": f"with {_D} select series_key, {_BUCKET} as bucket, count(*) as points from d where dod is not null group by all",
    "twos_complement": f"with {_D} select series_key, seq, case when dod < 0 then dod + 4294967296 else dod end as u, dod as back from d where dod is not null",
    "value_xor": f"with {_X} select series_key, seq, vb, x from x",
    "xor_window": f"""with {_X} select series_key, seq, {_clz("x")}::bigint as clz, {_ctz("x")}::bigint as ctz, least(31, {_clz("x")})::bigint as l,
      (64 - least(31, {_clz("x")}) - {_ctz("x")})::bigint as m from x where x <> 0""",
    "block_sizes_standard": f"with {_SIZES} select series_key, block_start, n, standard_bits as bits, standard_bytes as bytes from z",
    "block_sizes_guarded": f"with {_SIZES} select series_key, block_start, n, guarded_bits as bits, guarded_bytes as bytes from z",
    "packed_sizes": f"with {_SIZES} select series_key, block_start, n, min_ts, max_ts, guarded_bits as bits, guarded_bytes as bytes from z",
    "series_stats": f"with {_STATS} select series_key, total_points, num_blocks, compressed_bytes, num_variables, original_bytes, {_RATES} {_RATIO}, {_SAVE} from st",
    "store_stats": f"""with {_STATS}, t as (select count(*) as num_series, sum(total_points)::bigint as total_points, sum(num_blocks)::bigint as num_blocks,
      sum(original_bytes)::bigint as original_bytes, sum(compressed_bytes)::bigint as compressed_bytes from st) select *, {_RATIO}, {_SAVE} from t""",
    "codec_comparison": f"""with {_SIZES}, c as (select series_key, sum(n)::bigint as points, sum(standard_bytes)::bigint as standard_bytes,
      sum(guarded_bytes)::bigint as guarded_bytes from z group by rollup (series_key))
      select *, points * 16 as original_bytes, standard_bytes - guarded_bytes as diff_bytes,
      round((standard_bytes - guarded_bytes) * 100 / standard_bytes, 6) as improvement_percent, """
    + ", ".join(
        f"round(points * 16 / {c}_bytes, 6) as {c}_ratio, round((1 - {c}_bytes / (points * 16)) * 100, 6) as {c}_savings, round({c}_bytes * 8 / points, 6) as {c}_bits_per_point"
        for c in ("standard", "guarded")
    )
    + " from c",
    "xor_classes": f"""with {_SIZES} select series_key, 'standard' as codec, sum(sf.s)::bigint as same, sum(sf.r)::bigint as reuse, sum(sf.f)::bigint as fresh from z group by 1
      union all select series_key, 'guarded', sum(gf.s)::bigint, sum(gf.r)::bigint, sum(gf.f)::bigint from z group by 1""",
    "range_query": f"with {_A} select {_VB} from b where {_IN}",
    "range_query_compat": f"with {_A} select {_VB} from b where {_IN} and block_start <= {T1} and block_start + {DAY} >= {T0}",
    "range_query_series": f"with {_A} select {_VB} from b where {_IN} and series_key = 'click'",
    "query_all": f"with {_A} select {_VB} from b where ts >= 0",
    "roundtrip_standard": f"with {_A} {_ROUND}",
    "roundtrip_guarded": f"with {_A} {_ROUND}",
    "codecs_agree": "select 0::bigint as mismatches",
    "multivariate_sizes": _multi_sizes_sql(),
    "multivariate_roundtrip": _line_sql("select series_key, ts, " + ", ".join(f"{_bits(c)} as {c}" for c in ("quantity", "price", "discount", "tax")) + " from p"),
    "describe_series": f"with {_P} select series_key, count(value) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from p group by 1",
    "sort_points": f"with {_P} select * from p order by ts, value, seq",
    "first_points": f"with {_P} select * from p qualify row_number() over (partition by series_key order by seq) <= 5",
    "first_window": f"with {_P} select p.* from p join (select series_key, arg_min(ts, seq) as f from p group by 1) using (series_key) where ts between f and f + 3600000",
    "duration_hours": f"with {_P} select series_key, round((arg_max(ts, seq) - arg_min(ts, seq)) / 3600000, 6) as hours from p group by 1",
    "list_series": f"with {_P} select series_key, min(seq) as created_seq from p group by 1",
    "series_counts": f"with {_P} select series_key, count(*) as total_points from p group by 1",
    "framed_roundtrip": f"with {_P} select {_VB} from p",
    "csv_roundtrip": "select 'events' as series_key, epoch_us(date_trunc('second', ts)) // 1000 as ts, " + _bits("value") + " as vb from events",
    "raw_roundtrip": f"with {_SIZES} select series_key, block_start, n, standard_bytes as bytes from z",
    "store_roundtrip": f"with {_P} select {_VB} from p where {_IN} and series_key = 'click'",
    "stream_ingest": f"with {_SIZES} {_NOT_LAST}",
    "bit_stream": f"""with {_P} select seq, lower(lpad(to_hex(128 + seq % 8 * 16), 2, '0') || lpad(to_hex(seq), 8, '0') || lpad(to_hex(ts), 16, '0') || lpad(to_hex(seq), 16, '0')
      || hex(series_key)) as stream, (168 + 8 * strlen(series_key))::bigint as bits, (21 + strlen(series_key))::bigint as bytes, 1::bigint as peeked,
      (8 + seq % 8)::bigint as head, seq as u32, ts as i64, seq as u64, (8 * strlen(series_key))::bigint as bits_left, series_key as tail from p""",
    "single_block": f"with {_WHOLE} select series_key, block_start, n, guarded_bits as bits from z",
    "locf": f"""with {_P} select series_key, seq, last_value(case when seq % 3 <> 0 then value end ignore nulls)
      over (partition by series_key order by seq rows unbounded preceding) as value from p""",
    "formatted_sizes": f"with {_STATS} select series_key, {_units('original_bytes')} as original, {_units('compressed_bytes')} as compressed from st",
    "csv_ratio": f"""with {_STATS}, t as (select sum(length(ts::varchar) + length(seq::varchar) + 2)::bigint as csv_bytes from p),
      c as (select sum(compressed_bytes)::bigint as compressed_bytes from st) select csv_bytes, compressed_bytes, round(csv_bytes / compressed_bytes, 6) as ratio from t, c""",
    "final_comparison": f"""with {_STATS}, lines as ({_line_stats()}), u as (select 'events' as dataset, series_key, total_points, num_variables, original_bytes, compressed_bytes from st
      union all select 'lineitem', * from lines) select dataset, series_key, total_points, num_variables, round(original_bytes / compressed_bytes, 2) as compression_ratio,
      round((1 - compressed_bytes / original_bytes) * 100, 2) as savings_percent from u union all select 'absent', null, null, null, null, null""",
    "room_csv": """select l_orderkey as ts, floor(l_quantity)::double as temp, l_partkey::double as humidity, l_suppkey::double as light1, l_linenumber::double as light2,
      l_orderkey::double as occupancy, floor(l_quantity)::double as activity, l_partkey::double as door, l_linenumber::double as "window" from lineitem where l_orderkey % 7 <> 0""",
    "named_csv": "select 'named' as series_key, epoch_us(date_trunc('second', ts)) // 1000 as ts, event_id::double as value from events",
    "framed_text_range": f"with {_A} select {_VB} from b where ts between 1704672000000 and 1705449600000",
    "framed_damaged": f"with {_D} select {_VB} from d where rn = 1",
    "store_totals": f"""with {_MERGED}, s as (select series_key, count(*) as total_points, count(distinct block_start) as num_blocks from b group by 1),
      c as (select * from (values ('click', 1::bigint), ('empty', 1), ('two wide', 2)) v(series_key, num_variables))
      select series_key, num_variables, coalesce(total_points, 0)::bigint as total_points, coalesce(num_blocks, 0)::bigint as num_blocks,
      coalesce(total_points, 0)::bigint * (8 + 8 * num_variables) as original_bytes from c left join s using (series_key)""",
    "store_catalog": f"""with {_MERGED}, s as (select series_key, count(*) as points, count(distinct block_start) as blocks from b group by 1),
      c as (select * from (values ('click', 0::bigint, 'value'), ('empty', 1, 'value'), ('two wide', 2, 'value,id'), ('absent', null, null)) v(series_key, created_seq, variables))
      select series_key, coalesce(blocks, 0)::bigint as blocks, coalesce(points, 0)::bigint as points, created_seq, variables from c left join s using (series_key)""",
    "store_wide_range": f"with {_MERGED} select {_VB}, seq as id from b where {_IN} and series_key = 'two wide'",
}
