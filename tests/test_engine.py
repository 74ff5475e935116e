import pytest
from pyspark.sql import functions as F

from chronoloom.functions.bits import align_bits, bit_string, format_bytes
from chronoloom.operators.assign import assign_blocks
from chronoloom.operators.blocks import compress, prune, query_all, range_query, unpack
from chronoloom.operators.sizing import block_sizes
from chronoloom.operators.stats import codec_comparison, series_stats, store_stats
from chronoloom.plans.store import SeriesStore
from chronoloom.schema import BLOCK_SCHEMA, check_variables, validate_points
from chronoloom.sources.formats import query_framed, read_framed, write_series_files
from chronoloom.sources.loaders import load_named_csv, load_room_climate_csv, load_univariate_csv

D = 7_200_000


def points(spark, rows):
    return spark.createDataFrame([("s", i, t, float(v)) for i, (t, v) in enumerate(rows)], "series_key string, seq bigint, ts bigint, value double")


def starts(spark, ts, **kw):
    df = validate_points(points(spark, [(t, 0) for t in ts]), ["value"])
    return [r.block_start for r in assign_blocks(df, D, **kw).orderBy("seq").collect()]


def test_assignment(spark):
    assert starts(spark, [-1]) == [-D]
    assert starts(spark, [D, 2 * D - 1, 2 * D, 5, 2 * D + 1]) == [D, D, 2 * D, 2 * D, 2 * D]
    ts = [5 * D, 1, 7 * D + 3, 2, 3, 9 * D, -5, 9 * D]
    assert starts(spark, ts, seq_chunk=2) == starts(spark, ts)
    whole = assign_blocks(validate_points(points(spark, [(7, 0), (99 * D, 0)]), ["value"]), None)
    assert {r.block_start for r in whole.collect()} == {7}
    with pytest.raises(ValueError):
        assign_blocks(points(spark, []), 0)


def test_late_points_and_ranges(spark):
    blocks = compress(points(spark, [(3 * D, 1), (10, 2), (3 * D + 5, 3), (4 * D, 4), (-3, 5)]))
    got = lambda df: sorted((r.ts, r.value) for r in df.collect())
    assert got(range_query(blocks, ["value"], 10, 10)) == [(10, 2.0)]
    assert got(range_query(blocks, ["value"], 10, 10, compat_pruning=True)) == []
    assert got(query_all(blocks, ["value"])) == [(10, 2.0), (3 * D, 1.0), (3 * D + 5, 3.0), (4 * D, 4.0)]
    assert unpack(blocks, ["value"]).count() == 5
    assert prune(blocks, 4 * D, 4 * D, compat=True).count() == 2  # the nominal end counts as inside


def test_validation(spark):
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            check_variables(bad)
    df = spark.createDataFrame([("s", 0, 1, None)], "series_key string, seq bigint, ts bigint, value double")
    with pytest.raises(Exception, match="null in column value"):
        compress(df).collect()
    with pytest.raises(ValueError):
        validate_points(df.drop("ts"), ["value"])
    wide = points(spark, [(0, 1), (2**40, 2), (5, 3), (6, 4)])
    with pytest.raises(Exception, match="32 signed bits"):
        compress(wide, duration_ms=2**50).collect()
    split = compress(wide, duration_ms=2**50, on_overflow="new_epoch")
    assert sorted(r.ts for r in unpack(split, ["value"]).collect()) == [0, 5, 6, 2**40]


def test_stats_guards_and_comparison(spark):
    empty = series_stats(spark.createDataFrame([], BLOCK_SCHEMA))
    row = store_stats(empty).first()
    assert (row.num_series, row.compression_ratio, row.savings_percent) == (0, 0.0, 0.0)
    sizes = block_sizes(assign_blocks(validate_points(points(spark, [(i * 60_000, (i * 7) % 5) for i in range(300)]), ["value"]), D))
    stats = series_stats(sizes, 1, "standard_bytes").first()
    packed = compress(points(spark, [(i * 60_000, (i * 7) % 5) for i in range(300)]))
    assert stats.compressed_bytes == packed.agg(F.sum("size_bytes")).first()[0] and stats.original_bytes == 300 * 16
    both = codec_comparison(sizes, csv_bytes=5000)
    assert both.count() == 2 and both.filter("series_key is null").first().points == 300


def test_store(spark, tmp_path):
    store = SeriesStore(spark, f"file://{tmp_path}/store")
    assert store.query("none", 0, 9).count() == 0 and store.get_series("none") is None
    assert store.total_stats().first().num_series == 0
    store.create_series("a", ["value"], D)
    store.create_series("b/ü", ["x", "y"], D)
    with pytest.raises(ValueError):
        store.create_series("a")
    with pytest.raises(KeyError):
        store.insert("none", points(spark, [(1, 1)]))
    store.insert("a", points(spark, [(1, 1), (D, 2)]).drop("series_key"))
    assert store.query_all("a").count() == 2 and store.blocks("a").count() == 2
    store.flush_all()
    assert store.query_all("a").count() == 2
    later = spark.createDataFrame([(9, 3, 7.0)], "seq bigint, ts bigint, value double")
    store.insert("a", later)
    assert sorted(r.ts for r in store.query("a", 0, D - 1).collect()) == [1, 3]
    stats = store.series_stats("a").first()
    assert (stats.total_points, stats.num_blocks) == (3, 3)
    assert [r.series_key for r in store.list_series().collect()] == ["a", "b/ü"]
    assert [k for k, _ in store.scan_all()] == ["a", "b/ü"]
    total = store.total_stats().first()
    assert (total.num_series, total.total_points) == (2, 3)


def test_framed_files(spark, tmp_path):
    blocks = compress(points(spark, [(i * 60_000, i % 9) for i in range(500)]))
    folder = str(tmp_path / "framed")
    meta = write_series_files(blocks, folder, ["value"]).first()
    size = blocks.agg(F.sum("size_bytes")).first()[0]
    assert (meta.num_blocks, meta.total_points, meta.compressed_bytes) == (5, 500, size + 5 * 8)
    assert query_framed(spark, folder, ["value"], 60_000, 120_000, "s").count() == 2
    assert read_framed(spark, folder).filter("series_key = 'other'").count() == 0
    with open(f"{folder}/s.bin", "ab") as f:
        f.write(b"\5\0\0\0\xff\0\0\0abc")
    assert query_framed(spark, folder, ["value"], 0, D, mode="PERMISSIVE").count() == 121
    with pytest.raises(Exception, match="cut short"):
        read_framed(spark, folder).collect()


def test_loaders(spark, tmp_path):
    cpu = tmp_path / "cpu.csv"
    cpu.write_text('"datetime","cpu"\n2017-01-27 18:42:00,1.5\n2017-1-27 8:2:1,2\nbad,3\n2017-01-27 18:43:00,1_0\n2017-01-27 18:44:00,0x1p3\n2017-01-27 18:45:00\n2017-01-27 18:46:00,nan\n')
    got = load_univariate_csv(spark, str(cpu), "cpu", "v", "Europe/Bucharest").orderBy("seq").collect()
    assert [r.ts for r in got] == [1485535320000, 1485496921000, 1485535560000] and got[0].v == 1.5 and got[2].v != got[2].v
    named = tmp_path / "named.csv"
    named.write_text("value,timestamp\n3,1970-01-01 00:00:05\n")
    assert load_named_csv(spark, str(named), "n").first()[2:] == (5000, 3.0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_named_csv(spark, str(tmp_path / "none.csv"), "n")
    room = tmp_path / "room.csv"
    room.write_text("h\n1,1000,0,1,20.5,40,1,2,3,4,0,1\n1,2000,0\n1,x,0,1,20.5,40,1,2,3,4,0,1\n")
    rows = load_room_climate_csv(spark, str(room)).collect()
    assert len(rows) == 1 and rows[0].ts == 1000 and rows[0].temp == 20.5 and rows[0].window == 1.0


def test_bit_text(spark):
    row = spark.range(1).select(
        bit_string(F.lit(-1), 3).alias("a"), align_bits(F.lit("101")).alias("b"), format_bytes(F.lit(1536)).alias("c"), bit_string(F.lit(5), 0).alias("d")
    ).first()
    assert tuple(row) == ("111", "10100000", "1.50 KB", "")


def test_framed_splits_and_names(spark, tmp_path, monkeypatch):
    """A file is split at the offsets of its sidecar; keys of any characters name files of their own."""
    from chronoloom.sources import formats

    monkeypatch.setattr(formats, "INDEX_BYTES", 300)
    folder, keys = str(tmp_path / "split"), ["\x101", "ā", "_a", ".b", "a/b"]
    assert len({formats.file_name(k) for k in keys}) == 5 and [formats.key_of(formats.file_name(k)) for k in keys] == keys
    rows = points(spark, [(i * 3_600_000, i) for i in range(200)])
    many = rows.withColumn("series_key", F.explode(F.array(*(F.lit(k) for k in keys))))
    blocks = compress(many)
    write_series_files(blocks, folder, ["value"]).count()
    whole = read_framed(spark, folder)
    split = spark.read.format("framed_blocks").option("partBytes", "400").load(folder)
    assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    assert split.exceptAll(whole).count() == 0 and split.count() == whole.count() == blocks.count()
    assert query_framed(spark, folder, ["value"], "1970-01-01 02:00:00", "1970-01-01 03:00:00", "ā", tz="Europe/Bucharest").count() == 2
    with pytest.raises(ValueError):
        unpack(blocks, ["value"], damaged="skip")
