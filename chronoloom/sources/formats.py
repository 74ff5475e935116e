"""Binary block files.

framed: repeated [u32 count][u32 length][payload], little-endian headers, with a
JSON sidecar whose compressed_bytes includes the 8 bytes of each frame.
raw: payloads back to back, with a JSON sidecar that holds the block index.

Writers run on executors, one file per series, under a path that all of them
share. The reader is a Python data source that plans by file names and sizes
alone; tasks walk the frame headers. Files beyond PART_BYTES are split at the
offsets that their sidecars list.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from chronoloom.functions.times import bound_millis
from chronoloom.operators.blocks import unpack

HEADER_FORM, HEADER_SIZE = "<II", 8
FRAME_SCHEMA = "series_key string, epoch int, block_start bigint, frame bigint, n bigint, size_bytes bigint, payload binary"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


#: Bytes of frames per task, and between two offsets of a sidecar's frame index.
PART_BYTES, INDEX_BYTES = 64 << 20, 32 << 20


def file_name(key: str) -> str:
    """The key with all but letters, digits and _.-~ as percent-escaped UTF-8; a leading dot or underscore, which would hide the file, too."""
    name = quote(key, safe="")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in (".", "_") else name


def key_of(name: str) -> str:
    return unquote(name)


def write_series_files(blocks: DataFrame, folder: str, variables: Sequence[str], framed: bool = True, duration_ms: int | None = None) -> DataFrame:
    """Write <series>.bin and its JSON per series, blocks in order; returns series_key, num_blocks, total_points, compressed_bytes.

    Blocks of a series arrive sorted and are streamed to its file, so memory holds one Arrow batch.
    """
    names = list(variables)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _fs(folder)
        store.create_dir(top, recursive=True)
        key, out, index, marks, at = None, None, [], [], 0

        def close() -> pa.RecordBatch:
            out.close()
            total = sum(x["count"] for x in index)
            size = sum(x["size_bytes"] + (HEADER_SIZE if framed else 0) for x in index)
            meta = {"series_name": key, "variable_names": names, "total_points": total, "compressed_bytes": size, "num_blocks": len(index)}
            meta |= {"last_update": datetime.now(UTC).isoformat(timespec="seconds")} if framed else {"block_duration_ms": duration_ms, "blocks": index}
            meta |= {"frame_index": marks} if framed else {}
            meta |= {"series_key": key}
            with store.open_output_stream(f"{top}/{file_name(key)}{'_meta' if framed else '.meta'}.json") as side:
                side.write(json.dumps(meta, indent=2).encode())
            row = {"series_key": key, "num_blocks": len(index), "total_points": total, "compressed_bytes": size}
            return pa.RecordBatch.from_pylist([row], pa.schema([("series_key", pa.string()), *((c, pa.int64()) for c in list(row)[1:])]))

        for batch in batches:
            for k, start, n, payload in zip(*(batch[c].to_pylist() for c in ("series_key", "block_start", "n", "payload")), strict=True):
                if out is None or k != key:
                    if out is not None:
                        yield close()
                    key, index, marks, at, out = k, [], [], 0, store.open_output_stream(f"{top}/{file_name(k)}.bin")
                if not marks or at - marks[-1][1] >= INDEX_BYTES:
                    marks.append((len(index), at))
                at += HEADER_SIZE + len(payload)
                out.write((struct.pack(HEADER_FORM, n, len(payload)) if framed else b"") + payload)
                index.append({"start_timestamp": start, "count": n, "size_bytes": len(payload)})
        if out is not None:
            yield close()

    ordered = blocks.repartition("series_key").sortWithinPartitions("series_key", "epoch", "block_start")
    return ordered.mapInArrow(kernel, "series_key string, num_blocks bigint, total_points bigint, compressed_bytes bigint")


class _Frames(InputPartition):
    """Spans (path, first frame, first byte, end byte, size of the file); the end is the file's own in the last span."""

    def __init__(self, spans: list[tuple[str, int, int, int, int]]):
        self.spans = spans


class FramedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.mode = options["path"], options.get("mode", "FAILFAST").upper()
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """A series_key equality prunes files by name; every filter is also left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("series_key",):
                self.keys = {f.value} if self.keys is None else self.keys & {f.value}
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, top = _fs(self.folder)
        out, spans, held = [], [], 0
        for info in sorted(store.get_file_info(pafs.FileSelector(top)), key=lambda x: x.path):
            if not info.path.endswith(".bin") or (self.keys is not None and key_of(info.base_name.removesuffix(".bin")) not in self.keys):
                continue
            marks = [(0, 0)]
            if info.size > self.part_bytes:
                with store.open_input_stream(info.path.removesuffix(".bin") + "_meta.json") as side:
                    marks = json.loads(side.read()).get("frame_index") or marks
            for (frame, at), end in zip(marks, [*(z for _, z in marks[1:]), info.size], strict=True):
                if spans and held + end - at > self.part_bytes:
                    out.append(_Frames(spans))
                    spans, held = [], 0
                spans.append((info.path, frame, at, end, info.size))
                held += end - at
        return [*out, _Frames(spans)]

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        store, _ = _fs(self.folder)
        rows: list[tuple] = []
        held = 0
        for path, frame, at, end, size in partition.spans:
            key = key_of(os.path.basename(path).removesuffix(".bin"))
            with store.open_input_file(path) as f:
                f.seek(at)
                source = pa.BufferedInputStream(f, 1 << 20)
                while at < end:
                    head = source.read(min(HEADER_SIZE, size - at))
                    n, length = struct.unpack(HEADER_FORM, head) if len(head) == HEADER_SIZE else (0, size)
                    if at + HEADER_SIZE + length > size:
                        if self.mode == "FAILFAST":
                            raise ValueError(f"{path}: frame {frame} is cut short")
                        break
                    rows.append((key, 0, None, frame, n, length, bytes(source.read(length))))
                    at, frame, held = at + HEADER_SIZE + length, frame + 1, held + length
                    if len(rows) >= 1000 or held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


ARROW_FRAMES = pa.schema(
    [
        ("series_key", pa.string()),
        ("epoch", pa.int32()),
        ("block_start", pa.int64()),
        ("frame", pa.int64()),
        ("n", pa.int64()),
        ("size_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW_FRAMES, strict=True)], schema=ARROW_FRAMES)


class FramedBlocks(DataSource):
    """spark.read.format("framed_blocks").load(folder); options mode (FAILFAST or PERMISSIVE) and partBytes."""

    @classmethod
    def name(cls) -> str:
        return "framed_blocks"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> FramedReader:
        return FramedReader(self.options)


def read_framed(spark: SparkSession, folder: str, mode: str = "FAILFAST") -> DataFrame:
    """Blocks of framed files, with frame as the order within a series; block_start isn't stored there and is null."""
    spark.dataSource.register(FramedBlocks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("framed_blocks").option("mode", mode).load(folder)


def query_framed(
    spark: SparkSession,
    folder: str,
    variables: Sequence[str],
    t0: int | str,
    t1: int | str,
    series_key: str | None = None,
    mode: str = "FAILFAST",
    tz: str = "UTC",
    damaged: str = "error",
) -> DataFrame:
    """Inclusive range query over framed files: every frame is decoded, as they carry no bounds.

    Bounds are milliseconds or text on the wall clock of tz. damaged="keep"
    keeps the points of a broken block that stand before the damage and goes on
    with the next block.
    """
    frames = read_framed(spark, folder, mode)
    if series_key is not None:
        frames = frames.filter(F.col("series_key") == series_key)
    return unpack(frames.withColumn("block_start", F.col("frame")), variables, bound_millis(t0, tz), bound_millis(t1, tz), damaged)


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of raw files. A task adds up the offsets of a sidecar's index; the blocks are then read in runs of PART_BYTES, each file opened once a run."""
    index = "series_name string, blocks array<struct<start_timestamp:bigint,count:bigint,size_bytes:bigint>>"
    meta = spark.read.json(f"{folder}/*.meta.json", schema=index, multiLine=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blocks in zip(batch["series_name"].to_pylist(), batch["blocks"], strict=True):
                b = blocks.values
                if b is None or not len(b):
                    continue
                size = b.field("size_bytes").to_numpy()
                at = np.cumsum(size) - size
                columns = [pa.array([name] * len(b)), b.field("start_timestamp"), pa.array(np.arange(len(b))), b.field("count"), pa.array(size), pa.array(at), pa.array(at // PART_BYTES)]
                for lo in range(0, len(b), 10_000):
                    yield pa.RecordBatch.from_arrays(columns, names=["series_key", "block_start", "frame", "n", "size_bytes", "at", "run"]).slice(lo, 10_000)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _fs(folder)
        name, file, rows, held = None, None, [], 0
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["series_key"] != name:
                        if file is not None:
                            file.close()
                        name, file = r["series_key"], store.open_input_file(f"{top}/{file_name(r['series_key'])}.bin")
                    rows.append((name, 0, r["block_start"], r["frame"], r["n"], r["size_bytes"], bytes(file.read_at(r["size_bytes"], r["at"]))))
                    held += r["size_bytes"]
                    if len(rows) >= 1000 or held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)
        finally:
            if file is not None:
                file.close()

    placed = meta.mapInArrow(place, "series_key string, block_start bigint, frame bigint, n bigint, size_bytes bigint, at bigint, run bigint")
    return placed.repartition("series_key", "run").sortWithinPartitions("series_key", "at").mapInArrow(kernel, FRAME_SCHEMA)


__all__ = ["FramedBlocks", "query_framed", "read_framed", "read_raw", "write_series_files"]
