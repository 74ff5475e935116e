"""Packing points into blocks and reading them back: pack, unpack, range queries."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.assign import assign_blocks
from chronoloom.operators.codec import pack_blocks, unpack_blocks
from chronoloom.schema import BLOCK_SCHEMA, DEFAULT_DURATION_MS, KEYS, check_variables, points_schema, validate_points

MAX_TS = (1 << 63) - 1
LARGE_BLOCK_POINTS, OUT_ROWS, DECODE_POINTS = 5_000_000, 20_000, 1 << 18


def pack(assigned: DataFrame, variables: Sequence[str] | None, codec: str = "standard", by_range: bool = False) -> DataFrame:
    """Pack points that carry block_start.

    Without variables the points hold an array column named values, whose
    length may differ from series to series. by_range deals key ranges instead
    of hashes, so that files written from the result cover few series each.

    Points are dealt by (series, epoch, block) and sorted, and a task encodes
    all whole blocks of an Arrow batch at once; only a block longer than a batch
    is held back until it ends.
    """
    if codec not in ("standard", "guarded"):
        raise ValueError("codec must be standard or guarded")
    names = None if variables is None else check_variables(variables)

    def packed(rows: pa.Table, ts: np.ndarray, starts: np.ndarray) -> list[tuple[bytes, int]]:
        if names is not None:
            return pack_blocks(ts, np.stack([rows[v].to_numpy() for v in names], axis=1), starts, codec == "guarded")
        lists = rows["values"].combine_chunks()
        widths, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(np.append(starts, len(ts)))
        out: list = [None] * len(starts)
        for k in np.unique(widths[starts]).tolist():
            chosen = np.flatnonzero(widths[starts] == k)
            rows_k = np.repeat(widths[starts] == k, sizes)
            if (widths[rows_k] != k).any():
                raise ValueError("points of one block differ in their number of values")
            values = flat[np.repeat(rows_k, widths)].reshape(-1, k)
            for b, done in zip(chosen.tolist(), pack_blocks(ts[rows_k], values, np.cumsum(sizes[chosen]) - sizes[chosen], codec == "guarded"), strict=True):
                out[b] = done
        return out

    def encode(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows[c].combine_chunks() for c in KEYS]
        starts = np.append(0, np.flatnonzero(changes(keys)) + 1)
        counts = np.diff(np.append(starts, rows.num_rows))
        if counts.max() > LARGE_BLOCK_POINTS:
            warnings.warn(f"a block holds {counts.max()} points; late data may have piled up in it", stacklevel=2)
        ts = rows["ts"].to_numpy()
        done = packed(rows, ts, starts)
        m = len(starts)
        columns = [k.take(pa.array(starts)) for k in keys]
        columns += [pa.array(counts), pa.array(np.minimum.reduceat(ts, starts)), pa.array(np.maximum.reduceat(ts, starts)), pa.array([codec] * m)]
        columns += [pa.array([bits for _, bits in done]), pa.array([len(p) for p, _ in done]), pa.array([p for p, _ in done], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema=ARROW_BLOCKS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.flatnonzero(changes([batch[c] for c in KEYS])) + 1
            fresh = bool(held) and any(held[-1][c][held[-1].num_rows - 1] != batch[c][0] for c in KEYS)
            last = int(cuts[-1]) if cuts.size else 0
            if fresh or last:
                done = pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])])
                if done.num_rows:
                    yield encode(done)
                held = []
            held.append(batch.slice(last))
        if held:
            yield encode(pa.Table.from_batches(held))

    cols = assigned.select(*KEYS, "seq", "ts", *(["values"] if names is None else [F.col(f"`{v}`") for v in names]))
    dealt = (cols.repartitionByRange(*KEYS) if by_range else cols.repartition(*KEYS)).sortWithinPartitions(*KEYS, "seq")
    return dealt.mapInArrow(kernel, BLOCK_SCHEMA)


def changes(keys: list) -> np.ndarray:
    """Where a row's key differs from the row before, from the second row on."""
    out = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        out |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
    return out


ARROW_BLOCKS = pa.schema(
    [
        ("series_key", pa.string()),
        ("epoch", pa.int32()),
        ("block_start", pa.int64()),
        ("n", pa.int64()),
        ("min_ts", pa.int64()),
        ("max_ts", pa.int64()),
        ("codec", pa.string()),
        ("bit_len", pa.int64()),
        ("size_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def compress(
    points: DataFrame, variables: Sequence[str] = ("value",), duration_ms: int | None = DEFAULT_DURATION_MS, codec: str = "standard", on_overflow: str = "error"
) -> DataFrame:
    """Validate, assign and pack. on_overflow: error, or new_epoch to start a fresh block run where a delta-of-delta is too wide."""
    checked = validate_points(points, variables)
    assigned = assign_blocks(checked, duration_ms)
    if on_overflow == "new_epoch":
        assigned = split_overflow(assigned)
    elif on_overflow != "error":
        raise ValueError("on_overflow must be error or new_epoch")
    return pack(assigned, variables, codec)


def split_overflow(assigned: DataFrame) -> DataFrame:
    """Cut a block before each delta that doesn't fit 31 signed bits, so that no delta-of-delta leaves 32 bits.

    The part's number is added to epoch times 2^12 within its block; a block with more parts than that raises.
    """
    from chronoloom.operators.assign import block_order

    w = block_order()
    gap = F.col("ts") - F.lag("ts").over(w)
    wide = F.when(gap.isNotNull() & ~gap.between(-(1 << 30), (1 << 30) - 1), 1).otherwise(0)
    part = F.sum("_wide").over(w)
    out = assigned.withColumn("_wide", wide).withColumn("_part", part)
    limit = F.when(F.col("_part") >= 4096, F.raise_error(F.lit("a block has over 4095 overflows")).cast("int"))
    return out.withColumn("epoch", F.coalesce(limit, (F.col("epoch") * 4096 + F.col("_part")).cast("int"))).drop("_wide", "_part")


def unpack(blocks: DataFrame, variables: Sequence[str], t0: int | None = None, t1: int | None = None, damaged: str = "error") -> DataFrame:
    """Decode blocks to points(series_key, epoch, block_start, pos, ts, variables); rows outside [t0, t1] never leave the kernel.

    damaged: error, or keep for the points of a broken block that stand before the damage.
    """
    if damaged not in ("error", "keep"):
        raise ValueError("damaged must be error or keep")
    names = check_variables(variables)
    schema = points_schema(names)
    low, high = (-MAX_TS - 1 if t0 is None else t0), (MAX_TS if t1 is None else t1)

    def decode(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = part["n"].to_numpy()
        ts, values, good = unpack_blocks(part["payload"].to_pylist(), counts, len(names), damaged == "error")
        block = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(ts)) - (np.cumsum(counts) - counts)[block]
        keep = np.flatnonzero((pos < good[block]) & (ts >= low) & (ts <= high))
        for lo in range(0, len(keep), OUT_ROWS):
            at = keep[lo : lo + OUT_ROWS]
            columns = [part[c].take(pa.array(block[at])) for c in KEYS] + [pa.array(pos[at]), pa.array(ts[at])]
            columns += [pa.array(values[at, j]) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "pos", "ts", *names])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, lo = np.cumsum(batch["n"].to_numpy()), 0
            while lo < batch.num_rows:
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + DECODE_POINTS, "right")))
                yield from decode(batch.slice(lo, hi - lo))
                lo = hi

    return blocks.select(*KEYS, "n", "payload").mapInArrow(kernel, schema)


def prune(blocks: DataFrame, t0: int, t1: int, duration_ms: int = DEFAULT_DURATION_MS, compat: bool = False) -> DataFrame:
    """Blocks that can hold a point of [t0, t1]: by true bounds, or with compat by the nominal ones, which miss late points."""
    if compat:
        return blocks.filter((F.col("block_start") <= t1) & (F.col("block_start") + F.lit(duration_ms) >= t0))
    return blocks.filter((F.col("min_ts") <= t1) & (F.col("max_ts") >= t0))


def range_query(
    blocks: DataFrame, variables: Sequence[str], t0: int, t1: int, series_key: str | None = None, duration_ms: int = DEFAULT_DURATION_MS, compat_pruning: bool = False
) -> DataFrame:
    """Points with t0 <= ts <= t1, both ends included; the block filters are plain predicates that reach the Parquet scan."""
    chosen = blocks if series_key is None else blocks.filter(F.col("series_key") == series_key)
    return unpack(prune(chosen, t0, t1, duration_ms, compat_pruning), variables, t0, t1)


def query_all(blocks: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Every point from time zero on; negative timestamps are outside, as in a range query from 0."""
    return unpack(blocks.filter(F.col("max_ts") >= 0), variables, 0, MAX_TS)


def in_order(points: DataFrame) -> DataFrame:
    """Result order: by series, then block, then arrival."""
    return points.orderBy("series_key", "epoch", "block_start", "pos")
