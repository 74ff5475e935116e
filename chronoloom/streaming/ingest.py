"""Streaming ingest: the open block of each series lives in state, sealed blocks are emitted on roll-over.

No watermark drops late points: a point behind the open block joins it, as in
batch assignment. With idle_ms, a series that stays silent that long in
processing time is flushed, and its next point starts a new epoch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators.codec import pack_block
from chronoloom.schema import BLOCK_SCHEMA, DEFAULT_DURATION_MS, check_variables


def stream_blocks(
    points: DataFrame, variables: Sequence[str] = ("value",), duration_ms: int = DEFAULT_DURATION_MS, codec: str = "standard", idle_ms: int | None = None
) -> DataFrame:
    """Sealed blocks of a streaming points(series_key, seq, ts, variables) DataFrame; use append mode.

    Within a micro-batch points are taken in seq order; across batches, arrival is the batch order.
    """
    names = check_variables(variables)
    k = len(names)

    def seal(key: str, epoch: int, start: int, ts: np.ndarray, values: np.ndarray) -> dict:
        payload, bits = pack_block(ts, values, codec == "guarded")
        row = {"series_key": key, "epoch": epoch, "block_start": start, "n": len(ts), "min_ts": int(ts.min()), "max_ts": int(ts.max())}
        return row | {"codec": codec, "bit_len": bits, "size_bytes": len(payload), "payload": payload}

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key, out = group[0], []
        epoch, start, ts, values = state.get if state.exists else (0, None, b"", b"")
        times, rows = np.frombuffer(ts, np.int64), np.frombuffer(values, np.float64).reshape(-1, k)
        if state.hasTimedOut:
            if len(times):
                out.append(seal(key, epoch, start, times, rows))
            state.update((epoch + 1, None, b"", b""))
            yield pd.DataFrame(out, columns=BLOCK_SCHEMA.fieldNames())
            return
        new = pd.concat(list(frames)).sort_values("seq", kind="stable")
        t, v = new["ts"].to_numpy(np.int64), new[names].to_numpy(np.float64)
        floors = t // duration_ms * duration_ms
        starts = np.maximum.accumulate(floors if start is None else np.maximum(floors, start))
        for s in np.unique(starts):
            now = starts == s
            if start is not None and s != start and len(times):
                out.append(seal(key, epoch, start, times, rows))
                times, rows = times[:0], rows[:0]
            start = int(s)
            times, rows = np.concatenate([times, t[now]]), np.concatenate([rows, v[now]])
        state.update((epoch, start, times.tobytes(), rows.tobytes()))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=BLOCK_SCHEMA.fieldNames())

    kept = "epoch int, start bigint, ts binary, vals binary"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return points.select("series_key", "seq", "ts", *names).groupBy("series_key").applyInPandasWithState(step, BLOCK_SCHEMA, kept, "append", timeout)
