"""Exact compressed sizes without packing a bit.

bits = 64(1+k) + 64[n>=2] + sum of delta-of-delta costs + sum of XOR costs,
bytes = ceil(bits/8). The XOR window depends on its own past choices, so it is
folded with the aggregate() higher-order function over each block's sorted
values; a block is bounded by its duration.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.bits import GUARD_BITS, NEW_WINDOW_OVERHEAD, REUSE_OVERHEAD, ctz64, dod_cost, double_bits, leading
from chronoloom.operators.assign import block_order, with_deltas
from chronoloom.schema import KEYS, check_variables

CODECS = ("standard", "guarded")


def with_xor(assigned: DataFrame, variables: Sequence[str], prefixes: Sequence[str] = ("",)) -> DataFrame:
    """Add per variable the image (vb), the XOR with the previous value of the block (x) and its window (l, t, m).

    All images come from one Arrow pass and all lags from one window.
    """
    vb, x = ({p: F.col(f"{p}{c}") for p in prefixes} for c in ("vb", "x"))
    out = assigned.withColumns({f"{p}vb": double_bits(F.col(f"`{v}`")) for v, p in zip(variables, prefixes, strict=True)})
    out = out.withColumns({f"{p}x": vb[p].bitwiseXOR(F.lag(vb[p]).over(block_order())) for p in prefixes})
    out = out.withColumns({f"{p}{c}": F.when(x[p] != 0, f(x[p])) for p in prefixes for c, f in (("l", leading), ("t", ctz64))})
    return out.withColumns({f"{p}m": 64 - F.col(f"{p}l") - F.col(f"{p}t") for p in prefixes})


def xor_fold(windows: Column, codec: str) -> Column:
    """Fold an ordered array of struct(seq, l, t) into bits and class counts; null l means an equal value."""
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("bits"), F.lit(255).alias("lp"), F.lit(0).alias("tp"), zero.alias("same"), zero.alias("reuse"), zero.alias("fresh")
    )

    def step(a: Column, e: Column) -> Column:
        length = 64 - a.lp - a.tp
        own = 64 - e.l - e.t
        fits = (a.lp != 255) & (e.l >= a.lp) & (e.t >= a.tp)
        if codec == "guarded":
            fits = fits & ~((length - own) > GUARD_BITS)
        same = e.l.isNull()
        return F.struct(
            (a.bits + F.when(same, 1).when(fits, length + REUSE_OVERHEAD).otherwise(own + NEW_WINDOW_OVERHEAD)).cast("bigint").alias("bits"),
            F.when(same | fits, a.lp).otherwise(e.l).cast("int").alias("lp"),
            F.when(same | fits, a.tp).otherwise(e.t).cast("int").alias("tp"),
            (a.same + F.when(same, 1).otherwise(0)).cast("bigint").alias("same"),
            (a.reuse + F.when(~same & fits, 1).otherwise(0)).cast("bigint").alias("reuse"),
            (a.fresh + F.when(~same & ~fits, 1).otherwise(0)).cast("bigint").alias("fresh"),
        )

    return F.aggregate(windows, start, step)


def block_sizes(assigned: DataFrame, variables: Sequence[str] = ("value",), codecs: Sequence[str] = CODECS) -> DataFrame:
    """One row per block: n, min_ts, max_ts, and for every codec <codec>_bits and <codec>_bytes plus class counts.

    Both codecs are folded over the same sorted arrays, so a comparison costs one shuffle.
    """
    names = check_variables(variables)
    rows = with_deltas(with_xor(assigned, names, [f"_{j}_" for j in range(len(names))]))
    cost = F.when(F.col("rn") == 1, 64 * (1 + len(names))).when(F.col("rn") == 2, 64).otherwise(dod_cost(F.col("dod")))
    arrays = [
        F.array_sort(
            F.collect_list(F.when(F.col("rn") > 1, F.struct("seq", F.col(f"_{j}_l").alias("l"), F.col(f"_{j}_t").alias("t"))))
        ).alias(f"_w{j}")
        for j in range(len(names))
    ]
    grouped = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.sum(cost).alias("_fixed"), *arrays
    )
    folds = {f"_{c}_{j}": xor_fold(F.col(f"_w{j}"), c) for c in codecs for j in range(len(names))}
    out = grouped.withColumns(folds)
    final = {}
    for c in codecs:
        total = lambda field, c=c: reduce(lambda a, b: a + b, [F.col(f"_{c}_{j}.{field}") for j in range(len(names))])
        final |= {f"{c}_bits": F.col("_fixed") + total("bits")}
        final |= {f"{c}_{k}": total(k) for k in ("same", "reuse", "fresh")}
    out = out.withColumns(final)
    out = out.withColumns({f"{c}_bytes": F.expr(f"({c}_bits + 7) div 8") for c in codecs})
    return out.select(*KEYS, "n", "min_ts", "max_ts", *(f"{c}_{k}" for c in codecs for k in ("bits", "bytes", "same", "reuse", "fresh")))
