"""Bit-level column expressions: IEEE images, zero counts, code buckets and costs.

Everything here stays in Catalyst except the two reinterpret casts, for which
Spark has no expression; those are Arrow-batched views without copying.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: upper bound (exclusive) of |range|, bucket name, total cost in bits.
DOD_BUCKETS = ((1 << 6, "w7", 9), (1 << 8, "w9", 12), (1 << 11, "w12", 16))
DOD_ZERO_BITS, DOD_WIDE_BITS = 1, 36
MAX_LEADING = 31
NEW_WINDOW_OVERHEAD, REUSE_OVERHEAD, GUARD_BITS = 13, 2, 11


@F.pandas_udf(T.LongType())
def double_bits(values: pd.Series) -> pd.Series:
    """The IEEE-754 image of a double as a signed 64-bit integer, NaN payloads and -0.0 kept."""
    return pd.Series(values.to_numpy(dtype="float64").view("int64"))


@F.pandas_udf(T.DoubleType())
def bits_double(images: pd.Series) -> pd.Series:
    """Inverse of double_bits."""
    return pd.Series(images.to_numpy(dtype="int64").view("float64"))


def twos_complement(x: Column, n: int) -> Column:
    """The low n bits of x as an unsigned number; raises when x doesn't fit n signed bits."""
    if n <= 0 or n > 64:
        raise ValueError("the width must be 1 to 64")
    if n == 64:
        return x.cast("bigint")
    low, high = -(1 << (n - 1)), (1 << (n - 1)) - 1
    return F.when(~x.between(low, high), F.raise_error(F.lit(f"value doesn't fit {n} signed bits")).cast("bigint")).otherwise(
        x.cast("bigint").bitwiseAND(F.lit((1 << n) - 1))
    )


def from_twos_complement(u: Column, n: int) -> Column:
    """Sign-extend the n-bit unsigned number u."""
    if n <= 0 or n > 63:
        return u.cast("bigint")
    return F.when(u >= F.lit(1 << (n - 1)), u - F.lit(1 << n)).otherwise(u).cast("bigint")


def bit_string(u: Column, n: int) -> Column:
    """The low n bits, most significant first, as text; empty for n = 0."""
    if n < 0:
        raise ValueError("the width must not be negative")
    return F.right(F.lpad(F.bin(u), 64, "0"), F.lit(n)) if n else F.lit("")


def align_bits(bits: Column) -> Column:
    """Zero-pad a bit string to whole bytes."""
    n = F.length(bits)
    return F.rpad(bits, (n + F.pmod(-n, F.lit(8))).cast("int"), F.lit("0"))


def byte_length(bits: Column) -> Column:
    return F.expr("cast(0 as bigint)") + F.floor((bits + F.lit(7)) / F.lit(8)).cast("bigint")


def clz64(x: Column) -> Column:
    """Leading zeros of a non-zero 64-bit image."""
    return F.lit(64) - F.length(F.bin(x))


def ctz64(x: Column) -> Column:
    """Trailing zeros of a non-zero image; the text form is safe for Long.MIN, where -x overflows."""
    b = F.bin(x)
    return F.length(b) - F.length(F.rtrim(b, F.lit("0")))


def leading(x: Column) -> Column:
    """Leading zeros as the 5-bit window header can carry them."""
    return F.least(F.lit(MAX_LEADING), clz64(x))


def dod_bucket(d: Column) -> Column:
    """zero, w7, w9, w12 or w32 by two's-complement range."""
    out = F.when(d == 0, F.lit("zero"))
    for half, name, _ in DOD_BUCKETS:
        out = out.when(d.between(-half, half - 1), F.lit(name))
    return out.otherwise(F.lit("w32"))


def dod_cost(d: Column) -> Column:
    """Bits of the delta-of-delta code; raises beyond 32 signed bits."""
    out = F.when(d == 0, F.lit(DOD_ZERO_BITS))
    for half, _, cost in DOD_BUCKETS:
        out = out.when(d.between(-half, half - 1), F.lit(cost))
    limit = 1 << 31
    return out.when(d.between(-limit, limit - 1), F.lit(DOD_WIDE_BITS)).otherwise(
        F.raise_error(F.lit("delta-of-delta doesn't fit 32 signed bits")).cast("int")
    )


def format_bytes(n: Column) -> Column:
    """1024-step units from B to TB with two decimals."""
    size = n.cast("double")
    out = F.when(size < 1024, F.format_string("%.2f B", size))
    for k, unit in enumerate(("KB", "MB", "GB"), start=1):
        out = out.when(size < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", size / 1024.0**k))
    return out.otherwise(F.format_string("%.2f TB", size / 1024.0**4))
