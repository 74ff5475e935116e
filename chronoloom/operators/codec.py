"""Pure numpy block codec: a block of points to packed bits and back.

Encoding computes every code as a (bits, width) pair with array operations and
expands them in one go; only the choice of XOR windows is a loop. Decoding is
bit-serial within a block, so many blocks are decoded in lockstep, one array
step per point index; the few longest of a batch are finished one by one.
"""

from __future__ import annotations

import struct

import numpy as np

from chronoloom.functions.bits import GUARD_BITS, MAX_LEADING

#: Fixed values of the format: prefix, prefix width, payload width for each signed range.
PREFIXES = ((0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12), (0b1111, 4, 32))
U64 = np.uint64


class BitSink:
    """Append-only bit stream, most significant bit first."""

    def __init__(self) -> None:
        self._acc, self._bits = 0, 0

    def bit_length(self) -> int:
        return self._bits

    def byte_length(self) -> int:
        return (self._bits + 7) // 8

    def bit(self, b: int) -> None:
        self._acc, self._bits = self._acc << 1 | (b & 1), self._bits + 1

    def bits(self, x: int, n: int) -> None:
        """The low n bits of x; higher ones are dropped."""
        if n < 0 or x < 0:
            raise ValueError("value and width must not be negative")
        self._acc, self._bits = self._acc << n | (x & ((1 << n) - 1)), self._bits + n

    def signed(self, x: int, n: int) -> None:
        self.bits(twos_complement(x, n), n)

    def align(self) -> None:
        pad = -self._bits % 8
        self._acc, self._bits = self._acc << pad, self._bits + pad

    def raw(self, data: bytes) -> None:
        """Whole bytes from the next byte boundary on; nothing at all for no bytes."""
        if data:
            self.align()
            self._acc, self._bits = self._acc << 8 * len(data) | int.from_bytes(data, "big"), self._bits + 8 * len(data)

    def u32(self, x: int) -> None:
        self.raw((x & 0xFFFFFFFF).to_bytes(4, "big"))

    def u64(self, x: int) -> None:
        self.raw((x & (1 << 64) - 1).to_bytes(8, "big"))

    def i64(self, x: int) -> None:
        self.raw(struct.pack(">q", x))

    def reserve_u32(self) -> int:
        """Four zero bytes at a byte boundary; returns their byte offset for patch_u32."""
        self.align()
        at = self._bits // 8
        self.u32(0)
        return at

    def patch_u32(self, at: int, x: int) -> None:
        if at < 0 or 8 * (at + 4) > self._bits:
            raise ValueError("the patch lies outside the stream")
        shift = self._bits - 8 * (at + 4)
        self._acc = self._acc & ~(0xFFFFFFFF << shift) | (x & 0xFFFFFFFF) << shift

    def getvalue(self) -> bytes:
        """A snapshot padded to whole bytes; the stream itself stays as it is."""
        pad = -self._bits % 8
        return (self._acc << pad).to_bytes((self._bits + pad) // 8, "big")


class BitSource:
    """Reader over a byte buffer, most significant bit first."""

    def __init__(self, data: bytes) -> None:
        self._data, self.pos, self._end = bytes(data), 0, 8 * len(data)

    @property
    def bits_remaining(self) -> int:
        return self._end - self.pos

    def bits(self, n: int) -> int:
        if n < 0:
            raise ValueError("the width must not be negative")
        if n == 0:
            return 0
        p, q = self.pos, self.pos + n
        if q > self._end:
            raise EOFError("the bit stream has ended")
        a, b = p >> 3, (q + 7) >> 3
        self.pos = q
        return (int.from_bytes(self._data[a:b], "big") >> (8 * b - q)) & ((1 << n) - 1)

    def bit(self) -> int:
        return self.bits(1)

    def peek(self) -> int:
        x = self.bits(1)
        self.pos -= 1
        return x

    def signed(self, n: int) -> int:
        x = self.bits(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def align(self) -> None:
        self.pos += -self.pos % 8

    def raw(self, n: int) -> bytes:
        self.align()
        if self.pos + 8 * n > self._end:
            raise EOFError("the byte stream has ended")
        at = self.pos // 8
        self.pos += 8 * n
        return self._data[at : at + n]

    def _unpack(self, form: str, n: int) -> int:
        self.align()
        at = self.pos // 8
        out = struct.unpack(form, self._data[at : at + n])[0]
        self.pos += 8 * n
        return out

    def u32(self) -> int:
        return self._unpack(">I", 4)

    def u64(self) -> int:
        return self._unpack(">Q", 8)

    def i64(self) -> int:
        return self._unpack(">q", 8)


def twos_complement(x: int, n: int) -> int:
    if n <= 0:
        raise ValueError("the width must be positive")
    if not -(1 << (n - 1)) <= x < 1 << (n - 1):
        raise ValueError(f"{x} doesn't fit {n} signed bits")
    return x & ((1 << n) - 1)


def zero_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading and trailing zeros of non-zero uint64 values, by halving."""
    lead, trail = np.zeros(x.shape, np.int64), np.zeros(x.shape, np.int64)
    hi, lo = x.copy(), x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        none = hi >> U64(64 - s) == 0
        lead += np.where(none, s, 0)
        hi = np.where(none, hi << U64(s), hi)
        none = lo & U64((1 << s) - 1) == 0
        trail += np.where(none, s, 0)
        lo = np.where(none, lo >> U64(s), lo)
    return lead, trail


def _codes(ts: np.ndarray, images: np.ndarray, starts: np.ndarray, guarded: bool) -> tuple[np.ndarray, np.ndarray]:
    """(code, width) of shape (n, 1 + k, 2): head and payload of every timestamp and value code."""
    n, k = images.shape
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    rank = np.arange(n) - starts[block]
    code, width = np.zeros((n, 1 + k, 2), U64), np.zeros((n, 1 + k, 2), np.int64)
    delta = np.diff(ts, prepend=ts[:1])
    dod = np.diff(delta, prepend=delta[:1])
    raw = np.where(rank == 0, ts, delta)
    whole = rank < 2
    code[whole, 0, 1], width[whole, 0, 1] = raw[whole].view(U64), 64
    at = np.flatnonzero(~whole)
    d = dod[at]
    if d.size and (d.min() < -(1 << 31) or d.max() >= 1 << 31):
        raise ValueError("delta-of-delta doesn't fit 32 signed bits")
    width[at, 0, 0] = 1
    left = d != 0
    for prefix, size, payload in PREFIXES:
        now = left & (d >= -(1 << (payload - 1))) & (d < 1 << (payload - 1))
        rows = at[now]
        code[rows, 0, 0], width[rows, 0, 0], width[rows, 0, 1] = prefix, size, payload
        code[rows, 0, 1] = (d[now] & ((1 << payload) - 1)).astype(U64)
        left &= ~now
    first = rank == 0
    for j in range(k):
        x = images[:, j].copy()
        x[1:] ^= images[:-1, j]
        code[first, 1 + j, 1], width[first, 1 + j, 1] = images[first, j], 64
        width[~first, 1 + j, 0] = 1
        x[first] = 0
        rows = np.flatnonzero(x)
        if not rows.size:
            continue
        lead, trail = zero_counts(x[rows])
        lead = np.minimum(lead, MAX_LEADING)
        head, size, span, shift = [], [], [], []
        lp, tp, open_block = 255, 0, -1
        for g, a, b in zip(block[rows].tolist(), lead.tolist(), trail.tolist(), strict=True):
            if g != open_block:
                lp, tp, open_block = 255, 0, g
            own, last = 64 - a - b, 64 - lp - tp
            if lp != 255 and a >= lp and b >= tp and not (guarded and last - own > GUARD_BITS):
                head.append(0b10), size.append(2), span.append(last), shift.append(tp)
            else:
                head.append(0b11 << 11 | a << 6 | (own - 1)), size.append(13), span.append(own), shift.append(b)
                lp, tp = a, b
        code[rows, 1 + j, 0], width[rows, 1 + j, 0] = np.array(head, U64), size
        code[rows, 1 + j, 1], width[rows, 1 + j, 1] = x[rows] >> np.array(shift, U64), span
    return code, width


def _bits(code: np.ndarray, width: np.ndarray) -> np.ndarray:
    """One byte per bit, most significant first."""
    stop = np.cumsum(width)
    owner = np.repeat(np.arange(len(width)), width)
    place = stop[owner] - 1 - np.arange(len(owner))
    return ((code[owner] >> place.astype(U64)) & U64(1)).astype(np.uint8)


def _stream(code: np.ndarray, width: np.ndarray) -> bytes:
    """Packed bytes of one long block, a slice of codes at a time."""
    out, rest = [], np.zeros(0, np.uint8)
    for lo in range(0, len(code), SLICE):
        bits = np.concatenate([rest, _bits(code[lo : lo + SLICE], width[lo : lo + SLICE])])
        full = len(bits) // 8 * 8
        out.append(np.packbits(bits[:full]).tobytes())
        rest = bits[full:]
    return b"".join([*out, np.packbits(rest).tobytes()])


SLICE = 1 << 18


def pack_blocks(ts: np.ndarray, values: np.ndarray, starts: np.ndarray, guarded: bool = False) -> list[tuple[bytes, int]]:
    """(payload, bit length) of consecutive blocks of points; starts holds each block's first row, values has shape (n, k).

    Everything but the choice of XOR windows is computed for all blocks at once.
    """
    ts, images = np.ascontiguousarray(ts, np.int64), np.ascontiguousarray(values, np.float64).view(U64)
    starts = np.asarray(starts, np.int64)
    code, width = _codes(ts, images, starts, guarded)
    per_row = code.shape[1] * 2
    flat_code, flat_width = code.ravel(), width.ravel()
    sizes = np.add.reduceat(width.reshape(len(ts), -1).sum(axis=1), starts)
    edges = np.append(starts, len(ts)) * per_row
    out, lo = [], 0
    while lo < len(starts):
        hi = lo + 1
        while hi < len(starts) and edges[hi + 1] - edges[lo] <= SLICE:
            hi += 1
        a, z = edges[lo], edges[hi]
        if hi == lo + 1 and z - a > SLICE:
            out.append((_stream(flat_code[a:z], flat_width[a:z]), int(sizes[lo])))
        else:
            bits, at = _bits(flat_code[a:z], flat_width[a:z]), 0
            for size in sizes[lo:hi].tolist():
                out.append((np.packbits(bits[at : at + size]).tobytes(), size))
                at += size
        lo = hi
    return out


def pack_block(ts: np.ndarray, values: np.ndarray, guarded: bool = False) -> tuple[bytes, int]:
    """Payload and exact bit length of one block of n >= 1 points with k variables."""
    return pack_blocks(ts, values, np.zeros(1, np.int64), guarded)[0]


#: Code lengths of a delta-of-delta by the next four bits of the stream.
HEADS = np.array([1] * 8 + [2] * 4 + [3] * 2 + [4] * 2, np.int64)
PAYLOADS = np.array([0] * 8 + [7] * 4 + [9] * 2 + [12, 32], np.int64)
#: Fewer open blocks than this are decoded one by one.
LOCKSTEP = 24


class _Words:
    """Reads 64 bits from any bit position of a byte buffer, for many positions at once."""

    def __init__(self, payloads: list[bytes], slack: int):
        sizes = np.array([len(p) for p in payloads], np.int64)
        self.stop = 8 * np.cumsum(sizes)
        self.start = self.stop - 8 * sizes
        raw = np.frombuffer(b"".join([*payloads, bytes(slack)]), np.uint8).astype(U64)
        self.after, n = raw, len(raw) - 8
        self.word = np.zeros(n, U64)
        for k in range(8):
            self.word = self.word << U64(8) | raw[k : k + n]

    def at(self, pos: np.ndarray) -> np.ndarray:
        byte, bit = pos >> 3, (pos & 7).astype(U64)
        return self.word[byte] << bit | self.after[byte + 8] >> (U64(8) - bit)


def unpack_blocks(payloads: list[bytes], counts: np.ndarray, k: int, strict: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Timestamps (N,), values (N, k) of all blocks back to back, and how many points of each block were read.

    A damaged block raises when strict; else its points before the damage
    count, and its other rows are left at zero.
    """
    counts = np.asarray(counts, np.int64)
    base = np.cumsum(counts) - counts
    total, m = int(counts.sum()), len(counts)
    ts, images, good = np.zeros(total, np.int64), np.zeros((total, k), U64), counts.copy()
    words = _Words(payloads, 24 + 10 * k)
    pos, t, delta = words.start.copy(), np.zeros(m, np.int64), np.zeros(m, np.int64)
    last, lead, trail = np.zeros((k, m), U64), np.zeros((k, m), np.int64), np.zeros((k, m), np.int64)
    act, i = np.flatnonzero(counts > 0), 0
    while len(act) >= LOCKSTEP:
        p = pos[act]
        broken = np.zeros(len(act), bool)
        x = words.at(p)
        if i == 0:
            t[act], p = x.view(np.int64), p + 64
        elif i == 1:
            delta[act], p = x.view(np.int64), p + 64
            t[act] += delta[act]
        else:
            kind = (x >> U64(60)).astype(np.int64)
            head, size = HEADS[kind], PAYLOADS[kind]
            d = (x << head.astype(U64)).view(np.int64) >> np.minimum(64 - size, 63)
            delta[act] += np.where(size > 0, d, 0)
            t[act] += delta[act]
            p = p + head + size
        for j in range(k):
            x = words.at(np.minimum(p, words.stop[-1]))
            if i == 0:
                last[j, act], p = x, p + 64
                continue
            kind = (x >> U64(62)).astype(np.int64)
            fresh = kind == 3
            rows = act[fresh]
            lead[j, rows] = (x[fresh] >> U64(57) & U64(31)).astype(np.int64)
            trail[j, rows] = 63 - lead[j, rows] - (x[fresh] >> U64(51) & U64(63)).astype(np.int64)
            p = p + np.where(kind < 2, 1, np.where(fresh, 13, 2))
            coded = np.flatnonzero(kind > 1)
            rows = act[coded]
            low = trail[j, rows]
            broken[coded[low < 0]] = True
            low = np.maximum(low, 0)
            own = 64 - lead[j, rows] - low
            bits = words.at(np.minimum(p[coded], words.stop[-1])) >> (64 - own).astype(U64)
            last[j, rows] ^= bits << low.astype(U64)
            p[coded] += own
        broken |= p > words.stop[act]
        if broken.any():
            if strict:
                raise ValueError("a block's bit stream is damaged or has ended early")
            good[act[broken]] = i
            act, p = act[~broken], p[~broken]
        pos[act] = p
        ts[base[act] + i], images[base[act] + i] = t[act], last[:, act].T
        i += 1
        act = act[counts[act] > i]
    for b in act.tolist():
        window = list(zip(lead[:, b].tolist(), trail[:, b].tolist(), strict=True))
        state = (int(pos[b] - words.start[b]), int(t[b]), int(delta[b]), last[:, b].tolist(), window)
        a, z = base[b], base[b] + counts[b]
        good[b] = _finish_block(payloads[b], i, state, ts[a:z], images[a:z], strict)
    return ts, images.view(np.float64), good


def _finish_block(data: bytes, first: int, state: tuple, ts: np.ndarray, images: np.ndarray, strict: bool) -> int:
    """Decode one block from point first on into ts and images; returns how many points hold."""
    src = BitSource(data)
    src.pos, t, delta, last, window = state
    bits, (n, k) = src.bits, images.shape
    for i in range(first, n):
        try:
            if i == 0:
                t = src.signed(64)
            elif i == 1:
                delta = src.signed(64)
                t += delta
            else:
                if bits(1):
                    size = 7 if not bits(1) else 9 if not bits(1) else 12 if not bits(1) else 32
                    delta += src.signed(size)
                t += delta
            for j in range(k):
                if i == 0:
                    last[j] = bits(64)
                elif bits(1):
                    if bits(1):
                        lead, own = bits(5), bits(6) + 1
                        window[j] = lead, 64 - lead - own
                    lead, trail = window[j]
                    if trail < 0:
                        raise ValueError("invalid window width in the stream")
                    last[j] ^= bits(64 - lead - trail) << trail
            ts[i], images[i] = t, last
        except (EOFError, ValueError, OverflowError):
            if strict:
                raise
            return i
    return n


def unpack_block(data: bytes, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n points: timestamps (n,) and values (n, k)."""
    ts, values, _ = unpack_blocks([data], np.array([n]), k)
    return ts, values
