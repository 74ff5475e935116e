import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.operators.codec import BitSink, BitSource, pack_block, pack_blocks, twos_complement, unpack_block, unpack_blocks


def test_twos_complement():
    assert twos_complement(-10, 5) == 22 and twos_complement(5, 7) == 0b0000101 and twos_complement(-5, 7) == 0b1111011
    for bad in ((64, 7), (-65, 7), (1, 0)):
        with pytest.raises(ValueError):
            twos_complement(*bad)


def test_bit_stream():
    s = BitSink()
    s.bit(3)
    s.bits(0b11111, 3)
    s.bits(9, 0)
    s.signed(-10, 5)
    assert s.bit_length() == 9 and s.byte_length() == 2 and s.getvalue() == s.getvalue() == bytes([0b11111011, 0])
    s.raw(b"")
    assert s.bit_length() == 9
    at = s.reserve_u32()
    s.i64(-2)
    s.u64(7)
    s.patch_u32(at, 0xDEADBEEF)
    r = BitSource(s.getvalue())
    assert r.peek() == 1 and r.bit() == 1 and r.bits(3) == 7 and r.signed(5) == -10 and r.bits(0) == 0
    assert r.u32() == 0xDEADBEEF and r.i64() == -2 and r.u64() == 7 and r.bits_remaining == 0
    with pytest.raises(EOFError):
        r.bits(1)
    with pytest.raises(EOFError):
        r.raw(1)
    with pytest.raises(ValueError):
        s.patch_u32(1000, 1)
    with pytest.raises(ValueError):
        s.bits(-1, 3)


def test_dod_costs():
    edges = {0: 1, -64: 9, 63: 9, -65: 12, 64: 12, -256: 12, 255: 12, -257: 16, 256: 16, -2048: 16, 2047: 16, -2049: 36, 2048: 36, 2**31 - 1: 36, -(2**31): 36}
    for d, cost in edges.items():
        ts = np.array([0, 10, 20 + d])
        _, bits = pack_block(ts, np.zeros((3, 1)))
        assert bits == 64 + 64 + 64 + 1 + cost + 1
    for d in (2**31, -(2**31) - 1):
        with pytest.raises(ValueError):
            pack_block(np.array([0, 10, 20 + d]), np.zeros((3, 1)))


def images(bits):
    return np.array(bits, np.uint64).view(np.float64).reshape(-1, 1)


def test_xor_costs():
    ts = np.zeros(2, np.int64)
    cost = lambda *b: pack_block(np.zeros(len(b), np.int64), images(list(b)))[1] - pack_block(np.zeros(len(b), np.int64), images([0] * len(b)))[1] + len(b) - 1
    a, b = np.array([24.0, 25.0]).view(np.uint64)
    assert a ^ b == 0x0001000000000000
    assert pack_block(ts, np.array([[24.0], [25.0]]))[1] == 192 + 13 + 1
    assert cost(0, 1) == 13 + 33  # leading zeros are cut at 31
    assert cost(0, 1 << 63) == 13 + 1


def test_guard():
    window = lambda lead, trail: (1 << (64 - lead)) - (1 << trail)
    for first, second, std, guarded in (((10, 20), (15, 40), 36, 22), ((10, 9), (28, 28), 47, 21)):
        x, y = window(*first), window(*second)
        rows = images([0, x, x ^ y])
        base = pack_block(np.zeros(2, np.int64), rows[:2])[1] + 1
        assert pack_block(np.zeros(3, np.int64), rows)[1] - base == std
        assert pack_block(np.zeros(3, np.int64), rows, True)[1] - base == guarded
    for m, cost in ((23, 2 + 34), (22, 13 + 22)):  # 34 - m is 11 and 12
        x, y = window(10, 20), window(10, 64 - 10 - m)
        rows = images([0, x, x ^ y])
        assert pack_block(np.zeros(3, np.int64), rows, True)[1] - pack_block(np.zeros(2, np.int64), rows[:2])[1] - 1 == cost


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_round_trip(data):
    n, k = data.draw(st.integers(1, 40)), data.draw(st.integers(1, 4))
    steps = data.draw(st.lists(st.integers(-(2**29), 2**29), min_size=n, max_size=n))
    start = data.draw(st.integers(-(2**60), 2**60))
    ts = start + np.cumsum(steps)
    word = st.one_of(st.integers(0, 2**64 - 1), st.sampled_from([0, 1 << 63, 0x7FF8000000000001, 0x7FF0000000000000, 1, 0x3FF0000000000000]))
    bits = np.array(data.draw(st.lists(word, min_size=n * k, max_size=n * k)), np.uint64).reshape(n, k)
    starts = np.unique([0, *data.draw(st.lists(st.integers(0, n - 1), max_size=4))])
    for guarded in (False, True):
        blocks = pack_blocks(ts, bits.view(np.float64), starts, guarded)
        for (payload, size), a, z in zip(blocks, starts, [*starts[1:], n], strict=True):
            assert len(payload) == (size + 7) // 8
            assert pack_block(ts[a:z], bits[a:z].view(np.float64), guarded) == (payload, size)
            t, v = unpack_block(payload, z - a, k)
            assert (t == ts[a:z]).all() and (v.view(np.uint64) == bits[a:z]).all()


def test_long_block(monkeypatch):
    from chronoloom.operators import codec

    rng = np.random.default_rng(5)
    ts, v = np.cumsum(rng.integers(0, 5000, 3000)), rng.normal(size=(3000, 2))
    whole = pack_block(ts, v)
    monkeypatch.setattr(codec, "SLICE", 37)
    assert pack_block(ts, v) == whole


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_lockstep(data):
    """Array steps, single steps and a switch between them give the same points, damaged blocks included."""
    from chronoloom.operators import codec

    rng = np.random.default_rng(data.draw(st.integers(0, 2**32)))
    k, m = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 12))
    counts = rng.integers(1, 12, m)
    starts = np.cumsum(counts) - counts
    n = int(counts.sum())
    scale = data.draw(st.sampled_from([1, 100, 3000, 2**28]))
    ts = rng.integers(-(2**50), 2**50) + np.cumsum(rng.integers(-scale, scale + 1, n))
    values = rng.integers(0, 2**64, (n, k), dtype=np.uint64) & np.uint64(data.draw(st.sampled_from([2**64 - 1, 0xFFF0000000000000, 0xFF00, 1])))
    payloads = [p for p, _ in pack_blocks(ts, values.view(np.float64), starts, data.draw(st.booleans()))]
    broken = [p[: rng.integers(0, len(p) + 1)] if rng.random() < 0.3 else p for p in payloads]
    was, seen = codec.LOCKSTEP, []
    try:
        for codec.LOCKSTEP in (1, 5, 1000):
            t, v, good = unpack_blocks(payloads, counts, k)
            assert (t == ts).all() and (v.view(np.uint64) == values).all() and (good == counts).all()
            t, v, good = unpack_blocks(broken, counts, k, strict=False)
            for a, g in zip(starts, good, strict=True):
                assert (t[a : a + g] == ts[a : a + g]).all() and (v[a : a + g].view(np.uint64) == values[a : a + g]).all()
            seen.append(good.tolist())
    finally:
        codec.LOCKSTEP = was
    assert seen[0] == seen[1] == seen[2]
    noise = [bytes(rng.integers(0, 256, 40, dtype=np.uint8)) for _ in counts]
    unpack_blocks(noise, counts, k, strict=False)
