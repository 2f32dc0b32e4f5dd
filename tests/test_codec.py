import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelweave.operators.motion import REACH, search_brick
from voxelweave.sources import codec


def brick_of(places, seed=0):
    filled, colour = np.zeros(512, bool), np.zeros((512, 3), np.uint8)
    filled[list(places)] = True
    colour[filled] = np.random.default_rng(seed).integers(0, 256, (int(filled.sum()), 3))
    return filled, colour


def same(a, b):
    return a.keys() == b.keys() and all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in ((a[k], b[k]) for k in a))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_range_coder_round_trip(data):
    assert codec.range_decode(codec.range_encode(data)) == data


@pytest.mark.parametrize("data", [b"", b"\0" * 20000, bytes(range(256)) * 40, b"ab" * 5000 + b"\xff"])
def test_range_coder_cases(data):
    assert codec.range_decode(codec.range_encode(data)) == data


@pytest.mark.parametrize(("n", "size"), [(1, 1), (127, 1), (128, 2), (512, 5)])
def test_run_lengths(n, size):
    on = np.zeros(512, bool)
    on[:n] = True
    raw = codec.encode_runs(on)
    assert sum(b > 127 for b in raw) == size
    assert (codec.decode_runs(memoryview(raw), 0)[0] == on).all()


def test_colour_delta_wraps():
    filled, colour = brick_of([0, 1])
    colour[0], colour[1] = 250, 3
    assert codec.encode_intra((filled, colour))[-3:] == bytes([9, 9, 9])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sets(st.integers(0, 511), max_size=200), min_size=1, max_size=4), st.booleans(), st.integers(0, 3))
def test_frames_round_trip(places, motion, most):
    frames = [{(0, 0, 0): brick_of(p, i), (1, 0, 1): brick_of({(v * 7) % 512 for v in p}, i + 9)} for i, p in enumerate(places)]
    before = got_before = None
    for frame, block in zip(frames, codec.encode_frames(frames, (2, 1, 2), most, motion), strict=True):
        got = codec.decode_frame(block, got_before, (2, 1, 2), most)
        assert same(got, {k: b for k, b in frame.items() if b[0].any()})
        before, got_before = frame, got


def test_single_voxel_is_intra():
    one = {(0, 0, 0): brick_of([5])}
    raw = codec.encode_brick(one[0, 0, 0], one, (0, 0, 0), False)
    assert raw[0] == codec.INTRA


def test_static_pair_is_predicted_with_no_residual():
    frame = {(0, 0, 0): brick_of(range(100))}
    raw = codec.encode_brick(frame[0, 0, 0], frame, (0, 0, 0), True)
    assert raw[:4] == bytes([codec.PREDICTED, 0, 0, 0]) and not any(raw[-300:])


def test_group_sizes():
    assert codec.group_sizes(10, 4) == [4, 3, 3]
    assert codec.group_sizes(10, 0) == [10]
    assert codec.group_sizes(0, 4) == []


def plain_cost(now, before, d):
    total = 0
    for x in range(8):
        for y in range(8):
            for z in range(8):
                a, b = now[x, y, z], before[x + d[0] + REACH, y + d[1] + REACH, z + d[2] + REACH]
                total += 768 if bool(a[0]) != bool(b[0]) else int(abs(a[1:].astype(int) - b[1:]).sum()) if a[0] else 0
    return total


@pytest.mark.parametrize("seed", range(4))
def test_search_cost_and_reach(seed):
    rng = np.random.default_rng(seed)
    wide = np.zeros((22, 22, 22, 4), np.int16)
    wide[..., 0] = rng.random((22, 22, 22)) < 0.3
    wide[..., 1:] = rng.integers(0, 256, (22, 22, 22, 3)) * wide[..., :1]
    moved = [(1, 0, -1), (4, 4, 0), (-4, -4, -4), (0, 0, 0)][seed]
    x, y, z = (v + REACH for v in moved)
    now = wide[x : x + 8, y : y + 8, z : z + 8].copy()
    *vector, cost = search_brick(now, wide)
    assert tuple(vector) == moved and cost == 0 == plain_cost(now, wide, moved)
    noise = np.zeros_like(now)
    noise[..., 0] = rng.random((8, 8, 8)) < 0.3
    *vector, cost = search_brick(noise, wide)
    assert cost == plain_cost(noise, wide, vector) <= plain_cost(noise, wide, (0, 0, 0))


def test_ties_keep_the_centre_then_z_y_x():
    empty, full = np.zeros((8, 8, 8, 4), np.int16), np.zeros((22, 22, 22, 4), np.int16)
    assert search_brick(empty, full) == (0, 0, 0, 0)
    now = empty.copy()
    now[4, 4, 4, 0] = 1
    wide = full.copy()
    wide[4 + REACH - 1, 4 + REACH, 4 + REACH, 0] = wide[4 + REACH, 4 + REACH - 1, 4 + REACH, 0] = 1
    # both neighbours cost one mismatch; y -1 comes before x -1 in (z, y, x) order
    assert search_brick(now, wide)[:3] == (0, -1, 0)


@pytest.mark.parametrize("cut", [3, 20, 300, 1040])
def test_damage_is_noticed(cut):
    block = codec.encode_frame({(0, 0, 0): brick_of(range(0, 512, 3))}, None, (1, 1, 1), 0, False)
    with pytest.raises((codec.Damaged, struct.error)):
        codec.decode_frame(block[:cut], None, (1, 1, 1), 0)


def test_wrong_counts_are_noticed():
    block = bytearray(codec.encode_frame({(0, 0, 0): brick_of(range(50))}, None, (1, 1, 1), 0, False))
    for at in (0, 4, 12 + 4 + 8):
        bad = bytearray(block)
        bad[at] ^= 3
        with pytest.raises(codec.Damaged):
            codec.decode_frame(bytes(bad), None, (1, 1, 1), 0)


def old_bits(changes):
    bits = []
    for add, x, y, z in changes:
        bits += [add, *(v >> i & 1 for v in (x, y, z) for i in range(3))]
    return np.packbits(bits).tobytes()


def test_older_format():
    filled, colour = brick_of([0, 9, 100])
    middle = np.array([7, 8, 9], np.uint8)
    intra = b"\0" + codec.encode_runs(filled) + middle.tobytes() + (colour[filled] - middle).astype(np.uint8).tobytes()
    got, at = codec.decode_brick_old(memoryview(intra), 0, None, (0, 0, 0))
    assert at == len(intra) and (got[0] == filled).all() and (got[1] == colour).all()
    before = {(0, 0, 0): got}
    after = filled.copy()
    after[0], after[3 + 8 * 2 + 64] = False, True
    new = np.where(after[:, None], np.uint8(55), np.uint8(0)) * np.ones((512, 3), np.uint8)
    base = colour.copy()
    base[3 + 16 + 64] = 0
    pred = b"\1" + struct.pack("<I", 2) + old_bits([(0, 0, 0, 0), (1, 3, 2, 1)]) + (new[after] - base[after]).astype(np.uint8).tobytes()
    got, at = codec.decode_brick_old(memoryview(pred), 0, before, (0, 0, 0))
    assert at == len(pred) and (got[0] == after).all() and (got[1][after] == new[after]).all()
    with pytest.raises(codec.Damaged):
        codec.decode_brick_old(memoryview(pred), 0, {}, (0, 0, 0))
