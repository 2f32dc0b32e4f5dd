"""Bytes of encoded frames: occupancy runs, colour differences, range-coded brick groups.

A frame is a dict from brick (x, y, z) to a pair of arrays in order of place: filled, bool (512,), and colour, uint8 (512, 3).
Only this module and the container know bytes; the relational operators say the same in columns.
"""

from __future__ import annotations

import bisect
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np

from ..functions.address import CELLS, SIDE
from ..operators.motion import REACH, search_brick

Brick = tuple[np.ndarray, np.ndarray]
Frame = dict[tuple[int, int, int], Brick]
INTRA, PREDICTED = 0, 1
END = 256
# The range coder's widths in bits.
STATE, PROBABILITY, DIGIT = 40, 24, 8
FULL, LEAST, REST = (1 << STATE) - 1, (1 << PROBABILITY) - 1, (1 << STATE - DIGIT) - 1


class Damaged(ValueError):
    """Bytes that no encoder wrote."""


# --- range coding ---------------------------------------------------------------------------------------------------


def range_encode(data: bytes) -> bytes:
    """The frequency table of 257 symbols, the code's length, and the code."""
    if len(data) > LEAST:
        raise ValueError("too long for one blob")
    freq = np.bincount(np.frombuffer(data, np.uint8), minlength=END + 1)
    freq[END] = 1
    below = [0, *np.cumsum(freq).tolist()]
    total, low, span, out = below[-1], 0, FULL, bytearray()
    for s in itertools.chain(data, (END,)):
        low, span = low + below[s] * span // total, span * (below[s + 1] - below[s]) // total
        while span < LEAST:
            out.append(low >> STATE - DIGIT & 255)
            fits = (low & REST) + span <= REST
            low = low << DIGIT & FULL
            span = span << DIGIT & FULL if fits else FULL - low
    while (low & REST) + span <= REST:
        out.append(low >> STATE - DIGIT & 255)
        low, span = low << DIGIT & FULL, span << DIGIT & FULL
    code = low + span // 2
    while code:
        out.append(code >> STATE - DIGIT & 255)
        code = code << DIGIT & FULL
    return freq.astype("<u4").tobytes() + struct.pack("<Q", len(out)) + bytes(out)


def range_decode(blob: bytes) -> bytes:
    head = 4 * (END + 1)
    if len(blob) < head + 8:
        raise Damaged("a blob is shorter than its tables")
    below = [0, *np.cumsum(np.frombuffer(blob[:head], "<u4").astype(np.int64)).tolist()]
    (size,), total = struct.unpack_from("<Q", blob, head), below[-1]
    if not 0 < total <= LEAST or len(blob) < head + 8 + size:
        raise Damaged("a blob is cut short or its table is impossible")
    digits = itertools.chain(blob[head + 8 : head + 8 + size], itertools.repeat(0))
    code, low, span, out = int.from_bytes(itertools.islice(digits, STATE // DIGIT), "big"), 0, FULL, bytearray()
    while True:
        value = ((code - low + 1) * total - 1) // span
        if not 0 <= value < total:
            raise Damaged("a code leaves its range")
        s = bisect.bisect_right(below, value) - 1
        if s == END:
            return bytes(out)
        out.append(s)
        if len(out) > total:
            raise Damaged("a blob has no end")
        low, span = low + below[s] * span // total, span * (below[s + 1] - below[s]) // total
        while span < LEAST:
            fits = (low & REST) + span <= REST
            low = low << DIGIT & FULL
            span = span << DIGIT & FULL if fits else FULL - low
            code = (code << DIGIT | next(digits)) & FULL


# --- bricks ---------------------------------------------------------------------------------------------------------


def encode_runs(on: np.ndarray) -> bytes:
    """Runs of equal places; a byte has the state on top and a length of 127 at most below."""
    edges = np.flatnonzero(np.diff(on)) + 1
    out = bytearray()
    for a, b in itertools.pairwise([0, *edges.tolist(), len(on)]):
        flag, n = 128 * int(on[a]), b - a
        out += bytes([flag | 127]) * (n // 127) + (bytes([flag | n % 127]) if n % 127 else b"")
    return bytes(out)


def decode_runs(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    on, i = np.zeros(CELLS, bool), 0
    while i < CELLS:
        if at >= len(data):
            raise Damaged("runs are cut short")
        n = data[at] & 127
        on[i : i + n] = data[at] > 127
        i += n
        at += 1
    if i != CELLS:
        raise Damaged("runs don't end with the brick")
    return on, at


def colours(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    if at + 3 * n > len(data):
        raise Damaged("colours are cut short")
    return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3), at + 3 * n


def as_grid(brick: Brick | None) -> np.ndarray:
    """(8, 8, 8, 4) by x, y, z."""
    grid = np.zeros((SIDE, SIDE, SIDE, 4), np.int16)
    if brick is not None:
        grid[..., 0] = brick[0].reshape(SIDE, SIDE, SIDE).T
        grid[..., 1:] = brick[1].reshape(SIDE, SIDE, SIDE, 3).transpose(2, 1, 0, 3)
    return grid


def surroundings(frame: Frame, at: tuple[int, int, int]) -> np.ndarray:
    """A brick of a frame with REACH cells around it."""
    grid = np.zeros((3 * SIDE,) * 3 + (4,), np.int16)
    for d in itertools.product(range(3), repeat=3):
        brick = frame.get(tuple(a + k - 1 for a, k in zip(at, d, strict=True)))
        if brick is not None:
            x, y, z = (SIDE * k for k in d)
            grid[x : x + SIDE, y : y + SIDE, z : z + SIDE] = as_grid(brick)
    inside = slice(SIDE - REACH, 2 * SIDE + REACH)
    return grid[inside, inside, inside]


def shifted(around: np.ndarray, vector: tuple[int, int, int]) -> Brick:
    x, y, z = (v + REACH for v in vector)
    there = around[x : x + SIDE, y : y + SIDE, z : z + SIDE]
    filled = there[..., 0].T.reshape(-1) > 0
    return filled, there[..., 1:].transpose(2, 1, 0, 3).reshape(-1, 3).astype(np.uint8) * filled[:, None]


def encode_intra(brick: Brick) -> bytes:
    own = brick[1][brick[0]]
    return bytes([INTRA]) + encode_runs(brick[0]) + np.diff(own, axis=0, prepend=np.zeros((1, 3), np.uint8)).astype(np.uint8).tobytes()


def encode_brick(brick: Brick, before: Frame | None, at: tuple[int, int, int], motion: bool) -> bytes:
    """A brick, from the frame before if that is given and at least half of the voxels stay."""
    if before is None:
        return encode_intra(brick)
    around = surroundings(before, at)
    vector = search_brick(as_grid(brick), around)[:3] if motion else (0, 0, 0)
    was, old = shifted(around, vector)
    changed = brick[0] ^ was
    if changed.sum() >= brick[0].sum() // 2:
        return encode_intra(brick)
    return bytes([PREDICTED]) + struct.pack("3b", *vector) + encode_runs(changed) + (brick[1] - old)[brick[0]].tobytes()


def decode_brick(data: memoryview, at: int, before: Frame | None, place: tuple[int, int, int]) -> tuple[Brick, int]:
    if at >= len(data):
        raise Damaged("a group has too few bricks")
    kind, at = data[at], at + 1
    if kind == INTRA:
        filled, at = decode_runs(data, at)
        own, at = colours(data, at, int(filled.sum()))
        own = np.cumsum(own, axis=0, dtype=np.uint64).astype(np.uint8)
    elif kind == PREDICTED:
        if before is None:
            raise Damaged("a predicted brick without a frame before it")
        vector = struct.unpack_from("3b", data, at)
        if max(map(abs, vector)) > REACH:
            raise Damaged("a vector is out of reach")
        changed, at = decode_runs(data, at + 3)
        was, old = shifted(surroundings(before, place), vector)
        filled = changed ^ was
        own, at = colours(data, at, int(filled.sum()))
        own = own + old[filled]
    else:
        raise Damaged("a brick of no known kind")
    colour = np.zeros((CELLS, 3), np.uint8)
    colour[filled] = own
    return (filled, colour), at


def decode_brick_old(data: memoryview, at: int, before: Frame | None, place: tuple[int, int, int]) -> tuple[Brick, int]:
    """A brick of the older format: colours from a median; changes as a list of 10-bit cells."""
    kind, at = data[at], at + 1
    if kind == INTRA:
        filled, at = decode_runs(data, at)
        middle, at = colours(data, at, 1)
        own, at = colours(data, at, int(filled.sum()))
        base = np.repeat(middle, CELLS, axis=0)
    elif kind == PREDICTED:
        if before is None or place not in before:
            raise Damaged("a predicted brick that wasn't there before")
        (n,) = struct.unpack_from("<I", data, at)
        size = (10 * n + 7) // 8
        bits = np.unpackbits(np.frombuffer(data[at + 4 : at + 4 + size], np.uint8))[: 10 * n]
        if n > CELLS or len(bits) < 10 * n:
            raise Damaged("changes are cut short")
        at += 4 + size
        filled, base = (x.copy() for x in before[place])
        for row in bits.reshape(n, 10):
            x, y, z = (int(row[1 + 3 * k : 4 + 3 * k] @ (1, 2, 4)) for k in range(3))
            i = x + SIDE * y + SIDE * SIDE * z
            filled[i] = row[0]
            base[i] = 0 if row[0] else base[i]
        own, at = colours(data, at, int(filled.sum()))
    else:
        raise Damaged("a brick of no known kind")
    colour = np.zeros((CELLS, 3), np.uint8)
    colour[filled] = own + base[filled]
    return (filled, colour), at


# --- frames ---------------------------------------------------------------------------------------------------------


def group_sizes(n: int, most: int) -> list[int]:
    """Balanced groups of at most `most` bricks (0: one group); the first take the remainder."""
    if not n:
        return []
    groups = -(-n // most) if most else 1
    return [n // groups + (k < n % groups) for k in range(groups)]


def map_place(at: tuple[int, int, int], dims: tuple[int, int, int]) -> int:
    return at[0] + dims[0] * (at[1] + dims[1] * at[2])


def encode_frame(frame: Frame, before: Frame | None, dims: tuple[int, int, int], most: int, motion: bool) -> bytes:
    """A frame block. dims are in bricks; `before` is None for an I-frame."""
    places = sorted(p for p, b in frame.items() if b[0].any())
    bitmap = np.zeros(-(-dims[0] * dims[1] * dims[2] // 32) * 32, np.uint8)
    bitmap[[map_place(p, dims) for p in places]] = 1
    directory, blobs, offset, at = b"", [], 0, 0
    for n in group_sizes(len(places), most):
        own = places[at : at + n]
        at += n
        blob = range_encode(b"".join(encode_brick(frame[p], before, p, motion) for p in own))
        directory += struct.pack("<QQ", offset, sum(int(frame[p][0].sum()) for p in own))
        offset += len(blob)
        blobs.append(blob)
    voxels = sum(int(frame[p][0].sum()) for p in places)
    return struct.pack("<IQ", len(places), voxels) + np.packbits(bitmap, bitorder="little").tobytes() + directory + b"".join(blobs)


def decode_frame(block: bytes, before: Frame | None, dims: tuple[int, int, int], most: int, old: bool = False) -> Frame:
    n_cells = dims[0] * dims[1] * dims[2]
    words = -(-n_cells // 32)
    if len(block) < 12 + 4 * words:
        raise Damaged("a frame is cut short")
    n, voxels = struct.unpack_from("<IQ", block)
    bitmap = np.unpackbits(np.frombuffer(block[12 : 12 + 4 * words], np.uint8), bitorder="little")[:n_cells]
    places = sorted((i % dims[0], i // dims[0] % dims[1], i // (dims[0] * dims[1])) for i in np.flatnonzero(bitmap).tolist())
    if len(places) != n:
        raise Damaged("the number of bricks doesn't match the map")
    sizes = group_sizes(n, most)
    at, start, frame, k, total = 12 + 4 * words, 12 + 4 * words + 16 * len(sizes), {}, 0, 0
    decode = decode_brick_old if old else decode_brick
    for size in sizes:
        offset, count = struct.unpack_from("<QQ", block, at)
        at += 16
        total += count
        data, pos, found = memoryview(range_decode(block[start + offset :])), 0, 0
        for p in places[k : k + size]:
            frame[p], pos = decode(data, pos, before, p)
            found += int(frame[p][0].sum())
        if pos != len(data) or found != count:
            raise Damaged("a group's voxels don't match its count")
        k += size
    if total != voxels:
        raise Damaged("the groups' voxels don't add up to the frame's")
    return frame


def frame_of(x: np.ndarray, y: np.ndarray, z: np.ndarray, rgb: np.ndarray) -> Frame:
    """A frame of voxels; the last of a repeated cell holds."""
    place = np.stack((x, y, z), axis=1)
    vi = (place % SIDE) @ (1, SIDE, SIDE * SIDE)
    keys, inverse = np.unique(place // SIDE, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    filled, colour = np.zeros((len(keys), CELLS), bool), np.zeros((len(keys), CELLS, 3), np.uint8)
    filled[inverse, vi] = True
    # of equal places the last: a stable sort, and each run's end
    order = np.argsort(inverse * CELLS + vi, kind="stable")
    at = (inverse * CELLS + vi)[order]
    last = order[np.append(np.flatnonzero(np.diff(at)), len(at) - 1)] if len(at) else order
    colour[inverse[last], vi[last]] = rgb[last]
    return {tuple(k): (filled[i], colour[i]) for i, k in enumerate(keys.tolist())}


def voxels_of(frame: Frame) -> Iterator[np.ndarray]:
    """x, y, z, r, g, b rows, brick by brick."""
    for p, (filled, colour) in sorted(frame.items()):
        vi = np.flatnonzero(filled)
        cell = np.stack((vi % SIDE, vi // SIDE % SIDE, vi // (SIDE * SIDE)), axis=1)
        yield np.concatenate((cell + SIDE * np.array(p), colour[vi]), axis=1).astype(np.int32)


def encode_frames(frames: Iterable[Frame], dims: tuple[int, int, int], most: int, motion: bool) -> Iterator[bytes]:
    """The blocks of one group of pictures: an I-frame and then P-frames."""
    before = None
    for frame in frames:
        yield encode_frame(frame, before, dims, most, motion)
        before = frame
