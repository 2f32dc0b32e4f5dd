"""Sparse three-component grids from .nvdb files: segments, grid metadata, leaf nodes.

Read: uncompressed and ZIP segments, and BLOSC segments whose chunks hold unshuffled or byte-shuffled LZ4 blocks or stored bytes. Active cells of leaf
nodes are given, and active tiles above them as the cells that they stand for. Written: grids with all their nodes, the larger before the smaller.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import quantise_rounded
from ..operators.volumes import Box, read_box

# Magic, version, layout sizes and codes of the format.
MAGIC = b"NanoVDB0"
MAJOR = 32
VERSION = MAJOR << 21 | 3 << 10 | 3
VEC3F = 6
NONE, ZIP, BLOSC = 0, 1, 2
SEGMENT = struct.Struct("<8sIHH")
META = struct.Struct("<4Q2I6d6i3dI4I3IHHI")
GRID_BYTES, TREE_BYTES, LEAF_BYTES = 672, 64, 6272
LEAF_MASK, LEAF_VALUES = 16, 128
ROOT_BYTES, TILE_BYTES = 96, 32
#: Of lower and upper nodes: bits of a child's side, bits of its number along an axis, bytes to the table, bytes.
LOWER, UPPER = (3, 4, 1088, 66624), (7, 5, 8256, 532544)
HAS_BOX, BREADTH_FIRST, LEAF_HAS_BOX = 2, 32, 2
UNCHECKED = (1 << 64) - 1
CELLS = "scene string, grid string, x int, y int, z int, vr float, vg float, vb float"


def name_hash(name: str) -> int:
    """The 64-bit key of a grid's name: base 67, with the byte that overflows added back."""
    key = 0
    for c in name.encode():
        key = key * 67 + c + (key >> 56) & (1 << 64) - 1
    return key


def reversed_bytes(word: int) -> int:
    return int.from_bytes(word.to_bytes(8, "little"), "big")


def blosc_chunk(raw: bytes) -> bytes:
    """One Blosc chunk's bytes."""
    import pyarrow as pa

    _, _, flags, width, size, block, total = struct.unpack_from("<4B3I", raw)
    if flags & 2:
        return raw[16 : 16 + size]
    if flags >> 5 not in (1,):
        raise ValueError("only LZ4 Blosc chunks can be read")
    n = -(-size // block)
    out = b""
    for k, start in enumerate(struct.unpack_from(f"<{n}I", raw, 16)):
        want = min(block, size - k * block)
        parts = width if not flags & 16 and want == block and 1 < width <= 16 and block // width >= 128 else 1
        at, data = start, b""
        for _ in range(parts):
            (have,) = struct.unpack_from("<i", raw, at)
            piece = raw[at + 4 : at + 4 + have]
            data += piece if have == want // parts else pa.Codec("lz4_raw").decompress(piece, want // parts).to_pybytes()
            at += 4 + have
        if flags & 1 and width > 1:
            whole = want // width * width
            data = np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]
        out += data
    return out


def grids(content: bytes) -> Iterator[tuple[str, int, dict, bytes]]:
    """Name, type, metadata and memory image of each grid of a file."""
    at = 0
    while at < len(content):
        if len(content) < at + SEGMENT.size:
            raise ValueError("a segment is cut short")
        magic, version, count, codec = SEGMENT.unpack_from(content, at)
        if magic != MAGIC:
            swapped = int.from_bytes(magic, "little") == reversed_bytes(int.from_bytes(MAGIC, "little"))
            raise ValueError("a file of the other byte order" if swapped else "not a .nvdb file")
        if version >> 21 != MAJOR:
            raise ValueError("a major version that can't be read")
        at += SEGMENT.size
        found = []
        for _ in range(count):
            m = META.unpack_from(content, at)
            name = content[at + META.size : at + META.size + m[21]].rstrip(b"\0").decode("latin-1")
            found.append((name, m))
            at += META.size + m[21]
        for name, m in found:
            raw = content[at : at + m[1]]
            if len(raw) < m[1]:
                raise ValueError("a grid is cut short")
            at += m[1]
            if codec == BLOSC:
                image, k = b"", 0
                while len(image) < m[0]:
                    (n,) = struct.unpack_from("<Q", raw, k)
                    image += blosc_chunk(raw[k + 8 : k + 8 + n])
                    k += 8 + n
            elif codec == NONE:
                image = raw
            elif codec == ZIP:
                (n,) = struct.unpack_from("<Q", raw)
                image = zlib.decompress(raw[8 : 8 + n])
            else:
                raise ValueError("a codec that can't be read")
            yield name, m[4], {"voxels": m[3], "index_box": m[12:18], "bytes": m[0], "codec": codec}, image


def active_cells(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the active cells of a three-float grid's leaves."""
    first = struct.unpack_from("<4Q", image, GRID_BYTES)[0]
    (n,) = struct.unpack_from("<I", image, GRID_BYTES + 32)
    if not n:
        return np.zeros((0, 3), np.int32), np.zeros((0, 3), np.float32)
    start = GRID_BYTES + first
    if start + n * LEAF_BYTES > len(image):
        raise ValueError("leaves are cut short")
    leaves = np.frombuffer(image, np.uint8, n * LEAF_BYTES, start).reshape(n, LEAF_BYTES)
    low = leaves[:, :12].copy().view("<i4") & ~7
    on = np.unpackbits(leaves[:, LEAF_MASK : LEAF_MASK + 64], axis=1, bitorder="little").astype(bool)
    leaf, cell = np.nonzero(on)
    values = leaves[:, LEAF_VALUES:].copy().view("<f4").reshape(n, 512, 3)[leaf, cell]
    return low[leaf] + np.stack((cell >> 6, cell >> 3 & 7, cell & 7), axis=1), values


def node_masks(nodes: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes' bytes: which places have an active value, and which have a child."""
    n = 1 << 3 * log2 - 3
    return tuple(np.unpackbits(nodes[:, 32 + k * n : 32 + (k + 1) * n], axis=1, bitorder="little").astype(bool) for k in range(2))


def tiles(image: bytes) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Low corner, side and value of the active tiles above the leaves."""
    offset, count = struct.unpack_from("<4Q", image, GRID_BYTES), struct.unpack_from("<3I", image, GRID_BYTES + 32)
    for k, (child, log2, table, size) in ((1, LOWER), (2, UPPER)):
        if not count[k]:
            continue
        nodes = np.frombuffer(image, np.uint8, count[k] * size, GRID_BYTES + offset[k]).reshape(count[k], size)
        on, below = node_masks(nodes, log2)
        low = nodes[:, :12].copy().view("<i4") & ~((1 << child + log2) - 1)
        for i, n in zip(*np.nonzero(on & ~below), strict=True):
            at = np.array([n >> 2 * log2, n >> log2 & (1 << log2) - 1, n & (1 << log2) - 1]) << child
            yield low[i] + at, 1 << child, np.frombuffer(image, "<f4", 3, GRID_BYTES + offset[k] + int(i) * size + table + 16 * int(n))
    if offset[3]:
        root = GRID_BYTES + offset[3]
        (n,) = struct.unpack_from("<I", image, root + 24)
        for i in range(n):
            key, child, state = struct.unpack_from("<QqI", image, root + ROOT_BYTES + i * TILE_BYTES)
            if not child and state & 1:
                at = np.array([key >> 42, key >> 21, key], np.int64) & 0xFFFFF
                yield (at - (at >> 19 << 20)) << 12, 4096, np.frombuffer(image, "<f4", 3, root + ROOT_BYTES + i * TILE_BYTES + 20)


def tile_cells(image: bytes, box: Box | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Coordinates and values of the cells of active tiles, those in an inclusive box alone if one is given."""
    for low, side, value in tiles(image):
        high = low + side - 1
        if box is not None:
            low, high = np.maximum(low, box[0]), np.minimum(high, box[1])
        elif side > 128:
            raise ValueError("a root tile is only read in a box")
        if (low <= high).all():
            for x in range(int(low[0]), int(high[0]) + 1):  # a plane at a time
                y, z = (g.reshape(-1) for g in np.meshgrid(np.arange(low[1], high[1] + 1), np.arange(low[2], high[2] + 1), indexing="ij"))
                yield np.stack((np.full(len(y), x), y, z), axis=1), np.repeat(value[None, :], len(y), axis=0)


def faults(image: bytes) -> list[str]:
    """What is wrong with a three-float grid's tree: nodes that no parent has, or that aren't where their parent's table says."""
    out: list[str] = []
    if len(image) < GRID_BYTES + TREE_BYTES or image[:8] != MAGIC:
        return ["no grid"]
    offset, count = struct.unpack_from("<4Q", image, GRID_BYTES), struct.unpack_from("<3I", image, GRID_BYTES + 32)
    if struct.unpack_from("<Q", image, 32)[0] != len(image):
        out.append("the grid's size isn't its length")
    if not offset[3]:
        return [*out, "no root"]
    sizes = (LEAF_BYTES, LOWER[3], UPPER[3])
    root = GRID_BYTES + offset[3]
    (n,) = struct.unpack_from("<I", image, root + 24)
    parents = [(root, [struct.unpack_from("<Qq", image, root + ROOT_BYTES + i * TILE_BYTES)[1] for i in range(n)])]
    for level, (child, log2, table, size) in ((2, UPPER), (1, LOWER), (0, (0, 3, LEAF_VALUES, LEAF_BYTES))):
        found = sorted(at + c for at, below in parents for c in below if c)
        if found != [GRID_BYTES + offset[level] + i * sizes[level] for i in range(count[level])]:
            return [*out, f"nodes of level {level} aren't those of their parents"]
        if found and found[-1] + sizes[level] > len(image):
            return [*out, f"nodes of level {level} are cut short"]
        parents = []
        for at in found if level else ():
            _, below = node_masks(np.frombuffer(image, np.uint8, size, at).reshape(1, -1), log2)
            parents.append((at, [struct.unpack_from("<q", image, at + table + 16 * i)[0] for i in np.flatnonzero(below[0]).tolist()]))
    active = int(np.bitwise_count(np.frombuffer(image, np.uint8, count[0] * LEAF_BYTES, GRID_BYTES + offset[0]).reshape(-1, LEAF_BYTES)[:, LEAF_MASK : LEAF_MASK + 64]).sum()) if count[0] else 0
    if active + sum(side**3 for _, side, _ in tiles(image)) != struct.unpack_from("<Q", image, GRID_BYTES + 56)[0]:
        out.append("the active cells aren't as many as the tree says")
    return out


def grid_list(files: DataFrame) -> DataFrame:
    """scene, grid, type, voxels, bytes of every grid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path.rsplit("/", 1)[-1], name, kind, meta["voxels"], meta["bytes"]) for path, content in zip(batch["path"], batch["content"], strict=True) for name, kind, meta, _ in grids(bytes(content))]
            yield pd.DataFrame(rows, columns=["scene", "grid", "type", "voxels", "bytes"])

    return files.select("path", "content").mapInPandas(run, "scene string, grid string, type int, voxels long, bytes long")


def checked(files: DataFrame) -> DataFrame:
    """scene, grid, voxels and faults of every three-float grid: what is wrong with its tree, joined by semicolons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path.rsplit("/", 1)[-1], name, meta["voxels"], "; ".join(faults(image))) for path, content in zip(batch["path"], batch["content"], strict=True) for name, kind, meta, image in grids(bytes(content)) if kind == VEC3F]
            yield pd.DataFrame(rows, columns=["scene", "grid", "voxels", "faults"])

    return files.select("path", "content").mapInPandas(run, "scene string, grid string, voxels long, faults string")


def cells(files: DataFrame, grid: str | None = None, box: Box | None = None) -> DataFrame:
    """Active cells of each file's grid of this name, or first grid; of active tiles those in the inclusive box alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                scene = path.rsplit("/", 1)[-1]
                for name, kind, _, image in grids(bytes(content)):
                    if grid is not None and name != grid:
                        continue
                    if kind != VEC3F:
                        raise ValueError(f"{scene}: only grids of three floats can be read")
                    for at, v in (active_cells(image), *tile_cells(image, box)):
                        yield pd.DataFrame({"scene": scene, "grid": name, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "vr": v[:, 0], "vg": v[:, 1], "vb": v[:, 2]})
                    break

    return files.select("path", "content").mapInPandas(run, CELLS)


def load(files: DataFrame, box: Box, axes: tuple[str, str, str] = ("x", "y", "z"), frame: int = 0) -> DataFrame:
    """Voxels of each file's first grid in a box, as one frame; files in order of name give rising frames with number_frames."""
    # the box is one of the output's axes, so its corners go back to the grid's
    corners = tuple(tuple(c[axes.index(a)] for a in "xyz") for c in box)
    rows = read_box(cells(files, box=corners), box, axes)
    colour = {c: F.pmod(quantise_rounded(F.col(f"v{c}")), F.lit(256)) for c in "rgb"}
    return rows.select("scene", F.lit(frame).alias("frame"), "x", "y", "z", *(v.cast("int").alias(c) for c, v in colour.items()))


def number_frames(voxels: DataFrame, files: DataFrame, scene: str) -> DataFrame:
    """Voxels of a folder of one-frame files as one scene: frames in order of file name. The list of files is ordered in one place."""
    from pyspark.sql import Window

    order = Window.orderBy("name")
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct().withColumn("frame", (F.row_number().over(order) - 1).cast("int"))
    rows = voxels.drop("frame").join(names, voxels["scene"] == names["name"])
    return rows.select(F.lit(scene).alias("scene"), "frame", "x", "y", "z", "r", "g", "b")


def inner_nodes(keys: np.ndarray, kind: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes above children with these low corners, without their children's offsets: low corners, bytes, and each child's (node, place)."""
    child, log2, table, size = kind
    low, of = np.unique(keys >> child + log2, axis=0, return_inverse=True)
    of = of.reshape(-1)
    nodes = np.zeros((len(low), size), np.uint8)
    at = keys >> child & (1 << log2) - 1
    place = at[:, 0] << 2 * log2 | at[:, 1] << log2 | at[:, 2]
    below = np.zeros((len(low), 1 << 3 * log2), np.uint8)
    below[of, place] = 1
    n = 1 << 3 * log2 - 3
    nodes[:, 32 + n : 32 + 2 * n] = np.packbits(below, axis=1, bitorder="little")
    return low << child + log2, nodes, np.stack((of, place), axis=1)


def boxes(at: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest coordinates of n groups of cells."""
    low, high = np.full((n, 3), np.iinfo(np.int32).max, np.int64), np.full((n, 3), np.iinfo(np.int32).min, np.int64)
    np.minimum.at(low, of, at)
    np.maximum.at(high, of, at)
    return low, high


def grid_image(at: np.ndarray, values: np.ndarray, name: str = "volume") -> bytes:
    """A grid's memory image: grid and tree data, root, upper and lower nodes, leaves with these active cells."""
    at = at.astype(np.int64).reshape(-1, 3)
    keys, inverse = np.unique(at >> 3, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    leaves = np.zeros((len(keys), LEAF_BYTES), np.uint8)
    cell = (at[:, 0] & 7) << 6 | (at[:, 1] & 7) << 3 | at[:, 2] & 7
    on = np.zeros((len(keys), 512), np.uint8)
    on[inverse, cell] = 1
    stored = np.zeros((len(keys), 512, 3), "<f4")
    stored[inverse, cell] = values
    low, high = boxes(at, inverse, len(keys))
    leaves[:, :12] = low.astype("<i4").view(np.uint8).reshape(len(keys), 12)
    leaves[:, 12:15] = high - low
    leaves[:, 15] = LEAF_HAS_BOX
    leaves[:, LEAF_MASK : LEAF_MASK + 64] = np.packbits(on, axis=1, bitorder="little")
    leaves[:, LEAF_VALUES:] = stored.reshape(len(keys), 1536).view(np.uint8)
    # nodes above, from the leaves up; then where each begins
    lower_low, lower, leaf_in = inner_nodes(keys << 3, LOWER)
    upper_low, upper, lower_in = inner_nodes(lower_low, UPPER)
    n_root = len(upper_low)
    root_at = GRID_BYTES + TREE_BYTES
    upper_at = root_at + ROOT_BYTES + TILE_BYTES * n_root
    lower_at = upper_at + upper.size
    leaf_at = lower_at + lower.size
    of_cell = leaf_in[inverse, 0] if len(at) else inverse
    for nodes, inside, (_, _, table, size), own_at, child_at, child_size, group in (
        (lower, leaf_in, LOWER, lower_at, leaf_at, LEAF_BYTES, of_cell),
        (upper, lower_in, UPPER, upper_at, lower_at, LOWER[3], lower_in[of_cell, 0] if len(at) else inverse),
    ):
        offsets = child_at + child_size * np.arange(len(inside)) - (own_at + size * inside[:, 0])
        nodes[:, table:].reshape(len(nodes), (size - table) // 16, 16)[inside[:, 0], inside[:, 1], :8] = offsets.astype("<i8").view(np.uint8).reshape(-1, 8)
        ends = np.concatenate(boxes(at, group, len(nodes)), axis=1)
        nodes[:, :24] = ends.astype("<i4").view(np.uint8).reshape(len(nodes), 24)
    whole = np.concatenate((at.min(axis=0), at.max(axis=0))).tolist() if len(at) else [0, 0, 0, -1, -1, -1]
    root = struct.pack("<6iI9f2f", *whole, n_root, *([0.0] * 11)).ljust(ROOT_BYTES, b"\0")
    for i, (x, y, z) in enumerate(((upper_low & 0xFFFFFFFF) >> 12).tolist()):
        root += struct.pack("<QqI3f", x << 42 | y << 21 | z, upper_at + i * UPPER[3] - root_at, 0, 0.0, 0.0, 0.0)
    starts = (x - GRID_BYTES for x in (leaf_at, lower_at, upper_at, root_at))
    tree = struct.pack("<4Q3I3IQ", *starts, len(leaves), len(lower), len(upper), 0, 0, 0, len(at))
    size = leaf_at + leaves.size
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    grid = struct.pack("<8sQ4IQ256s", MAGIC, UNCHECKED, VERSION, HAS_BOX | BREADTH_FIRST, 0, 1, size, name.encode()[:255])
    grid += struct.pack("<22f", *unit, *unit, 0.0, 0.0, 0.0, 1.0) + struct.pack("<22d", *unit, *unit, 0.0, 0.0, 0.0, 1.0)
    grid += struct.pack("<6d3d2IqI", *whole[:3], *(x + 1 for x in whole[3:]), 1.0, 1.0, 1.0, 0, VEC3F, 0, 0)
    return b"".join((grid.ljust(GRID_BYTES, b"\0"), tree, root, upper.tobytes(), lower.tobytes(), leaves.tobytes()))


def file_bytes(name: str, image: bytes, voxels: int, kind: int = VEC3F, codec: int = NONE) -> bytes:
    """A file of one grid, uncompressed or ZIP."""
    label = name.encode() + b"\0"
    packed = image
    if codec == ZIP:
        packed = zlib.compress(image)
        packed = struct.pack("<Q", len(packed)) + packed
    nodes = struct.unpack_from("<3I", image, GRID_BYTES + 32)
    world, inside = struct.unpack_from("<6d", image, 560), struct.unpack_from("<6i", image, GRID_BYTES + TREE_BYTES)
    meta = META.pack(len(image), len(packed), name_hash(name), voxels, kind, 0, *world, *inside, 1.0, 1.0, 1.0, len(label), *nodes, 1, 0, 0, 0, codec, 0, VERSION)
    return SEGMENT.pack(MAGIC, VERSION, 1, codec) + meta + label + packed


def save(voxels: DataFrame, folder: str) -> DataFrame:
    """Writes each frame as `frame_<n>.nvdb` below folder/<scene>: colours as shares. Returns scene, frame, path."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from .container import open_sink

        scene, frame = rows["scene"].iloc[0], int(rows["frame"].iloc[0])
        image = grid_image(rows[["x", "y", "z"]].to_numpy(np.int64), rows[["r", "g", "b"]].to_numpy(np.float32) / np.float32(255))
        path = f"{folder}/{scene}/frame_{frame}.nvdb"
        with open_sink(path) as sink:
            sink.write(file_bytes("volume", image, len(rows)))
        return pd.DataFrame([(scene, frame, path)], columns=["scene", "frame", "path"])

    return voxels.groupBy("scene", "frame").applyInPandas(run, "scene string, frame int, path string")
