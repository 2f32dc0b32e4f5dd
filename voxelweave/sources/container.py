"""Reading and writing of encoded voxel streams.

read() and the data source "voxelstream" give one partition to each group of pictures and decode it in order; a filter on `frame`
leaves out groups. write() encodes each group in a task of its own; one task a file then joins the blocks and writes the frame table.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import codec

# Magic, versions (major, minor, patch, sub) and header layouts.
MAGIC = ord("s") << 24 | ord("p") << 16 | ord("l") << 8 | ord("v")
VERSION, OLD_VERSION = 0 << 24 | 3 << 16, 0 << 24 | 2 << 16 | 1 << 8
HEADER, OLD_HEADER = struct.Struct("<IIIIIfIfIIB7xQ"), struct.Struct("<IIIIIfIfIIQ")
HEADER_BYTES = HEADER.size

VOXELS = "scene string, frame int, x int, y int, z int, r int, g int, b int"
META = "scene string, width int, height int, depth int, framerate float, frameCount int, duration float, encodingParams struct<gopSize:int, maxBrickGroupSize:int, motionVectors:boolean>, version string"
INDEX = "scene string, frame int, type string, ptr long"


@dataclass
class Params:
    gop: int = 1
    group: int = 256
    motion: bool = True

    def __post_init__(self):
        import warnings

        if self.gop < 1:
            raise ValueError("a group of pictures has at least one frame")
        if self.group < 0:
            raise ValueError("a brick group can't be negative")
        if 0 < self.group < 128:
            warnings.warn("small brick groups compress badly", stacklevel=2)


@dataclass
class Header:
    width: int
    height: int
    depth: int
    framerate: float
    frames: int
    duration: float
    params: Params
    table: int
    old: bool = False

    @property
    def dims(self) -> tuple[int, int, int]:
        return self.width // 8, self.height // 8, self.depth // 8

    def pack(self) -> bytes:
        return HEADER.pack(MAGIC, VERSION, self.width, self.height, self.depth, self.framerate, self.frames, self.frames / self.framerate, self.params.gop, self.params.group, self.params.motion, self.table)


def open_file(path: str):
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+]*://", path):
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))


def read_header(file) -> Header:
    raw = file.read_at(HEADER.size, 0)
    if len(raw) < OLD_HEADER.size:
        raise codec.Damaged("too short for a header")
    magic, version = struct.unpack_from("<II", raw)
    if magic != MAGIC:
        raise codec.Damaged("not a voxel stream")
    if version == VERSION and len(raw) == HEADER.size:
        _, _, w, h, d, rate, n, duration, gop, group, motion, table = HEADER.unpack(raw)
    elif version == OLD_VERSION:
        _, _, w, h, d, rate, n, duration, gop, group, table = OLD_HEADER.unpack(raw[: OLD_HEADER.size])
        motion = False
    else:
        raise codec.Damaged("a version that can't be read")
    if any(k == 0 or k % 8 for k in (w, h, d)):
        raise codec.Damaged("dimensions must be positive multiples of 8")
    if not rate > 0 or n == 0 or gop == 0:
        raise codec.Damaged("frame rate, frame count and group of pictures must be positive")
    if abs(n / rate - duration) > 0.1:
        duration = n / rate
    return Header(w, h, d, rate, n, duration, _stored(gop, group, bool(motion)), table, version == OLD_VERSION)


def _stored(gop: int, group: int, motion: bool) -> Params:
    """Parameters of a file, without the warning on how to choose them."""
    p = Params(gop, 0, motion)
    p.group = group
    return p


def read_table(file, header: Header) -> list[tuple[str, int, int]]:
    """Type, start and end of each frame's block."""
    raw = file.read_at(8 * header.frames, header.table)
    if len(raw) < 8 * header.frames:
        raise codec.Damaged("the frame table is cut short")
    entries = np.frombuffer(raw, "<u8")
    kinds, starts = (entries >> np.uint64(56)).tolist(), (entries & np.uint64((1 << 56) - 1)).astype(np.int64).tolist()
    if kinds[0] != 0 or any(k > 1 for k in kinds) or any(a > b for a, b in zip(starts, [*starts[1:], header.table], strict=True)):
        raise codec.Damaged("the frame table is impossible")
    return [("IP"[k], a, b) for k, a, b in zip(kinds, starts, [*starts[1:], header.table], strict=True)]


def groups_of(table: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """First frame and end of each run that starts with an I-frame."""
    keys = [i for i, t in enumerate(table) if t[0] == "I"]
    return list(zip(keys, [*keys[1:], len(table)], strict=True))


def decode_range(path: str, first: int, last: int, wanted: set[int] | None = None) -> Iterator[tuple[int, codec.Frame]]:
    """Frames first..last-1 of a file, decoded in order from `first`, an I-frame."""
    with open_file(path) as file:
        header = read_header(file)
        table, before = read_table(file, header), None
        for i in range(first, last):
            kind, a, b = table[i]
            before = codec.decode_frame(file.read_at(b - a, a), None if kind == "I" else before, header.dims, header.params.group, header.old)
            if wanted is None or i in wanted:
                yield i, before


@dataclass
class Span(InputPartition):
    path: str
    first: int
    last: int


def listed(spark_path: str) -> list[str]:
    """The files that a path, folder or pattern names, by name."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+]*://", spark_path):
        system, inner = fs.FileSystem.from_uri(spark_path)
        prefix = spark_path[: len(spark_path) - len(inner)]
    else:
        system, inner, prefix = fs.LocalFileSystem(), spark_path.removeprefix("file:"), ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return [prefix + f.path for f in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda f: f.path) if f.type == fs.FileType.File]
    return [spark_path]


class VoxelStreamReader(DataSourceReader):
    def __init__(self, path: str, view: str):
        self.path, self.view, self.low, self.high, self.only = path, view, None, None, None

    def pushFilters(self, filters: list[Filter]):
        """Takes bounds on `frame`, to leave out groups of pictures; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",):
                if isinstance(f, EqualTo):
                    self.only = {f.value}
                elif isinstance(f, In):
                    self.only = set(f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low or 0, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(f.value - isinstance(f, LessThan), self.high if self.high is not None else f.value)
            yield f

    def wants(self, frame: int) -> bool:
        return (self.low is None or frame >= self.low) and (self.high is None or frame <= self.high) and (self.only is None or frame in self.only)

    def partitions(self):
        found = []
        for path in listed(self.path):
            if self.view != "voxels":
                found.append(Span(path, 0, 0))
                continue
            with open_file(path) as file:
                table = read_table(file, read_header(file))
            for a, b in groups_of(table):
                asked = [i for i in range(a, b) if self.wants(i)]
                if asked:
                    found.append(Span(path, a, asked[-1] + 1))
        return found

    def read(self, span: Span):
        scene = span.path.rsplit("/", 1)[-1]
        if self.view == "voxels":
            names = ["scene", "frame", "x", "y", "z", "r", "g", "b"]
            for i, frame in decode_range(span.path, span.first, span.last, {i for i in range(span.first, span.last) if self.wants(i)}):
                for rows in codec.voxels_of(frame):
                    yield pa.RecordBatch.from_arrays([pa.array([scene] * len(rows)), pa.array(np.full(len(rows), i, np.int32)), *(pa.array(rows[:, k]) for k in range(6))], names)
            return
        with open_file(span.path) as file:
            h = read_header(file)
            if self.view == "meta":
                version = "0.2.1.0" if h.old else "0.3.0.0"
                yield (scene, h.width, h.height, h.depth, h.framerate, h.frames, h.duration, (h.params.gop, h.params.group, h.params.motion), version)
            else:
                for i, (kind, at, _) in enumerate(read_table(file, h)):
                    yield (scene, i, kind, at)


class VoxelStream(DataSource):
    """spark.read.format("voxelstream").option("view", "voxels" | "meta" | "index").load(path)"""

    @classmethod
    def name(cls):
        return "voxelstream"

    def view(self) -> str:
        view = self.options.get("view", "voxels")
        if view not in ("voxels", "meta", "index"):
            raise ValueError("view is voxels, meta or index")
        return view

    def schema(self):
        return {"voxels": VOXELS, "meta": META, "index": INDEX}[self.view()]

    def reader(self, schema):
        return VoxelStreamReader(self.options["path"], self.view())


def read(spark: SparkSession, path: str, view: str = "voxels") -> DataFrame:
    spark.dataSource.register(VoxelStream)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("voxelstream").option("view", view).load(path)


def decode_bytes(content: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Frame number and voxel rows of an encoded stream in memory."""
    file = pa.BufferReader(content)
    header = read_header(file)
    before = None
    for i, (kind, a, b) in enumerate(read_table(file, header)):
        before = codec.decode_frame(file.read_at(b - a, a), None if kind == "I" else before, header.dims, header.params.group, header.old)
        for rows in codec.voxels_of(before):
            yield i, rows


def read_column(streams: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Voxels of encoded streams in a binary column, as spark.read.format("binaryFile") gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, raw in zip(batch[name], batch[content], strict=True):
                for i, rows in decode_bytes(raw):
                    yield pd.DataFrame(rows, columns=list("xyzrgb")).assign(scene=scene.rsplit("/", 1)[-1], frame=i)[["scene", "frame", *"xyzrgb"]]

    return streams.select(name, content).mapInPandas(run, VOXELS)


def encode_groups(voxels: DataFrame, dims: tuple[int, int, int], params: Params, frames: int | None = None) -> DataFrame:
    """scene, gop, frame, type, voxels, block: the encoded frames, each group of pictures in one task. Frames without voxels are encoded empty."""
    bricks = tuple(n // 8 for n in dims)
    last = voxels.groupBy("scene").agg((F.max("frame") + 1).alias("n"))
    if frames is not None:
        last = last.withColumn("n", F.lit(frames))
    cols = ["x", "y", "z", "r", "g", "b"]
    marks = last.select("scene", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame"), *(F.lit(None).cast("int").alias(c) for c in cols))
    rows = voxels.select("scene", "frame", *cols).unionByName(marks).withColumn("gop", F.floor(F.col("frame") / params.gop).cast("int"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, before = [], None
        scene, gop = rows["scene"].iloc[0], int(rows["gop"].iloc[0])
        for i, own in rows.groupby("frame", sort=True):
            own = own.dropna()
            v = own[cols].to_numpy(dtype=np.int64)
            if ((v[:, :3] < 0) | (v[:, :3] >= dims)).any():
                raise ValueError(f"frame {i} of {scene} has voxels outside its dimensions")
            frame = codec.frame_of(*v[:, :3].T, v[:, 3:].astype(np.uint8)) if len(v) else {}
            out.append((scene, gop, int(i), "P" if before is not None else "I", len(v), codec.encode_frame(frame, before, bricks, params.group, params.motion)))
            before = frame
        return pd.DataFrame(out, columns=["scene", "gop", "frame", "type", "voxels", "block"])

    return rows.groupBy("scene", "gop").applyInPandas(run, "scene string, gop int, frame int, type string, voxels long, block binary")


def write(voxels: DataFrame, folder: str, dims: tuple[int, int, int], framerate: float, params: Params | None = None, frames: int | None = None, suffix: str = ".voxels") -> DataFrame:
    """Writes each scene as a file `<scene><suffix>` in a folder that all machines share; returns scene, path, frames and bytes.

    A scene's blocks come to one task in order and are written as they come; a file appears under its name when it is whole.
    """
    from ..operators.volumes import checked_dims

    params = params or Params()
    checked_dims(*dims)
    if not framerate > 0:
        raise ValueError("the frame rate must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        scene, sink, table, at, own, done = None, None, [], 0, "", []

        def close() -> None:
            sink.write(np.array(table, "<u8").tobytes())
            sink.close()
            header = Header(*dims, framerate, len(table), 0, params, at).pack()
            # object stores can't write in place: the header goes before a copy of what follows it
            final = f"{root}/{scene}{suffix}"
            with system.open_input_stream(own) as src, system.open_output_stream(own + ".whole") as out:
                src.read(len(header))
                out.write(header)
                while chunk := src.read(8 << 20):
                    out.write(chunk)
            system.delete_file(own)
            system.move(own + ".whole", final)
            done.append((scene, f"{folder}/{scene}{suffix}", len(table), at + 8 * len(table)))

        for batch in batches:
            for s, kind, block in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if s != scene:
                    if sink:
                        close()
                    scene, table, own = s, [], f"{root}/.{uuid.uuid4().hex}"
                    sink = system.open_output_stream(own)
                    sink.write(bytes(HEADER_BYTES))
                    at = HEADER_BYTES
                table.append((kind == "P") << 56 | at)
                sink.write(block)
                at += len(block)
        if sink:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["scene", "path", "frames", "bytes"])

    blocks = encode_groups(voxels, dims, params, frames).select("scene", "frame", "type", "block")
    out = blocks.repartition("scene").sortWithinPartitions("scene", "frame").mapInArrow(run, "scene string, path string, frames long, bytes long")
    session = voxels.sparkSession
    found = out.collect()  # one row a file
    if not found:
        raise ValueError("a stream without frames can't be written")
    return session.createDataFrame(found, "scene string, path string, frames long, bytes long")


def encoded_sizes(blocks: DataFrame) -> DataFrame:
    """Each frame's place in its file: the running sum of block sizes after the header."""
    from pyspark.sql import Window

    w = Window.partitionBy("scene").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("block")
    return blocks.select("scene", "frame", "type", size.alias("bytes"), (F.coalesce(F.sum(size).over(w), F.lit(0)) + HEADER.size).alias("ptr"))


def open_sink(path: str):
    """An output stream; folders on the way are made."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+]*://", path) else (fs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)
