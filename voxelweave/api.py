"""An encoder that takes frames one by one, and functions on stream files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .operators import frames as F_
from .operators.neighbours import visible
from .operators.volumes import checked_dims
from .sources import arrays, container, nvdb, voxfile

Box = tuple[tuple[int, int, int], tuple[int, int, int]]


def named(path: str) -> tuple[str, str, str]:
    """The folder, name and suffix of a path or an address in a store."""
    folder, _, name = str(path).rpartition("/")
    stem, dot, end = name.rpartition(".")
    return folder or ("/" if str(path).startswith("/") else "."), stem or name, dot + end if stem else ""


class VoxelEncoder:
    """Frames are added in order as lazy relations; finish() encodes them, a group of pictures a task, and writes the file."""

    def __init__(self, spark: SparkSession, width: int, height: int, depth: int, framerate: float, gop_size: int = 1, max_brick_group_size: int = 256, motion_vectors: bool = True, output_path: str = "out.voxels"):
        checked_dims(width, height, depth)
        if not framerate > 0:
            raise ValueError("the frame rate must be positive")
        self.spark, self.dims, self.framerate, self.path = spark, (width, height, depth), framerate, output_path
        self.params = container.Params(gop_size, max_brick_group_size, motion_vectors)
        self.parts: list[DataFrame] = []
        self.count, self.open = 0, True

    def add(self, voxels: DataFrame, n: int, remove_nonvisible: bool) -> None:
        if not self.open:
            raise ValueError("the encoder is closed")
        from pyspark.sql import functions as F

        part = visible(voxels) if remove_nonvisible else voxels
        self.parts.append(part.select(F.lit(named(self.path)[1]).alias("scene"), (F.col("frame") + self.count).cast("int").alias("frame"), "x", "y", "z", "r", "g", "b"))
        self.count += n

    def encode_numpy_frame(self, array: np.ndarray, axes: tuple[str, str, str] = arrays.AXES, remove_nonvisible: bool = False) -> None:
        shape = dict(zip(arrays.AXES, array.shape[:3], strict=False))
        if tuple(shape.get(a) for a in axes) != self.dims:
            raise ValueError("the array's dimensions must be the encoder's")
        self.add(arrays.numpy_frame(self.spark, array, "s", 0, axes), 1, remove_nonvisible)

    def encode_numpy_frame_float(self, array: np.ndarray, axes: tuple[str, str, str] = arrays.AXES, remove_nonvisible: bool = False) -> None:
        self.encode_numpy_frame(np.asarray(array, np.float32), axes, remove_nonvisible)

    def encode_numpy_frame_byte(self, array: np.ndarray, axes: tuple[str, str, str] = arrays.AXES, remove_nonvisible: bool = False) -> None:
        self.encode_numpy_frame(np.asarray(array, np.uint8), axes, remove_nonvisible)

    def encode_nvdb_frame(self, path: str, box: Box, axes: tuple[str, str, str] = arrays.AXES, remove_nonvisible: bool = False) -> None:
        sizes = {a: h - low + 1 for a, low, h in zip(arrays.AXES, *box, strict=True)}
        if tuple(sizes[a] for a in axes) != self.dims:
            raise ValueError("the box's dimensions must be the encoder's")
        self.add(nvdb.load(voxfile.files(self.spark, path), box, axes), 1, remove_nonvisible)

    def encode_vox_frame(self, path: str, box: Box, remove_nonvisible: bool = False) -> int:
        """All frames of an animation; returns how many."""
        (x0, y0, z0), (x1, y1, z1) = box
        if (x1 - x0 + 1, z1 - z0 + 1, y1 - y0 + 1) != self.dims:
            raise ValueError("the box's dimensions must be the encoder's, with y and z exchanged")
        from pyspark.sql import functions as F

        found = voxfile.files(self.spark, path)
        voxels = voxfile.load(found, box)
        shown = voxfile.entries(found).select(voxfile.frame_of("attributes", F.col("entry")).alias("f"))
        n = shown.agg(F.max("f")).first()[0] + 1
        self.add(voxels, n, remove_nonvisible)
        return n

    def finish(self) -> str:
        if not self.parts:
            raise ValueError("a stream without frames can't be written")
        voxels = self.parts[0]
        for p in self.parts[1:]:
            voxels = voxels.unionByName(p)
        folder, stem, suffix = named(self.path)
        if voxels.isEmpty():
            from pyspark.sql import functions as F

            voxels = self.spark.range(1).select(F.lit(stem).alias("scene"), F.lit(self.count - 1).alias("frame"), *(F.lit(None).cast("int").alias(c) for c in "xyzrgb"))
        container.write(voxels, folder, self.dims, self.framerate, self.params, self.count, suffix)
        self.open = False
        return self.path

    def abort(self) -> None:
        """Nothing is written."""
        self.parts, self.open = [], False


def get_vox_max_dimensions(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """The largest size on each axis of the file (z up)."""
    row = voxfile.max_dimensions(voxfile.files(spark, path)).first()
    return row["sx"], row["sy"], row["sz"]


def get_metadata(spark: SparkSession, path: str) -> dict:
    """A file's header."""
    row = container.read(spark, path, "meta").first().asDict(recursive=True)
    row.pop("scene")
    return row


def _rewritten(spark: SparkSession, voxels: DataFrame, out: str, meta: dict, frames: int, motion: bool | None = None) -> None:
    from pyspark.sql import functions as F

    p, (folder, stem, suffix) = meta["encodingParams"], named(out)
    params = container._stored(p["gopSize"], p["maxBrickGroupSize"], p["motionVectors"] if motion is None else motion)
    container.write(voxels.withColumn("scene", F.lit(stem)), folder, (meta["width"], meta["height"], meta["depth"]), meta["framerate"], params, frames, suffix)


def concat(spark: SparkSession, paths: list[str], out: str) -> None:
    """Files one after the other; parameters and frame rate are the first one's."""
    import warnings

    from pyspark.sql import functions as F

    metas = [get_metadata(spark, p) for p in paths]
    if len({(m["width"], m["height"], m["depth"]) for m in metas}) != 1:
        raise ValueError("files to join have the same dimensions")
    if any(abs(m["framerate"] - metas[0]["framerate"]) > 0.1 for m in metas):
        warnings.warn("frame rates differ; the first file's holds", stacklevel=2)
    start, voxels = 0, None
    for path, meta in zip(paths, metas, strict=True):
        part = container.read(spark, path).withColumn("frame", F.col("frame") + start)
        voxels = part if voxels is None else voxels.unionByName(part)
        start += meta["frameCount"]
    _rewritten(spark, voxels, out, metas[0], start)


def split(spark: SparkSession, path: str, seconds: float, folder: str) -> int:
    """Parts `split_0000` and so on, with the file's own suffix, of so many seconds; returns how many."""
    from pyspark.sql import functions as F

    meta = get_metadata(spark, path)
    voxels = F_.split(container.read(spark, path), seconds, meta["framerate"])
    size = int(np.float32(seconds) * np.float32(meta["framerate"]))
    parts = -(-meta["frameCount"] // size)
    for k in range(parts):
        own = voxels.where((F.col("part") == k) & F.col("frame").between(k * size, (k + 1) * size - 1)).select("scene", F.col("part_frame").cast("int").alias("frame"), "x", "y", "z", "r", "g", "b")
        _rewritten(spark, own, f"{folder}/split_{k:04d}{named(path)[2]}", meta, min(size, meta["frameCount"] - k * size))
    return parts


def upgrade(spark: SparkSession, path: str, out: str) -> None:
    """Rewrites a file of the older format; motion vectors are used."""
    meta = get_metadata(spark, path)
    _rewritten(spark, container.read(spark, path), out, meta, meta["frameCount"], True)


def dump_to_nvdb(spark: SparkSession, path: str, folder: str) -> int:
    """One grid file a frame; returns how many."""
    return nvdb.save(container.read(spark, path), folder).count()
