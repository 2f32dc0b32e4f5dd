""".vox animations: chunks, dictionaries, palettes, models shown at frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import fill_frames

CHUNKS = "scene string, chunk string, nth int, payload binary"


def default_palette() -> list[tuple[int, int, int]]:
    """The format's built-in palette by its rule: steps of a colour cube, then ramps. Place k holds colour index k + 1's colour; place 0 is unused by it."""
    steps = (0xFF, 0xCC, 0x99, 0x66, 0x33, 0x00)
    cube = [(r, g, b) for r in steps for g in steps for b in steps][:-1]
    ramp = (0xEE, 0xDD, 0xBB, 0xAA, 0x88, 0x77, 0x55, 0x44, 0x22, 0x11)
    ramps = [(v, 0, 0) for v in ramp] + [(0, v, 0) for v in ramp] + [(0, 0, v) for v in ramp] + [(v, v, v) for v in ramp]
    return [(0, 0, 0), *cube, *ramps]


def chunks(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Identifier and payload of each child of the main chunk."""
    if len(content) < 20 or content[:4] != b"VOX ":
        raise ValueError("not a .vox file")
    ident, size, children = struct.unpack_from("<4sII", content, 8)
    if ident != b"MAIN":
        raise ValueError("a .vox file starts with its main chunk")
    at, end = 20, min(len(content), 20 + size + children)
    while at < end:
        if at + 12 > end:
            raise ValueError("a chunk is cut short")
        ident, size, inner = struct.unpack_from("<4sII", content, at)
        if at + 12 + size > len(content):
            raise ValueError("a chunk is cut short")
        yield ident.decode("latin-1"), content[at + 12 : at + 12 + size]
        at += 12 + size + inner


def read_dict(data: bytes, at: int) -> tuple[dict[str, str], int]:
    def text(at: int) -> tuple[str, int]:
        (n,) = struct.unpack_from("<I", data, at)
        return data[at + 4 : at + 4 + n].decode("latin-1"), at + 4 + n

    (n,), found = struct.unpack_from("<I", data, at), {}
    at += 4
    for _ in range(n):
        key, at = text(at)
        value, at = text(at)
        found.setdefault(key, value)
    return found, at


def shape_entries(payload: bytes) -> list[tuple[int, int, dict[str, str]]]:
    """entry, model and attributes of a shape node's models."""
    _, at = read_dict(payload, 4)
    (n,), found = struct.unpack_from("<I", payload, at), []
    at += 4
    for i in range(n):
        (model,) = struct.unpack_from("<I", payload, at)
        attributes, at = read_dict(payload, at + 4)
        found.append((i, model, attributes))
    return found


def _per_file(files: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from make(path.rsplit("/", 1)[-1], bytes(content))

    return files.select("path", "content").mapInPandas(run, schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def model_voxels(found: DataFrame) -> DataFrame:
    """scene, model, x, y, z, colour of all models, in the file's axes (z up)."""

    def make(scene: str, content: bytes):
        for m, payload in enumerate(p for k, p in chunks(content) if k == "XYZI"):
            (n,) = struct.unpack_from("<I", payload)
            v = np.frombuffer(payload, np.uint8, 4 * n, 4).reshape(n, 4).astype(np.int32)
            yield pd.DataFrame({"scene": scene, "model": np.full(n, m, np.int32), "seq": np.arange(n, dtype=np.int32), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2], "colour": v[:, 3]})

    return _per_file(found, "scene string, model int, seq int, x int, y int, z int, colour int", make)


def sizes(found: DataFrame) -> DataFrame:
    """scene and size of every model, in the file's axes."""

    def make(scene: str, content: bytes):
        rows = [(scene, *struct.unpack_from("<III", p)) for k, p in chunks(content) if k == "SIZE"]
        yield pd.DataFrame(rows, columns=["scene", "sx", "sy", "sz"])

    return _per_file(found, "scene string, sx int, sy int, sz int", make)


def max_dimensions(found: DataFrame) -> DataFrame:
    return sizes(found).groupBy("scene").agg(F.max("sx").alias("sx"), F.max("sy").alias("sy"), F.max("sz").alias("sz"))


def palettes(found: DataFrame) -> DataFrame:
    """scene, colour (1 to 255), r, g, b: a file's palette or the built-in one. An index of 0 has no colour."""

    def make(scene: str, content: bytes):
        own = [p for k, p in chunks(content) if k == "RGBA"]
        rgb = np.frombuffer(own[-1], np.uint8, 1024).reshape(256, 4)[:255, :3] if own else np.array(default_palette()[:255])
        yield pd.DataFrame({"scene": scene, "colour": np.arange(1, 256, dtype=np.int32), "r": rgb[:, 0].astype(np.int32), "g": rgb[:, 1].astype(np.int32), "b": rgb[:, 2].astype(np.int32)})

    return _per_file(found, "scene string, colour int, r int, g int, b int", make)


def entries(found: DataFrame) -> DataFrame:
    """scene, entry, model and attributes of the first shape node; later nodes are left out."""

    def make(scene: str, content: bytes):
        nodes = [p for k, p in chunks(content) if k == "nSHP"]
        if not nodes or not (rows := shape_entries(nodes[0])):
            raise ValueError(f"{scene}: no shape node with animation data")
        yield pd.DataFrame([(scene, *r) for r in rows], columns=["scene", "entry", "model", "attributes"])

    return _per_file(found, "scene string, entry int, model int, attributes map<string,string>", make)


def frame_of(attributes: str, entry: Column) -> Column:
    """The frame that a model is shown at: its attribute `_f` as a number (0 if it isn't one), or its entry where there is none."""
    digits = F.regexp_extract(F.coalesce(F.try_element_at(attributes, F.lit("_f")), F.lit("")), r"^\s*([+-]?\d+)", 1)
    return F.when(F.map_contains_key(attributes, "_f"), F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))).otherwise(entry)


def load(found: DataFrame, box: tuple[tuple[int, int, int], tuple[int, int, int]]) -> DataFrame:
    """Voxels of animations, y up, in an inclusive box of the file's axes; the last voxel of a cell holds."""
    (x0, y0, z0), (x1, y1, z1) = box
    shown = entries(found).withColumn("frame", frame_of("attributes", F.col("entry"))).groupBy("scene", "frame").agg(F.max_by("model", "entry").alias("model"))
    voxels = model_voxels(found).where(f"x between {x0} and {x1} and y between {y0} and {y1} and z between {z0} and {z1}")
    last = voxels.groupBy("scene", "model", "x", "y", "z").agg(F.max_by("colour", "seq").alias("colour"))
    # a palette has 255 rows a file
    coloured = last.join(palettes(found), ["scene", "colour"])
    rows = fill_frames(shown).join(coloured, ["scene", "model"])
    cells = {"x": F.col("x") - x0, "y": F.col("z") - z0, "z": F.col("y") - y0}
    return rows.select("scene", "frame", *(c.cast("int").alias(n) for n, c in cells.items()), "r", "g", "b")
