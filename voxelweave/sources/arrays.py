"""Dense arrays as voxels: numpy frames of floats or bytes, and flat arrays with x fastest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import quantise_truncated
from ..operators.volumes import checked_dims, permuted

AXES = ("x", "y", "z")
SCHEMA = "scene string, frame int, x int, y int, z int, r int, g int, b int"


def numpy_frame(spark: SparkSession, array: np.ndarray, scene: str, frame: int, axes: tuple[str, str, str] = AXES) -> DataFrame:
    """Voxels of an array (X, Y, Z, 4) of RGBA, float in 0..1 (clamped, truncated) or uint8; alpha 0 is empty. Only filled cells leave the driver."""
    if array.ndim != 4 or array.shape[3] != 4:
        raise ValueError("an array has the shape (X, Y, Z, 4)")
    if array.dtype.kind == "f":
        array = (np.clip(array.astype(np.float32), 0, 1) * np.float32(255)).astype(np.uint8)
    elif array.dtype != np.uint8:
        raise ValueError("an array holds floats or uint8")
    shape = dict(zip(AXES, array.shape[:3], strict=True))
    checked_dims(*(shape[a] for a in axes))
    at = np.argwhere(array[..., 3] > 0)
    rgb = array[tuple(at.T)][:, :3]
    import pandas as pd

    rows = pd.DataFrame(np.concatenate((at, rgb), axis=1).astype(np.int32), columns=[*AXES, "r", "g", "b"])
    rows.insert(0, "frame", np.full(len(rows), frame, np.int32))
    rows.insert(0, "scene", scene)
    return permuted(spark.createDataFrame(rows, SCHEMA), axes)


def dense_cells(cells: DataFrame) -> DataFrame:
    """Voxels of a relation scene, frame, x, y, z, cr, cg, cb, ca of colour shares."""
    q = {c: quantise_truncated(F.col(f"c{c}")) for c in "rgba"}
    rows = cells.select("scene", "frame", *AXES, *(v.alias(c) for c, v in q.items()))
    return rows.where("a <> 0").drop("a")


def flat_arrays(frames: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Voxels of frames(scene, frame, colours: array of structs r, g, b, a), cell i at x + y X + z X Y. Alpha counts as it is: only 0 is empty."""
    w, h, _ = dims
    rows = frames.select("scene", "frame", F.posexplode("colours").alias("i", "c")).where("c.a <> 0")
    at = {"x": F.col("i") % w, "y": F.floor(F.col("i") / w) % h, "z": F.floor(F.col("i") / (w * h))}
    return rows.select("scene", "frame", *(v.cast("int").alias(a) for a, v in at.items()), *(quantise_truncated(F.col(f"c.{c}")).alias(c) for c in "rgb"))


def filled_arrays(cells: DataFrame, size: int, none: Column) -> DataFrame:
    """frames(scene, frame, colours) of cells(scene, frame, i, c): an array of `size` places, `none` where no cell is.

    The cells in order, with the gap before each and after the last filled in, so a frame takes time in proportion to its size.
    """
    by = cells.groupBy("scene", "frame").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("cells"))
    before = F.concat(F.array(F.lit(-1)), F.transform("cells", lambda e: e["i"].cast("int")))

    def piece(last: Column, e: Column) -> Column:
        # the list of places before is one longer: its last has no cell, but the gap after it
        gap = F.array_repeat(none, F.coalesce(e["i"].cast("int"), F.lit(size)) - last - 1)
        return F.when(e.isNull(), gap).otherwise(F.concat(gap, F.array(e["c"])))

    return by.select("scene", "frame", F.flatten(F.zip_with(before, F.col("cells"), piece)).alias("colours"))
