"""Blocks of cells and frames with a halo: what a task has to see of a relation to compute its own cells.

A voxel goes to the block that it lies in and to those that it is within reach of, so the shuffle has each voxel little more than once, however many
neighbours a cell asks for, and a task holds one block at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bricks import CELL

#: Frames, and cells along each axis, of a block. Cells are a multiple of a brick's side.
FRAMES, SIDE = 8, 32
AXES = ("frame", *CELL)
SIZE = (FRAMES, SIDE, SIDE, SIDE)
KEYS = ("scene", *(f"k{a}" for a in AXES))
Reach = tuple[int, int, int, int]


def haloed(rows: DataFrame, reach: Reach, ahead: bool = False) -> DataFrame:
    """Rows of scene, frame, x, y, z with the keys of each block they are needed by.

    reach: how far a block sees past its sides, along frame, x, y and z; along frames just backwards if ahead, so that a frame's voxels go to those after it.
    """
    for a, n, r in zip(AXES, SIZE, reach, strict=True):
        low: Column = F.col(a) - (0 if ahead and a == "frame" else r)
        blocks = F.sequence(F.floor(low / n).cast("int"), F.floor((F.col(a) + r) / n).cast("int"))
        rows = rows.withColumn(f"k{a}", F.explode(blocks))
    return rows


def placed(block: pa.Table, reach: Reach) -> tuple[np.ndarray, tuple[int, ...], np.ndarray]:
    """Of a block's rows: frame and cell at the low corner of the block with its halo, the shape of that, and each row's place in it."""
    origin = np.array([block.column(f"k{a}")[0].as_py() * n - r for a, n, r in zip(AXES, SIZE, reach, strict=True)], dtype=np.int64)
    shape = tuple(n + 2 * r for n, r in zip(SIZE, reach, strict=True))
    at = np.zeros(block.num_rows, dtype=np.int64)
    for a, low, n in zip(AXES, origin, shape, strict=True):
        at = at * n + (block.column(a).to_numpy().astype(np.int64) - low)
    return origin, shape, at


def core(reach: Reach) -> tuple[slice, ...]:
    """A block without its halo."""
    return tuple(slice(r, r + n) for n, r in zip(SIZE, reach, strict=True))


def filled_cells(at: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    filled = np.zeros(reduce(mul, shape), dtype=bool)
    filled[at] = True
    return filled.reshape(shape)


def listed(block: pa.Table, columns: dict[str, np.ndarray], schema: pa.Schema) -> pa.Table:
    """A block's results under its scene, in batches of 10,000 rows."""
    n = len(next(iter(columns.values())))
    arrays = [pa.repeat(block.column("scene")[0], n) if f.name == "scene" else pa.array(columns[f.name], f.type) for f in schema]
    return pa.Table.from_batches(pa.Table.from_arrays(arrays, schema=schema).to_batches(10_000), schema)
