"""Motion search between a frame's bricks and the frame before.

The cost of a vector is 768 for each cell filled in just one of the brick and the shifted frame before, and the sum of colour differences where both
are. near_costs() gives the 27 nearest vectors' costs, in blocks with a halo. search() makes the whole hierarchical search: bricks go to
tasks with the cells of the frame before that a vector may reach, some bricks at a time.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.address import BRICK, SIDE
from . import blocks
from .bricks import CELL, COLOUR, FRAME

#: Cost of a cell that is filled on one side alone.
MISMATCH = 3 * 256
#: Farthest that the search goes along an axis: 4 + 2 + 1.
REACH = 7
VECTOR = ("dx", "dy", "dz")
VECTORS = tuple(product((-1, 0, 1), repeat=3))


def near_costs(voxels: DataFrame) -> DataFrame:
    """Cost of each vector in {-1, 0, 1}^3 of each brick of a frame that isn't its scene's first.

    Voxels go to the blocks that see them, in their frame and the next; a block compares its frames with those before under each vector.
    """
    reach = (1, 1, 1, 1)
    rows = voxels.select(*FRAME, *CELL, *(F.col(c).cast("int").alias(c) for c in COLOUR)).where("frame is not null")
    schema = T.StructType([*rows.select(*FRAME).schema.fields, *(T.StructField(n, T.IntegerType()) for n in (*BRICK, *VECTOR)), T.StructField("cost", T.LongType())])

    def run(block: pa.Table) -> pa.Table:
        origin, shape, at = blocks.placed(block, reach)
        filled = blocks.filled_cells(at, shape)
        own = blocks.core(reach)
        # the bricks between the least and the greatest that have voxels of the block's own
        n_voxels = by_brick(filled[own])
        bounds = [np.nonzero(n_voxels.any(axis=tuple(b for b in range(4) if b != k)))[0] for k in range(1, 4)]
        bounds = [(int(b[0]), int(b[-1]) + 1) if len(b) else (0, 0) for b in bounds]
        n_voxels = n_voxels[:, *(slice(*b) for b in bounds)]
        colours = np.zeros((*shape, 3), dtype=np.int32)
        colours.reshape(-1, 3)[at] = np.stack([block.column(c).to_numpy() for c in COLOUR], axis=1)

        def seen(grid: np.ndarray, frames: slice, shift: tuple[int, int, int]) -> np.ndarray:
            return grid[frames, *(slice(1 + low * SIDE + d, 1 + high * SIDE + d) for (low, high), d in zip(bounds, shift, strict=True))]

        has = np.nonzero(n_voxels)
        now, colour = seen(filled, own[0], (0, 0, 0)), seen(colours, own[0], (0, 0, 0))
        costs = []
        for d in VECTORS:
            was = seen(filled, slice(0, blocks.FRAMES), d)
            apart = np.abs(seen(colours, slice(0, blocks.FRAMES), d) - colour).sum(axis=-1, dtype=np.int64)
            costs.append(by_brick(np.where(now & was, apart, MISMATCH * (now ^ was)))[has])
        n = len(has[0])
        first_brick = [(low // SIDE + b) for low, (b, _) in zip(origin[1:] + 1, bounds, strict=True)]
        columns = {"frame": np.tile(has[0] + origin[0] + 1, len(VECTORS)), "cost": np.concatenate(costs)}
        columns |= {b: np.tile(i + low, len(VECTORS)) for b, i, low in zip(BRICK, has[1:], first_brick, strict=True)}
        columns |= {v: np.repeat(np.array(VECTORS)[:, k], n) for k, v in enumerate(VECTOR)}
        kept = [block.schema.field(c) for c in FRAME]
        return blocks.listed(block, columns, pa.schema([*kept, *(pa.field(c, pa.int32()) for c in (*BRICK, *VECTOR)), pa.field("cost", pa.int64())]))

    costs = blocks.haloed(rows, reach, ahead=True).groupBy(*blocks.KEYS).applyInArrow(run, schema)
    first = voxels.groupBy("scene").agg(F.min("frame").alias("first"))
    return costs.join(first, "scene").where("frame > first").select(*FRAME, *BRICK, *VECTOR, "cost")


def by_brick(cells: np.ndarray) -> np.ndarray:
    """Sums of whole bricks of an array by frame, x, y and z."""
    f, *sides = cells.shape
    return cells.reshape(f, *(n for s in sides for n in (s // SIDE, SIDE))).sum(axis=(2, 4, 6), dtype=np.int64)


def rank(cost: Column) -> list[Column]:
    """Order of vectors: cost, then the centre, then z, y, x."""
    centre = F.when((F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0), 0).otherwise(1)
    return [cost, centre, F.col("dz"), F.col("dy"), F.col("dx")]


def best_near(voxels: DataFrame) -> DataFrame:
    """Each brick's best vector of the 27 nearest."""
    order = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(rank(F.col("cost")))))
    by = near_costs(voxels).groupBy(*FRAME, *BRICK).agg(F.min_by(F.struct(*VECTOR, "cost"), order).alias("best"))
    return by.select(*FRAME, *BRICK, "best.*")


def search_brick(now: np.ndarray, before: np.ndarray) -> tuple[int, int, int, int]:
    """The hierarchical search. now: (8, 8, 8, 4) of filled, r, g, b by x, y, z; before: the same with REACH cells more on each side."""
    filled, colour = now[..., 0] > 0, now[..., 1:].astype(np.int64)
    seen: dict[tuple[int, int, int], int] = {}

    def cost(d: tuple[int, int, int]) -> int:
        if d not in seen:
            x, y, z = (v + REACH for v in d)
            there = before[x : x + SIDE, y : y + SIDE, z : z + SIDE]
            was = there[..., 0] > 0
            both = filled & was
            seen[d] = MISMATCH * int((filled ^ was).sum()) + int(np.abs(there[..., 1:].astype(np.int64) - colour)[both].sum())
        return seen[d]

    def around(centre: tuple[int, int, int], far: int) -> list[tuple[int, int, int]]:
        return [(centre[0] + x, centre[1] + y, centre[2] + z) for z in (-far, 0, far) for y in (-far, 0, far) for x in (-far, 0, far)]

    def better(best: tuple[int, int, int], options: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        for d in options:
            if cost(d) < cost(best):
                best = d
        return best

    zero = (0, 0, 0)
    best = better(zero, around(zero, 1))
    best = better(best, around(zero, 4))
    if best == zero:
        return *best, cost(best)
    if max(map(abs, best)) <= 1:
        best = better(best, [d for d in around(best, 1) if max(map(abs, d)) > 1])
        return *best, cost(best)
    for far in (2, 1):
        best = better(best, around(best, far))
    return *best, cost(best)


def search(voxels: DataFrame, block: int = 4) -> DataFrame:
    """Motion vector and cost of each brick of a frame that has one before. block: bricks along an axis that a task takes together."""
    size = block * SIDE
    here = [F.floor(F.col(a) / size).cast("int") for a in CELL]
    now = voxels.select(*FRAME, *(h.alias(f"k{a}") for h, a in zip(here, CELL, strict=True)), F.lit(1).alias("now"), *CELL, *COLOUR)
    # a voxel is needed by its own block and by those that it is within REACH of
    reach = [F.array_distinct(F.array(*(F.floor((F.col(a) + s) / size).cast("int") for s in (-REACH, 0, REACH)))) for a in CELL]
    before = voxels.select("scene", (F.col("frame") + 1).alias("frame"), *CELL, *COLOUR)
    for a, keys in zip(CELL, reach, strict=True):
        before = before.withColumn(f"k{a}", F.explode(keys))
    first = voxels.groupBy("scene").agg(F.min("frame").alias("first"))
    rows = now.unionByName(before.withColumn("now", F.lit(0))).join(first, "scene").where("frame > first").drop("first")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        head = rows.iloc[0]
        origin = np.array([head["kx"], head["ky"], head["kz"]]) * size
        grids = []
        for flag, pad in ((1, 0), (0, REACH)):
            own = rows[rows["now"] == flag]
            grid = np.zeros((size + 2 * pad,) * 3 + (4,), dtype=np.int16)
            at = own[list(CELL)].to_numpy() - origin + pad
            inside = ((at >= 0) & (at < size + 2 * pad)).all(axis=1)
            at = at[inside]
            grid[at[:, 0], at[:, 1], at[:, 2], 0] = 1
            grid[at[:, 0], at[:, 1], at[:, 2], 1:] = own[list(COLOUR)].to_numpy()[inside]
            grids.append(grid)
        for b in product(range(block), repeat=3):
            x, y, z = (v * SIDE for v in b)
            mine = grids[0][x : x + SIDE, y : y + SIDE, z : z + SIDE]
            if mine[..., 0].any():
                wide = SIDE + 2 * REACH
                out.append((head["scene"], head["frame"], *(origin // SIDE + b), *search_brick(mine, grids[1][x : x + wide, y : y + wide, z : z + wide])))
        return pd.DataFrame(out, columns=[*FRAME, *BRICK, *VECTOR, "cost"])

    return rows.groupBy(*FRAME, "kx", "ky", "kz").applyInPandas(run, "scene string, frame int, bx int, by int, bz int, dx int, dy int, dz int, cost long")
