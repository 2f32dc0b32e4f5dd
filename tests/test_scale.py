"""Steps whose size the planner has to see, or that have to stay in proportion to the voxels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import blocks, frames, motion, neighbours
from voxelweave.plans import catalog, scenes
from voxelweave.sources import arrays

DATA = "/root/testdata/sf0.001"


def test_moving_scene_is_not_taken_for_small(spark):
    m = scenes.moving(spark, DATA)
    estimate = int(str(m._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate >= m.count() * 8 * 4


def test_frame_before_is_not_broadcast(spark):
    cells = spark.range(1).select(F.lit("S").alias("scene"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("frame"), *(F.lit(k).alias(k_) for k, k_ in enumerate("xyzrgb")))
    vectors = spark.createDataFrame([("S", 1, 0, 0, 0, 1, 0, 0)], "scene string, frame int, bx int, by int, bz int, dx int, dy int, dz int")
    plan = frames.residuals(cells, vectors)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "qx" in line and "SortMergeJoin" in line]
    assert not [line for line in plan.splitlines() if "qx" in line and "BroadcastHashJoin" in line]


def test_flat_frames_are_filled_without_a_search_a_cell(spark):
    plan = catalog.queries()["flat_array_frames"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "mapfromentries" not in plan


def test_gaps_of_flat_frames_are_filled(spark):
    cells = spark.createDataFrame([("S", 0, i, i + 10) for i in (3, 1, 7)] + [("S", 1, i, i) for i in range(8)] + [("S", 2, 0, 5)], "scene string, frame int, i int, c int")
    got = {r["frame"]: r["colours"] for r in arrays.filled_arrays(cells, 8, F.lit(0)).collect()}
    assert got == {0: [0, 11, 0, 13, 0, 0, 0, 17], 1: list(range(8)), 2: [5] + [0] * 7}


def test_stencils_do_not_multiply_the_rows_before_a_shuffle(spark):
    """A voxel inside a block is sent once for 19 cells."""
    cells = spark.range(4096).select(F.lit("S").alias("scene"), F.lit(1).alias("frame"), *(((F.col("id") / 16**k).cast("int") % 16 + 8).alias(a) for k, a in enumerate("xyz")), (F.col("id") % 251).alias("r"))
    assert blocks.haloed(cells, (0, 1, 1, 1)).count() == 4096
    for f in (neighbours.curvature, neighbours.weno_norms, neighbours.gradients, neighbours.closest_points):
        plan = f(cells, F.col("r"))._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan and "FlatMapGroupsInArrow" in plan


def test_stencils_look_across_blocks_and_take_odd_values(spark):
    at = [("S", 7, 31, 0, -1, 1.0), ("S", 7, 32, 0, -1, 2.0), ("S", 8, 32, 0, -1, 3.0), ("S", 7, 33, 0, -1, None), ("S", 7, 32, -1, -1, float("nan")), ("S", 7, 32, 0, -1, 0.5), ("T", 7, 31, 0, -1, 9.0)]
    voxels = spark.createDataFrame(at, "scene string, frame int, x int, y int, z int, v double")
    got = neighbours.gathered(voxels, F.col("v"), {"xm": (-1, 0, 0), "x40": (-40, 0, 0), "xp": (1, 0, 0), "ym": (0, -1, 0)}, -1.0)
    rows = {(r["scene"], r["frame"], r["x"], r["y"], r["z"]): [str(r[c]) for c in ("v", "xm", "x40", "xp", "ym")] for r in got.collect()}
    assert rows == {
        ("S", 7, 31, 0, -1): ["1.0", "-1.0", "-1.0", "2.0", "-1.0"], ("S", 7, 32, 0, -1): ["2.0", "1.0", "-1.0", "-1.0", "nan"], ("S", 8, 32, 0, -1): ["3.0", "-1.0", "-1.0", "-1.0", "-1.0"],
        ("S", 7, 32, -1, -1): ["nan", "-1.0", "-1.0", "-1.0", "-1.0"], ("T", 7, 31, 0, -1): ["9.0", "-1.0", "-1.0", "-1.0", "-1.0"],
    }


def test_near_motion_sends_a_voxel_once_a_block(spark):
    """Voxels go to the blocks of their frame and of the next, not to a cell for each of 27 vectors."""
    cells = spark.range(4096).select(F.lit("S").alias("scene"), F.lit(1).alias("frame"), *(((F.col("id") / 16**k).cast("int") % 16 + 8).alias(a) for k, a in enumerate("xyz")), *(F.lit(1).alias(c) for c in "rgb"))
    assert blocks.haloed(cells, (1, 1, 1, 1), ahead=True).count() == 4096
    assert blocks.haloed(cells.withColumn("frame", F.lit(7)), (1, 1, 1, 1), ahead=True).count() == 2 * 4096
    plan = motion.near_costs(cells)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join [scene" not in plan.replace("BroadcastHashJoin [scene", "")


def test_near_costs_across_blocks_and_gaps_of_frames(spark):
    """Against the costs counted cell by cell, over block borders, negative cells, a missing frame and two scenes."""
    random = np.random.default_rng(5)
    cells = {(s, f, *(int(v) for v in random.integers(-10, 42, 3))): tuple(int(v) for v in random.integers(0, 256, 3)) for s in "ST" for f in (6, 7, 8, 10) for _ in range(400)}
    cells |= {("S", f, 31 + f - 7, 8, 8): (9, f, 0) for f in (7, 8)}
    voxels = spark.createDataFrame([(*k, *c) for k, c in cells.items()], "scene string, frame int, x int, y int, z int, r int, g int, b int")
    want = {}
    for (s, f, *p), c in cells.items():
        if f > 6:
            for d in motion.VECTORS:
                b = tuple(v // 8 for v in p)
                was = cells.get((s, f - 1, *(v + w for v, w in zip(p, d))))
                want[s, f, *b, *d] = want.get((s, f, *b, *d), 0) + (768 if was is None else sum(abs(v - w) for v, w in zip(c, was)))
    for (s, f, *p), _ in cells.items():
        for d in motion.VECTORS:
            q = tuple(v - w for v, w in zip(p, d))
            if (k := (s, f + 1, *(v // 8 for v in q), *d)) in want and (s, f + 1, *q) not in cells:
                want[k] += 768
    got = {tuple(r[:-1]): r["cost"] for r in motion.near_costs(voxels).collect()}
    assert got == want
    best = {tuple(r[:5]): tuple(r[5:]) for r in motion.best_near(voxels).collect()}
    order = lambda d, c: (c, d != (0, 0, 0), d[2], d[1], d[0])
    assert best == {b: (*min((order(k[5:], c), k[5:]) for k, c in want.items() if k[:5] == b)[1], min(c for k, c in want.items() if k[:5] == b)) for b in {k[:5] for k in want}}


def below_shuffles(df) -> list[str]:
    """Of a plan, what runs before the first shuffle, by branch."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    steps = [(len(line) - len(line.lstrip(" :+-*|")), line) for line in plan]
    leaves = [k for k, (_, line) in enumerate(steps) if "FileScan" in line and "lineitem" in line]
    found = []
    for k in leaves:
        above, depth = [], steps[k][0]
        for d, line in reversed(steps[:k]):
            if d < depth:
                if "Exchange" in line:
                    break
                above.append(line)
                depth = d
        found.append("\n".join(above))
    return found


@pytest.mark.parametrize("name", ["weno_norms", "principal_curvatures", "near_motion_costs"])
def test_dense_scene_is_not_added_up_before_its_shuffle(spark, name):
    """A task's rows lie in nearly as many cells, so it would hold them all, and save little."""
    for query in (scenes.dense, catalog.queries()[name]):
        below = below_shuffles(query(spark, DATA))
        assert below and not [b for b in below if "Aggregate" in b]


def test_principal_curvatures_look_in_blocks(spark):
    """Their 19 cells come from an array of the block, not from as many rows and an aggregate."""
    plan = catalog.queries()["principal_curvatures"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not [line for line in plan.splitlines() if "Aggregate" in line and "xpyp" in line]
