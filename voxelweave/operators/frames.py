"""Order in time and along bricks: groups of pictures, deltas, runs, differences between frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import BRICK, CELLS, addressed
from .bricks import CELL, COLOUR, FRAME


def in_brick():
    return Window.partitionBy(*FRAME, *BRICK).orderBy("vi")


def gop_of(frame: Column, gop: int) -> Column:
    return F.floor(frame / gop).cast("long")


def frame_type(frame: Column, gop: int) -> Column:
    return F.when(F.pmod(frame, F.lit(gop)) == 0, "I").otherwise("P")


def frame_index(frames: DataFrame, gop: int) -> DataFrame:
    """scene, frame: with type, group of pictures, and whether the frame can be freed once encoded."""
    f = F.col("frame")
    return frames.select("scene", "frame", frame_type(f, gop).alias("type"), gop_of(f, gop).alias("gop"), (F.pmod(f + 1, F.lit(gop)) == 0).alias("can_free"))


def key_frames(index: DataFrame) -> DataFrame:
    """The I-frame at or before, and at or after, each frame; -1 for none."""
    order = Window.partitionBy("scene").orderBy("frame")
    key = F.when(F.col("type") == "I", F.col("frame"))
    before = F.last(key, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(key, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return index.select("scene", "frame", "type", F.coalesce(before, F.lit(-1)).cast("long").alias("prev_i"), F.coalesce(after, F.lit(-1)).cast("long").alias("next_i"))


def dependencies(index: DataFrame, recursive: bool) -> DataFrame:
    """Frames that each P-frame needs: the one before, or all back to its I-frame."""
    rows = key_frames(index).where("type = 'P'")
    needs = F.sequence(F.col("prev_i"), F.col("frame").cast("long") - 1) if recursive else F.array(F.col("frame").cast("long") - 1)
    return rows.select("scene", "frame", F.explode(needs).alias("needs"))


def missing_dependencies(index: DataFrame) -> DataFrame:
    """P-frames whose frame before isn't there."""
    have = index.select("scene", F.col("frame").cast("long").alias("needs"))
    return dependencies(index, False).join(have, ["scene", "needs"], "left_anti")


def intra_deltas(voxels: DataFrame) -> DataFrame:
    """Colour differences, modulo 256, from the voxel before in the brick; the first is as it is."""
    rows = addressed(voxels)
    return rows.withColumns({f"d{c}": F.pmod(F.col(c) - F.lag(c, 1, 0).over(in_brick()), F.lit(256)) for c in COLOUR}).select(*FRAME, *BRICK, "vi", "dr", "dg", "db")


def intra_colours(deltas: DataFrame) -> DataFrame:
    """The inverse: running sums modulo 256."""
    order = in_brick().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select(*FRAME, *BRICK, "vi", *(F.pmod(F.sum(f"d{c}").over(order), F.lit(256)).cast("int").alias(c) for c in COLOUR))


def runs(cells: DataFrame, place: str = "vi") -> DataFrame:
    """Maximal runs of filled places of each brick: start, length, and bytes when a byte holds 127 places."""
    w = Window.partitionBy(*FRAME, *BRICK).orderBy(place)
    island = cells.withColumn("island", F.col(place) - F.row_number().over(w))
    by = island.groupBy(*FRAME, *BRICK, "island").agg(F.min(place).cast("long").alias("start"), F.count("*").alias("len"))
    return by.withColumn("bytes", F.ceil(F.col("len") / 127).cast("long")).drop("island")


def all_runs(cells: DataFrame) -> DataFrame:
    """Runs of filled and of empty places that together cover a brick."""
    filled = runs(cells).withColumn("filled", F.lit(1))
    w = Window.partitionBy(*FRAME, *BRICK).orderBy("start")
    stop = F.col("start") + F.col("len")
    following = F.coalesce(F.lead("start").over(w), F.lit(CELLS).cast("long"))
    gaps = filled.select(*FRAME, *BRICK, F.row_number().over(w).alias("nth"), F.col("start").alias("first"), stop.alias("start"), (following - stop).alias("len"))
    head = gaps.where("nth = 1").select(*FRAME, *BRICK, F.lit(0).cast("long").alias("start"), F.col("first").alias("len"))
    empty = gaps.select(*FRAME, *BRICK, "start", "len").unionByName(head).where("len > 0")
    empty = empty.withColumn("bytes", F.ceil(F.col("len") / 127).cast("long")).withColumn("filled", F.lit(0))
    return filled.unionByName(empty)


def expand_runs(found: DataFrame) -> DataFrame:
    """The filled places of runs."""
    return found.where("filled = 1").select(*FRAME, *BRICK, F.explode(F.sequence(F.col("start").cast("int"), (F.col("start") + F.col("len") - 1).cast("int"))).alias("vi"))


def changes(voxels: DataFrame) -> DataFrame:
    """Cells filled in a frame or the one before: filled, was (0/1), colours now and before (0 if empty).

    One window over each cell's frames serves both sides of what would be a full outer join with the frame before.
    """
    w = Window.partitionBy("scene", *CELL).orderBy("frame")
    was = F.coalesce(F.lag("frame").over(w) == F.col("frame") - 1, F.lit(False))
    stays = F.coalesce(F.lead("frame").over(w) == F.col("frame") + 1, F.lit(False))
    rows = voxels.select("*", was.alias("was"), stays.alias("stays"), *(F.when(was, F.lag(c).over(w)).otherwise(0).alias(f"p{c}") for c in COLOUR))
    now = F.struct("frame", F.lit(1).alias("filled"), F.col("was").cast("int").alias("was"), *COLOUR, *(f"p{c}" for c in COLOUR))
    gone = F.struct((F.col("frame") + 1).alias("frame"), F.lit(0).alias("filled"), F.lit(1).alias("was"), *(F.lit(0).alias(c) for c in COLOUR), *(F.col(c).alias(f"p{c}") for c in COLOUR))
    both = F.when(F.col("stays"), F.array(now)).otherwise(F.array(now, gone))
    return rows.select("scene", *CELL, F.explode(both).alias("e")).select("scene", "e.frame", *CELL, "e.filled", "e.was", *(f"e.{p}{c}" for p in ("", "p") for c in COLOUR))


def brick_modes(voxels: DataFrame, gop: int) -> DataFrame:
    """Bricks with voxels: voxels, changed cells, and I or P coding without motion.

    A brick of a P-frame is coded by itself when at least half of its voxels, rounded down, changed.
    """
    by = addressed(changes(voxels)).groupBy(*FRAME, *BRICK).agg(F.sum("filled").alias("n_voxels"), F.sum((F.col("filled") != F.col("was")).cast("int")).alias("n_changed")).where("n_voxels > 0")
    intra = (F.pmod("frame", F.lit(gop)) == 0) | (F.col("n_changed") >= F.floor(F.col("n_voxels") / 2))
    return by.withColumn("mode", F.when(intra, "I").otherwise("P"))


def change_runs(voxels: DataFrame) -> DataFrame:
    """Runs of the cells whose filling changed since the frame before."""
    rows = addressed(changes(voxels).where("filled <> was"))
    have = addressed(voxels).select(*FRAME, *BRICK).distinct()
    return runs(rows.join(have, [*FRAME, *BRICK], "left_semi"))


def residuals(voxels: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Colour differences, modulo 256, from the frame before, at the cell a brick's motion vector points to; as they are where that was empty.

    vectors: scene, frame, brick, dx, dy, dz; none: no motion.
    """
    if vectors is None:
        rows = addressed(changes(voxels).where("filled = 1"))
        return rows.select(*FRAME, *BRICK, "vi", *(F.pmod(F.col(c) - F.col(f"p{c}"), F.lit(256)).alias(f"d{c}") for c in COLOUR))
    rows = addressed(voxels).join(vectors, [*FRAME, *BRICK], "left").fillna(0, ["dx", "dy", "dz"])
    before = voxels.select("scene", (F.col("frame") + 1).alias("frame"), *(F.col(a).alias(f"q{a}") for a in CELL), *(F.col(c).alias(f"p{c}") for c in COLOUR))
    # by a merge: the frames before are as many as the voxels, whatever the planner takes them for
    rows = rows.withColumns({f"q{a}": F.col(a) + F.col(f"d{a}") for a in CELL}).join(before.hint("merge"), [*FRAME, "qx", "qy", "qz"], "left")
    return rows.select(*FRAME, *BRICK, "vi", *(F.pmod(F.col(c) - F.coalesce(F.col(f"p{c}"), F.lit(0)), F.lit(256)).alias(f"d{c}") for c in COLOUR))


def concat(streams: list[DataFrame], rates: list[float] | None = None, scene: str = "joined", counts: list[int] | None = None) -> DataFrame:
    """Streams one after the other under one scene: frames are renumbered by the counts before.

    counts says how many frames each stream has, empty ones at its end included; without it a stream ends with its last voxel, which takes a job each.
    """
    import warnings

    if rates and max(rates) - min(rates) > 0.1:
        warnings.warn("frame rates differ; the first stream's holds", stacklevel=2)
    if counts is None:
        counts = [s.agg((F.max("frame") + 1).alias("n")).first()["n"] or 0 for s in streams]
    out, start = None, 0
    for s, n in zip(streams, counts, strict=True):
        part = s.withColumn("frame", (F.col("frame") + start).cast("int")).withColumn("scene", F.lit(scene))
        out = part if out is None else out.unionByName(part)
        start += n
    return out


def split(voxels: DataFrame, seconds: float, rate: float) -> DataFrame:
    """Voxels with their part, of whole frames in `seconds`, and their frame in it."""
    import numpy as np

    size = int(np.float32(seconds) * np.float32(rate))
    if size < 1:
        raise ValueError("a part would have no frame")
    return voxels.withColumn("part", F.floor(F.col("frame") / size).cast("long")).withColumn("part_frame", F.pmod("frame", F.lit(size)).cast("long"))


def occupancy_difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """Cells filled in just one of two relations."""
    keys = [*FRAME, *CELL]
    rows = one.select(*keys, F.lit(1).alias("s")).union(other.select(*keys, F.lit(2).alias("s")))
    return rows.groupBy(*keys).agg(F.bit_or("s").alias("s")).where("s < 3").select(*keys, F.when(F.col("s") == 1, "first").otherwise("second").alias("only_in"))


def fill_frames(entries: DataFrame) -> DataFrame:
    """entries: scene, frame, model. Every frame up to the last: gaps repeat the model before, frames before the first take the first."""
    by = entries.groupBy("scene").agg(F.max("frame").alias("last"))
    grid = by.select("scene", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("frame"))
    order = Window.partitionBy("scene").orderBy("frame")
    rows = grid.join(entries, ["scene", "frame"], "left")
    before = F.last("model", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("model", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.select("scene", "frame", F.coalesce(before, after).alias("model"))
