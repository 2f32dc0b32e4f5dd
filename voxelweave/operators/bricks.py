"""Grouping of voxels: writes, bricks, frames, sizes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import BRICK, BRICK_BYTES, addressed, bit, map_index, map_words

FRAME = ("scene", "frame")
CELL = ("x", "y", "z")
COLOUR = ("r", "g", "b")


def last_write(writes: DataFrame, order: str = "seq") -> DataFrame:
    """One voxel per cell: the colour written last."""
    last = F.max_by(F.struct(*COLOUR), F.col(order)).alias("c")
    return writes.groupBy(*FRAME, *CELL).agg(last).select(*FRAME, *CELL, "c.*")


def edited(voxels: DataFrame, fill: DataFrame, empty: DataFrame) -> DataFrame:
    """Voxels after filling some cells and then emptying others."""
    both = voxels.withColumn("seq", F.lit(0)).unionByName(fill.withColumn("seq", F.lit(1)))
    return last_write(both).join(empty.select(*FRAME, *CELL), [*FRAME, *CELL], "left_anti")


def bricks(voxels: DataFrame) -> DataFrame:
    """Each brick's voxel count."""
    return addressed(voxels).groupBy(*FRAME, *BRICK).agg(F.count("*").alias("n_voxels"))


def brick_arrays(voxels: DataFrame) -> DataFrame:
    """Each brick's voxels in order of place; a brick has 512 at most."""
    return addressed(voxels).groupBy(*FRAME, *BRICK).agg(F.sort_array(F.collect_list(F.struct("vi", *COLOUR))).alias("voxels"))


def frame_counts(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy(*FRAME).agg(F.count("*").alias("n_voxels"))


def frame_sizes(voxels: DataFrame, map_cells: int) -> DataFrame:
    """Bytes of each frame in memory: 8 a map cell, and its bricks; from brick counts, so voxels are summed before the shuffle."""
    by = bricks(voxels).groupBy(*FRAME).agg(F.count("*").alias("n_bricks"), F.sum("n_voxels").alias("n_voxels"))
    return by.select(*FRAME, "n_bricks", "n_voxels", (F.lit(8 * map_cells) + F.col("n_bricks") * BRICK_BYTES).alias("bytes"))


def size_report(voxels: DataFrame, map_cells: int) -> DataFrame:
    """Raw sizes of each scene: dense cells, bricks, and voxels of nine bytes."""
    by = frame_sizes(voxels, map_cells).groupBy("scene")
    return by.agg(F.count("*").alias("frames"), (F.count("*") * map_cells * 512 * 3).alias("dense_bytes"), F.sum("bytes").alias("brick_bytes"), (F.sum("n_voxels") * 9).alias("voxel_bytes"))


def occupancy(voxels: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    """Each frame's map: 32-bit words with a bit for each brick that isn't empty."""
    at = bricks(voxels).select(*FRAME, map_index(width, height).cast("long").alias("i"))
    word = at.groupBy(*FRAME, F.floor(F.col("i") / 32).alias("word")).agg(F.bit_or(bit(F.col("i"), 32)).alias("bits"))
    return word.withColumn("words", map_words(F.lit(width * height * depth)))


def ordinals(voxels: DataFrame) -> DataFrame:
    """Bricks with their place in their frame, in order of x, y, z (z runs fastest), and how many there are."""
    by = Window.partitionBy(*FRAME)
    order = by.orderBy(*BRICK)
    return bricks(voxels).select("*", (F.row_number().over(order) - 1).cast("long").alias("i"), F.count("*").over(by).alias("n"))


def group_of(i: Column, n: Column, most: int) -> Column:
    """The balanced group of brick i of n: the first groups take the remainder."""
    if most == 0:
        return F.lit(0).cast("long")
    groups = F.ceil(n / most)
    base, rest = F.floor(n / groups), n % groups
    head = rest * (base + 1)
    return F.when(i < head, F.floor(i / (base + 1))).otherwise(rest + F.floor((i - head) / F.greatest(base, F.lit(1)))).cast("long")


def brick_groups(voxels: DataFrame, most: int) -> DataFrame:
    """Each brick's group, its voxel offset in the frame, and its group's totals."""
    rows = ordinals(voxels).withColumn("grp", group_of(F.col("i"), F.col("n"), most))
    before = Window.partitionBy(*FRAME).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("n_voxels").over(before), F.lit(0)).cast("long"))


def group_totals(voxels: DataFrame, most: int) -> DataFrame:
    return brick_groups(voxels, most).groupBy(*FRAME, "grp").agg(F.count("*").alias("n_bricks"), F.sum("n_voxels").alias("n_voxels"), F.min("offset").alias("offset"))


def statistics(voxels: DataFrame, value: Column, keys: tuple[str, ...]) -> DataFrame:
    """Count, extremes, mean, population variance and deviation of a value, and the bounding box, by node; partial sums merge."""
    return addressed(voxels).withColumn("value", value.cast("double")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("deviation"),
        *(f(a).cast("long").alias(f"{n}_{a}") for a in CELL for n, f in (("min", F.min), ("max", F.max))),
    )


def tree_statistics(voxels: DataFrame, value: Column) -> DataFrame:
    """The statistics at every level of the tree: brick, frame, scene (a rollup)."""
    rows = addressed(voxels).withColumn("value", value.cast("double")).withColumn("brick", F.concat_ws(",", *BRICK))
    by = rows.rollup("scene", "frame", "brick").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    return by.where("level < 7")


def bounds(voxels: DataFrame) -> DataFrame:
    """Active voxels and inclusive bounding box of each frame."""
    return voxels.groupBy(*FRAME).agg(F.count("*").alias("n"), *(f(a).cast("long").alias(f"{n}_{a}") for a in CELL for n, f in (("min", F.min), ("max", F.max))))


def checksums(voxels: DataFrame) -> DataFrame:
    """A CRC-32 of each brick's ordered cells and of their colours."""
    rows = brick_arrays(voxels)
    words = [F.concat_ws(",", F.transform("voxels", lambda v: v["vi"].cast("string"))), F.concat_ws(",", F.transform("voxels", lambda v: F.concat_ws(":", v["r"], v["g"], v["b"])))]
    return rows.select(*FRAME, *BRICK, F.crc32(words[0]).alias("cells_crc32"), F.crc32(words[1]).alias("colours_crc32"))


def symbol_table(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Frequencies of bytes and the end mark 256, with their exclusive running sums; 257 rows at most meet in one place."""
    found = symbols.groupBy(F.col(symbol).cast("int").alias("symbol")).agg(F.count("*").alias("freq"))
    end = symbols.sparkSession.createDataFrame([(256, 1)], "symbol int, freq long")
    order = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.unionByName(end).withColumn("cum", (F.sum("freq").over(order) - F.col("freq")).cast("long"))


def symbol_at(table: DataFrame, values: DataFrame, value: str = "v") -> DataFrame:
    """The symbol whose range of the running sums holds each value. The table has 257 rows at most, so it is broadcast."""
    t, v = F.broadcast(table), F.col(value)
    return values.join(t, (v >= t["cum"]) & (v < t["cum"] + t["freq"])).select(*values.columns, "symbol")


def compact(voxels: DataFrame) -> DataFrame:
    """The compact frame: for each brick its bitmap words, and its voxels' offset in the frame's packed array."""
    rows = addressed(voxels).groupBy(*FRAME, *BRICK).agg(F.count("*").alias("n_voxels"), *(F.bit_or(F.when(F.floor(F.col("vi") / 32) == k, bit(F.col("vi"), 32))).alias(f"w{k}") for k in range(16)))
    before = Window.partitionBy(*FRAME).orderBy(*BRICK).rowsBetween(Window.unboundedPreceding, -1)
    words = F.array(*(F.coalesce(f"w{k}", F.lit(0).cast("long")) for k in range(16)))
    return rows.select(*FRAME, *BRICK, "n_voxels", words.alias("bitmap"), F.coalesce(F.sum("n_voxels").over(before), F.lit(0)).cast("long").alias("offset"))
