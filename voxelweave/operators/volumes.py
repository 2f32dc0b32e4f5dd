"""Volumes without a file: boxes, predicates on them, primitives, bit sets, tree nodes, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.address import BRICK, addressed, bit
from ..functions.vectors import dequantise, quantise
from .bricks import CELL, FRAME

Box = tuple[tuple[int, int, int], tuple[int, int, int]]


def permuted(voxels: DataFrame, axes: tuple[str, str, str]) -> DataFrame:
    """out[x, y, z] = in[lr, ud, fb]: the axes of the input that become x, y and z, all distinct."""
    if sorted(axes) != list(CELL):
        raise ValueError("axes must be x, y and z in some order")
    return voxels.withColumns({to: F.col(src) for to, src in zip(CELL, axes, strict=True)})


def clip(voxels: DataFrame, box: Box) -> DataFrame:
    """Voxels in an inclusive box, counted from its low corner."""
    inside = F.lit(True)
    for a, low, high in zip(CELL, *box, strict=True):
        inside = inside & F.col(a).between(low, high)
    return voxels.where(inside).withColumns({a: F.col(a) - low for a, low in zip(CELL, box[0], strict=True)})


def read_box(active: DataFrame, box: Box, axes: tuple[str, str, str]) -> DataFrame:
    """Active cells of an inclusive box as voxels: cells are counted from its corner and permuted as an importer of sparse grids does it.

    The box's low x, y and z belong to the left-right, up-down and front-back axes, whatever axes those are.
    """
    moved = {to: F.col(src) - low for to, src, low in zip(CELL, axes, box[0], strict=True)}
    inside = F.lit(True)
    for src, low, high in zip(axes, *box, strict=True):
        inside = inside & F.col(src).between(low, high)
    return active.where(inside).withColumns(moved)


def opaque(rgba: DataFrame) -> DataFrame:
    """Cells whose quantised alpha isn't 0."""
    return rgba.where(F.floor(F.least(F.greatest(F.col("a"), F.lit(0.0)), F.lit(1.0)) * 255) != 0)


def box_columns(boxes: DataFrame) -> DataFrame:
    """boxes(xmin, ymin, zmin, xmax, ymax, zmax), inclusive: empty, dims, volume, largest axis, and the box grown by one."""
    dims = [F.greatest(F.col(f"{a}max") - F.col(f"{a}min") + 1, F.lit(0)).cast("long") for a in CELL]
    listed = F.array(*dims)
    return boxes.select(
        "*", (F.array_min(listed) == 0).alias("empty"), *(d.alias(f"dim_{a}") for a, d in zip(CELL, dims, strict=True)), (dims[0] * dims[1] * dims[2]).alias("volume"),
        (F.array_position(listed, F.array_max(listed)) - 1).cast("long").alias("max_axis"), *((F.col(f"{a}min") - 1).cast("long").alias(f"grown_{a}min") for a in CELL), *((F.col(f"{a}max") + 1).cast("long").alias(f"grown_{a}max") for a in CELL),
    )


def intersect(a: Box, b: Box) -> Box:
    return tuple(max(x, y) for x, y in zip(a[0], b[0], strict=True)), tuple(min(x, y) for x, y in zip(a[1], b[1], strict=True))


def bit_set(voxels: DataFrame) -> DataFrame:
    """Each brick's occupancy as eight 64-bit words, with counts, and first and next places that are on."""
    word = F.floor(F.col("vi") / 64)
    rows = addressed(voxels)
    by = rows.groupBy(*FRAME, "bx", "by", "bz", word.alias("word")).agg(F.bit_or(bit(F.col("vi"), 64)).alias("bits"), F.min("vi").cast("long").alias("first_on"))
    return by.withColumn("count_on", F.bit_count("bits").cast("long")).withColumn("count_off", (64 - F.bit_count("bits")).cast("long"))


def next_on(voxels: DataFrame, start: int) -> DataFrame:
    """The first place at or after `start` that is on, of each brick; 512 for none."""
    return addressed(voxels).groupBy(*FRAME, "bx", "by", "bz").agg(F.coalesce(F.min(F.when(F.col("vi") >= start, F.col("vi"))), F.lit(512)).cast("long").alias("next_on"))


def violations(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Rows that a valid relation doesn't have: repeated cells, cells outside, colours out of range."""
    rows = voxels.withColumn("n", F.count("*").over(Window.partitionBy(*FRAME, *CELL)))
    outside = F.lit(False)
    for a, n in zip(CELL, dims, strict=True):
        outside = outside | ~F.col(a).between(0, n - 1)
    colour = F.lit(False)
    for c in "rgb":
        colour = colour | ~F.col(c).between(0, 255)
    fault = F.when(outside, "outside").when(colour, "colour").when(F.col("n") > 1, "repeated")
    return rows.withColumn("fault", fault).where("fault is not null").drop("n")


def checked_dims(width: int, height: int, depth: int) -> None:
    for n in (width, height, depth):
        if n <= 0 or n % 8:
            raise ValueError("dimensions must be positive multiples of 8")


def tree_nodes(voxels: DataFrame, bits: tuple[int, ...] = (3, 7, 12)) -> DataFrame:
    """Nodes in use at each level of a tree whose node sides are powers of two, with their voxels."""
    levels = F.array(*(F.struct(F.lit(k).alias("level"), *(F.shiftright(F.col(a), b).alias(f"k{a}") for a in CELL)) for k, b in enumerate(bits)))
    rows = voxels.select(*FRAME, F.explode(levels).alias("n")).select(*FRAME, "n.*")
    return rows.groupBy(*FRAME, "level", "kx", "ky", "kz").agg(F.count("*").alias("n_voxels"))


def points_by(points: DataFrame, granularity: str) -> DataFrame:
    """points(scene, frame, px, py, pz) counted by voxel, leaf (8 cells) or grid."""
    at = [F.floor(F.col(f"p{a}") + 0.5).cast("long") for a in CELL]
    keys = {"voxel": at, "leaf": [F.floor(v / 8).cast("long") for v in at], "grid": []}[granularity]
    return points.groupBy(*FRAME, *(k.alias(f"k{a}") for k, a in zip(keys, CELL, strict=False))).agg(F.count("*").alias("n_points"))


def grid(spark: SparkSession, box: Box) -> DataFrame:
    """All cells of an inclusive box."""
    (x0, y0, z0), (x1, y1, z1) = box
    nx, ny = x1 - x0 + 1, y1 - y0 + 1
    cells = spark.range(nx * ny * (z1 - z0 + 1))
    i = F.col("id")
    return cells.select((i % nx + x0).cast("int").alias("x"), (F.floor(i / nx) % ny + y0).cast("int").alias("y"), (F.floor(i / (nx * ny)) + z0).cast("int").alias("z"))


def sphere_distance(radius: float, centre: tuple[float, float, float] = (0, 0, 0)) -> Column:
    return F.sqrt(sum((F.col(a) - float(c)) ** 2 for a, c in zip(CELL, centre, strict=True))) - radius


def torus_distance(major: float, minor: float, centre: tuple[float, float, float] = (0, 0, 0)) -> Column:
    """A torus around the y axis."""
    x, y, z = (F.col(a) - float(c) for a, c in zip(CELL, centre, strict=True))
    ring = F.sqrt(x * x + z * z) - major
    return F.sqrt(ring * ring + y * y) - minor


def box_distance(size: tuple[float, float, float], centre: tuple[float, float, float] = (0, 0, 0)) -> Column:
    beyond = [F.abs(F.col(a) - float(c)) - s / 2 for a, c, s in zip(CELL, centre, size, strict=True)]
    outside = F.sqrt(sum(F.greatest(b, F.lit(0.0)) ** 2 for b in beyond))
    return outside + F.least(F.greatest(*beyond), F.lit(0.0))


def box_frame_distance(size: tuple[float, float, float], thickness: float, centre: tuple[float, float, float] = (0, 0, 0)) -> Column:
    """The edges of a box, as bars of a thickness: the nearest of three bars that run along each axis."""
    p = [F.abs(F.col(a) - float(c)) - s / 2 for a, c, s in zip(CELL, centre, size, strict=True)]
    q = [F.abs(x + thickness) - thickness for x in p]
    bars = []
    for along in range(3):
        b = [p[k] if k == along else q[k] for k in range(3)]
        bars.append(F.sqrt(sum(F.greatest(x, F.lit(0.0)) ** 2 for x in b)) + F.least(F.greatest(*b), F.lit(0.0)))
    return F.least(*bars)


def octahedron_distance(size: float, centre: tuple[float, float, float] = (0, 0, 0)) -> Column:
    """Nearest along the sum norm, scaled to length."""
    return (sum(F.abs(F.col(a) - float(c)) for a, c in zip(CELL, centre, strict=True)) - size / 2) * 0.57735027


def level_set(cells: DataFrame, distance: Column, half_width: float = 3.0) -> DataFrame:
    """Cells within half_width of a surface, with their signed distance."""
    return cells.withColumn("value", distance).where(F.abs("value") < half_width)


def fog(cells: DataFrame, distance: Column, half_width: float = 3.0) -> DataFrame:
    """Cells inside a surface, with a density that rises to 1 at half_width below it."""
    return cells.withColumn("value", F.least(F.lit(1.0), -distance / half_width)).where("value > 0")


def scatter(cells: DataFrame, per_cell: int, seed: int = 0) -> DataFrame:
    """Points at pseudo-random places in each cell, the same at each run."""
    rows = cells.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))))
    place = {f"p{a}": F.col(a) - 0.5 + F.pmod(F.xxhash64(*CELL, "nth", F.lit(seed * 3 + k)), F.lit(1 << 30)) / float(1 << 30) for k, a in enumerate(CELL)}
    return rows.withColumns(place)


def dither(place: Column) -> Column:
    """An offset in 0..1 of each cell of a brick, the same at each run."""
    return F.pmod(place * 40503, F.lit(65536)) / 65536.0


def quantised(voxels: DataFrame, value: Column, bits: int, dithered: bool = False) -> DataFrame:
    """Each voxel's code of so many bits between its brick's least and greatest value, and what the code is off."""
    brick = Window.partitionBy(*FRAME, *BRICK)
    rows = addressed(voxels).select(*FRAME, *CELL, *BRICK, "vi", value.cast("double").alias("value"))
    rows = rows.withColumns({"low": F.min("value").over(brick), "high": F.max("value").over(brick)})
    rows = rows.withColumn("code", quantise(F.col("value"), F.col("low"), F.col("high"), bits, dither(F.col("vi")) if dithered else 0.5))
    return rows.withColumn("error", F.abs(dequantise(F.col("code"), F.col("low"), F.col("high"), bits) - F.col("value")))


def fitted(voxels: DataFrame, value: Column, tolerance: float, widths: tuple[int, ...] = (1, 2, 4, 8, 16), dithered: bool = False) -> DataFrame:
    """Codes of the fewest bits of each brick with which none of its values is off by more than the tolerance; the most bits where none will do."""
    brick = Window.partitionBy(*FRAME, *BRICK)
    rows = addressed(voxels).select(*FRAME, *CELL, *BRICK, "vi", value.cast("double").alias("value"))
    rows = rows.withColumns({"low": F.min("value").over(brick), "high": F.max("value").over(brick)})
    low, high = F.col("low"), F.col("high")
    rows = rows.withColumns({f"c{n}": quantise(F.col("value"), low, high, n, dither(F.col("vi")) if dithered else 0.5) for n in widths})
    rows = rows.withColumns({f"e{n}": F.max(F.abs(dequantise(F.col(f"c{n}"), low, high, n) - F.col("value"))).over(brick) for n in widths})
    bits = F.coalesce(*(F.when(F.col(f"e{n}") <= tolerance, n) for n in widths), F.lit(widths[-1]))
    rows = rows.withColumn("bits", bits)
    return rows.select(*FRAME, *CELL, "bits", F.coalesce(*(F.when(F.col("bits") == n, F.col(f"c{n}")) for n in widths)).alias("code"))
