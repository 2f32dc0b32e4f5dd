"""Neighbourhoods of voxels: visibility, sampling, stencils, rays.

A neighbour is another row. Visibility looks along each axis with a window; sampling gives each voxel's value to the cells that need
it and adds up there, stencils look in blocks of cells with a halo, so a join of offsets with the whole relation isn't needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .bricks import CELL, FRAME


def visible(voxels: DataFrame) -> DataFrame:
    """Voxels with an empty cell, or the volume's outside, at one of their six faces. Not a flood fill: the wall of a sealed hollow stays."""
    hidden = F.lit(True)
    for a in CELL:
        w = Window.partitionBy(*FRAME, *(b for b in CELL if b != a)).orderBy(a)
        hidden = hidden & F.coalesce(F.lag(a).over(w) == F.col(a) - 1, F.lit(False)) & F.coalesce(F.lead(a).over(w) == F.col(a) + 1, F.lit(False))
    return voxels.withColumn("hidden", hidden).where("not hidden").drop("hidden")


def at_cells(voxels: DataFrame, cells: DataFrame, background: int = 0) -> DataFrame:
    """Point lookups: filled and colour at cells(scene, frame, x, y, z); an empty or outside cell has the background colour."""
    rows = cells.join(voxels.withColumn("filled", F.lit(1)), [*FRAME, *CELL], "left")
    return rows.select(*cells.columns, F.coalesce("filled", F.lit(0)).alias("filled"), *(F.coalesce(c, F.lit(background)).alias(c) for c in "rgb"))


def at_points(voxels: DataFrame, points: DataFrame, value: Column, order: int, background: float = 0.0) -> DataFrame:
    """Samples at points(scene, frame, point, px, py, pz): order 0 nearest, 1 trilinear, 2 triquadratic, 3 tricubic, over (order + 1)^3 cells.

    Weights are products of the axes'; a cell without a voxel has the background.
    """

    def weights(t: Column) -> list[Column]:
        if order == 0:
            return [F.lit(1.0)]
        if order == 1:
            return [1 - t, t]
        if order == 2:
            return [0.5 * t * (t - 1), 1 - t * t, 0.5 * t * (t + 1)]
        return [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]

    first = {0: 0, 1: 0, 2: -1, 3: -1}[order]
    rows = points
    for a in CELL:
        base = F.floor(F.col(f"p{a}") + 0.5) if order in (0, 2) else F.floor(f"p{a}")
        near = F.array(*(F.struct((base + first + k).cast("int").alias(a), w.alias(f"w{a}")) for k, w in enumerate(weights(F.col(f"p{a}") - base))))
        rows = rows.withColumn("near", F.explode(near)).select(*rows.columns, f"near.{a}", f"near.w{a}")
    rows = rows.withColumn("w", F.col("wx") * F.col("wy") * F.col("wz"))
    values = voxels.select(*FRAME, *CELL, value.cast("double").alias("value"))
    joined = rows.join(values, [*FRAME, *CELL], "left")
    return joined.groupBy(*points.columns).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(background))).alias("sample"))


def gathered(voxels: DataFrame, value: Column, offsets: dict[str, tuple[int, int, int]], background: float = 0.0) -> DataFrame:
    """Each voxel's value `v`, and those at some offsets from it by name; the background where there is none.

    Values go to the blocks that need them, a block at a time looks them up in an array: neither the shuffle nor a task's memory grows with the offsets.
    """
    all_offsets = {"v": (0, 0, 0)} | offsets
    reach = (0, *(max(abs(o[k]) for o in all_offsets.values()) for k in range(3)))
    rows = voxels.select(*FRAME, *((F.col(a) + 0).alias(a) for a in CELL), value.cast("double").alias("value")).where("value is not null and frame is not null")
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, T.DoubleType()) for n in all_offsets)])
    own = blocks.core(reach)

    def run(block: pa.Table) -> pa.Table:
        origin, shape, at = blocks.placed(block, reach)
        filled = blocks.filled_cells(at, shape)
        values = np.full(filled.size, -np.inf)
        np.maximum.at(values, at, block.column("value").to_numpy())
        values = np.where(filled, values.reshape(shape), background)
        here = [i + r for i, r in zip(np.nonzero(filled[own]), reach, strict=True)]
        columns = {a: i + low for a, i, low in zip(blocks.AXES, here, origin, strict=True)}
        for n, o in all_offsets.items():
            columns[n] = values[here[0], here[1] + o[0], here[2] + o[1], here[3] + o[2]]
        kept = [block.schema.field(c) for c in (*FRAME, *CELL)]
        return blocks.listed(block, columns, pa.schema([*kept, *(pa.field(n, pa.float64()) for n in all_offsets)]))

    return blocks.haloed(rows, reach).groupBy(*blocks.KEYS).applyInArrow(run, schema)


FACES = {"xm": (-1, 0, 0), "xp": (1, 0, 0), "ym": (0, -1, 0), "yp": (0, 1, 0), "zm": (0, 0, -1), "zp": (0, 0, 1)}
SIGN = {"m": -1, "p": 1}
EDGES = {f"{a}{s}{b}{t}": tuple(SIGN[s] if k == a else SIGN[t] if k == b else 0 for k in CELL) for a, b in ("xy", "xz", "yz") for s in "mp" for t in "mp"}


def gradients(voxels: DataFrame, value: Column, background: float = 0.0) -> DataFrame:
    """Central differences, Laplacian, and one-sided squared gradient (Godunov) of a value at each voxel."""
    g = gathered(voxels, value, FACES, background)
    c = F.col
    plus, minus = (lambda x: F.greatest(x, F.lit(0.0))), (lambda x: F.least(x, F.lit(0.0)))
    up = {a: c(f"{a}p") - c("v") for a in CELL}
    down = {a: c("v") - c(f"{a}m") for a in CELL}
    outward = sum(F.greatest(plus(down[a]) ** 2, minus(up[a]) ** 2) for a in CELL)
    inward = sum(F.greatest(minus(down[a]) ** 2, plus(up[a]) ** 2) for a in CELL)
    return g.select(
        *FRAME, *CELL, "v", *((0.5 * (c(f"{a}p") - c(f"{a}m"))).alias(f"g{a}") for a in CELL),
        (sum(c(k) for k in FACES) - 6 * c("v")).alias("laplacian"), F.when(c("v") > 0, outward).otherwise(inward).alias("norm_squared"),
    )


def curvature(voxels: DataFrame, value: Column, background: float = 0.0) -> DataFrame:
    """Mean and Gaussian curvature of the level set through each voxel, over 19 cells; null where the gradient vanishes."""
    g = gathered(voxels, value, FACES | EDGES, background)
    c = F.col
    d = {a: 0.5 * (c(f"{a}p") - c(f"{a}m")) for a in CELL}
    dd = {a: c(f"{a}p") - 2 * c("v") + c(f"{a}m") for a in CELL}
    m = {a + b: 0.25 * (c(f"{a}p{b}p") - c(f"{a}p{b}m") - c(f"{a}m{b}p") + c(f"{a}m{b}m")) for a, b in ("xy", "xz", "yz")}
    g = g.select(*FRAME, *CELL, "v", *(x.alias(f"d{a}") for a, x in d.items()), *(x.alias(f"d{a}{a}") for a, x in dd.items()), *(x.alias(f"d{k}") for k, x in m.items()))
    n2 = c("dx") ** 2 + c("dy") ** 2 + c("dz") ** 2
    mean = (c("dx") ** 2 * (c("dyy") + c("dzz")) + c("dy") ** 2 * (c("dxx") + c("dzz")) + c("dz") ** 2 * (c("dxx") + c("dyy")) - 2 * (c("dx") * c("dy") * c("dxy") + c("dx") * c("dz") * c("dxz") + c("dy") * c("dz") * c("dyz"))) / (2 * n2**1.5)
    gauss = (
        c("dx") ** 2 * (c("dyy") * c("dzz") - c("dyz") ** 2) + c("dy") ** 2 * (c("dxx") * c("dzz") - c("dxz") ** 2) + c("dz") ** 2 * (c("dxx") * c("dyy") - c("dxy") ** 2)
        + 2 * (c("dx") * c("dy") * (c("dxz") * c("dyz") - c("dxy") * c("dzz")) + c("dx") * c("dz") * (c("dxy") * c("dyz") - c("dxz") * c("dyy")) + c("dy") * c("dz") * (c("dxy") * c("dxz") - c("dyz") * c("dxx")))
    ) / n2**2
    return g.select(*FRAME, *CELL, F.when(n2 > 0, mean).alias("mean"), F.when(n2 > 0, gauss).alias("gaussian")).where("mean is not null")


def principal_curvatures(voxels: DataFrame, value: Column, background: float = 0.0) -> DataFrame:
    """The least and the greatest curvature of the level set through each voxel."""
    c = curvature(voxels, value, background)
    apart = F.sqrt(F.greatest(F.col("mean") ** 2 - F.col("gaussian"), F.lit(0.0)))
    return c.select(*FRAME, *CELL, (F.col("mean") - apart).alias("least"), (F.col("mean") + apart).alias("greatest"))


def closest_points(voxels: DataFrame, value: Column, background: float = 0.0) -> DataFrame:
    """For a value that is a distance, the point of the surface next to each voxel: the cell less the distance along the gradient."""
    g = gathered(voxels, value, FACES, background)
    return g.select(*FRAME, *CELL, *((F.col(a) - F.col("v") * 0.5 * (F.col(f"{a}p") - F.col(f"{a}m"))).alias(f"c{a}") for a in CELL))


def slopes_at_points(voxels: DataFrame, points: DataFrame, value: Column, level: float = 0.0, background: float = 0.0) -> DataFrame:
    """The gradient of the trilinear sample at points(scene, frame, point, px, py, pz), and whether a level crosses the eight cells around."""
    rows = points
    for a in CELL:
        base, t = F.floor(f"p{a}"), F.col(f"p{a}") - F.floor(f"p{a}")
        near = F.array(*(F.struct((base + k).cast("int").alias(a), w.alias(f"w{a}"), F.lit(s).alias(f"s{a}")) for k, w, s in ((0, 1 - t, -1.0), (1, t, 1.0))))
        rows = rows.withColumn("near", F.explode(near)).select(*rows.columns, "near.*")
    joined = rows.join(voxels.select(*FRAME, *CELL, value.cast("double").alias("value")), [*FRAME, *CELL], "left").fillna(background, "value")
    slopes = [F.sum(F.col(f"s{a}") * F.col(f"w{b}") * F.col(f"w{c}") * F.col("value")).alias(f"g{a}") for a, b, c in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))]
    return joined.groupBy(*points.columns).agg(*slopes, F.sum((F.col("value") < level).cast("int")).between(1, 7).alias("crosses"))


def weno(a: str, b: str, c: str, d: str, e: str) -> str:
    """The fifth-order weighted essentially non-oscillatory flux of five differences, as a SQL expression that both engines take."""
    parts = (
        (0.1, f"{a} - 2 * {b} + {c}", f"{a} - 4 * {b} + 3 * {c}", f"2 * {a} - 7 * {b} + 11 * {c}"),
        (0.6, f"{b} - 2 * {c} + {d}", f"{b} - {d}", f"5 * {c} - {b} + 2 * {d}"),
        (0.3, f"{c} - 2 * {d} + {e}", f"3 * {c} - 4 * {d} + {e}", f"2 * {c} + 5 * {d} - {e}"),
    )
    weights = [f"({g}e0 / power(13e0 / 12e0 * power({p}, 2) + 0.25e0 * power({q}, 2) + 1e-6, 2))" for g, p, q, _ in parts]
    return f"(({' + '.join(f'{w} * ({v})' for w, (*_, v) in zip(weights, parts, strict=True))}) / (6 * ({' + '.join(weights)})))"


STEPS = {f"{a}{n}": tuple(n_ if k == a else 0 for k in CELL) for a in CELL for n, n_ in (("m3", -3), ("m2", -2), ("m1", -1), ("p1", 1), ("p2", 2), ("p3", 3))}


def weno_slopes(a: str) -> tuple[str, str]:
    """One-sided slopes along an axis, from the low and from the high side."""
    at = [f"{a}m3", f"{a}m2", f"{a}m1", "v", f"{a}p1", f"{a}p2", f"{a}p3"]
    d = [f"({q} - {p})" for p, q in zip(at, at[1:], strict=False)]
    return weno(*d[:5]), weno(*d[:0:-1])


def weno_norms(voxels: DataFrame, value: Column, background: float = 0.0) -> DataFrame:
    """Squared gradient (Godunov) of a value at each voxel, by fifth-order one-sided slopes over 19 cells."""
    g = gathered(voxels, value, STEPS, background)
    g = g.withColumns({f"{s}{a}": F.expr(e) for a in CELL for s, e in zip("du", weno_slopes(a), strict=True)})
    plus, minus = (lambda x: F.greatest(F.col(x), F.lit(0.0)) ** 2), (lambda x: F.least(F.col(x), F.lit(0.0)) ** 2)
    outward = sum(F.greatest(plus(f"d{a}"), minus(f"u{a}")) for a in CELL)
    inward = sum(F.greatest(minus(f"d{a}"), plus(f"u{a}")) for a in CELL)
    return g.select(*FRAME, *CELL, F.when(F.col("v") > 0, outward).otherwise(inward).alias("norm_squared"))


def zero_crossings(voxels: DataFrame, value: Column, axis: str, level: float) -> DataFrame:
    """Along each line of an axis, the first voxel whose value is across `level` from that of the voxel just before it."""
    rest = [a for a in CELL if a != axis]
    w = Window.partitionBy(*FRAME, *rest).orderBy(axis)
    above = value.cast("double") > level
    rows = voxels.select(*FRAME, *CELL, above.alias("above"))
    crosses = (F.lag(axis).over(w) == F.col(axis) - 1) & (F.lag("above").over(w) != F.col("above"))
    return rows.withColumn("crosses", crosses).where("crosses").groupBy(*FRAME, *rest).agg(F.min(axis).alias(axis))


def ray_box(o: tuple[Column, ...], d: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...]) -> tuple[Column, Column]:
    """Where a ray o + t d, t >= 0, enters and leaves a box (slabs); null if it misses."""
    near, far = F.lit(0.0), F.lit(float("inf"))
    for k in range(3):
        inverse = 1 / F.nullif(d[k].cast("double"), F.lit(0.0))
        a, b = (low[k] - o[k]) * inverse, (high[k] - o[k]) * inverse
        within = (o[k] >= low[k]) & (o[k] <= high[k])
        near = F.greatest(near, F.when(d[k] != 0, F.least(a, b)).when(within, F.lit(0.0)).otherwise(F.lit(float("inf"))))
        far = F.least(far, F.when(d[k] != 0, F.greatest(a, b)).when(within, F.lit(float("inf"))).otherwise(F.lit(-1.0)))
    return F.when(near <= far, near), F.when(near <= far, far)


def ray_sphere(o: tuple[Column, ...], d: tuple[Column, ...], centre: tuple[Column, ...], radius: Column) -> tuple[Column, Column]:
    """Where a ray's line meets a sphere; null if it doesn't."""
    rel = [a - b for a, b in zip(o, centre, strict=True)]
    a = sum(x * x for x in d)
    b = 2 * sum(x * y for x, y in zip(rel, d, strict=True))
    c = sum(x * x for x in rel) - radius * radius
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when(disc >= 0, (-b - root) / (2 * a)), F.when(disc >= 0, (-b + root) / (2 * a))


def ray_plane(o: tuple[Column, ...], d: tuple[Column, ...], normal: tuple[Column, ...], distance: Column) -> Column:
    """Where a ray's line meets the plane n . p = distance; null if parallel."""
    along = sum(x * y for x, y in zip(normal, d, strict=True)).cast("double")
    return (distance - sum(x * y for x, y in zip(normal, o, strict=True))) / F.nullif(along, F.lit(0.0))


def first_hits_along(voxels: DataFrame, axis: str) -> DataFrame:
    """The first voxel that each axis-aligned ray from the low side meets."""
    rest = [a for a in CELL if a != axis]
    return voxels.groupBy(*FRAME, *rest).agg(F.min(axis).alias(axis), F.min_by(F.struct("r", "g", "b"), axis).alias("c")).select(*FRAME, *rest, axis, "c.*")


def ray_cells(rays: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """rays(scene, frame, ray, ox, oy, oz, dx, dy, dz): the cells that each crosses in a box of cells, by the parameter t where it enters them.

    Crossings of the grid planes of each axis are listed; a cell is entered at the box's near side and at each crossing.
    """
    o, d = (tuple(F.col(f"{p}{a}").cast("double") for a in CELL) for p in "od")
    near, far = ray_box(o, d, tuple(F.lit(float(v)) for v in low), tuple(F.lit(float(v + 1)) for v in high))
    rows = rays.withColumn("near", near).withColumn("far", far).where("near is not null")
    crossings = F.array(F.col("near"))
    for k in range(3):
        planes = F.sequence(F.lit(low[k]), F.lit(high[k] + 1))
        own = F.transform(planes, _crossing(o[k], d[k]))
        crossings = F.concat(crossings, F.when(d[k] != 0, own).otherwise(F.array().cast("array<double>")))
    rows = rows.select(*rays.columns, "near", "far", F.array_sort(F.array_distinct(F.filter(crossings, lambda t: (t >= F.col("near")) & (t < F.col("far"))))).alias("ts"))
    steps = rows.select(*rays.columns, "far", "ts", F.posexplode("ts").alias("step", "t"))
    until = F.coalesce(F.try_element_at("ts", F.col("step") + 2), F.col("far"))
    middle = (F.col("t") + until) / 2
    cells = steps.select(*rays.columns, "step", "t", *(F.floor(F.col(f"o{a}") + middle * F.col(f"d{a}")).cast("int").alias(a) for a in CELL))
    return cells


def _crossing(o: Column, d: Column):
    return lambda plane: (plane - o) / d


def first_hits(voxels: DataFrame, rays: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """The first voxel on each ray, and where it is entered; rays that meet none are dropped."""
    hits = ray_cells(rays, low, high).join(voxels, [*FRAME, *CELL])
    return hits.groupBy(*FRAME, "ray").agg(F.min_by(F.struct(*CELL, "t"), "t").alias("hit")).select(*FRAME, "ray", "hit.*")


def ray_clip(o: tuple[Column, ...], d: tuple[Column, ...], low: tuple[Column, ...], high: tuple[Column, ...], start: Column, stop: Column) -> tuple[Column, Column]:
    """The part of a ray from start to stop that is in a box; nulls if there is none."""
    near, far = ray_box(o, d, low, high)
    first, last = F.greatest(near, start), F.least(far, stop)
    meets = near.isNotNull() & (first <= last)
    return F.when(meets, first), F.when(meets, last)
