"""The registered voxel queries, each with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import vectors as V
from ..operators import bricks, frames, motion, neighbours, volumes
from ..session import shared_folder
from ..sources import arrays, container, nvdb, voxfile
from . import scenes

GOP, GROUP = 4, 3
_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name. sql: a SELECT over the scenes d, m and their bricks db, mb."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _found[f.__name__] = f, sql and (f"WITH {scenes.SQL[1:]} {sql}" if re.search(r"(FROM|JOIN) (d|m|db|mb)\b", sql) else sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    # `by` is a key word of SQL
    return {n: re.sub(r"(?<![\w\"])by(?![\w\"])", '"by"', s) for n, (_, s) in _found.items() if s}


def whole(df: DataFrame) -> DataFrame:
    """Integer columns as long, so both engines have the same types."""
    return df.select(*(F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FR, BR = "scene, frame::BIGINT AS frame", "scene, frame::BIGINT AS frame, bx::BIGINT AS bx, by::BIGINT AS by, bz::BIGINT AS bz"
VX = "scene, frame::BIGINT AS frame, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z"
RGB = "r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b"
P = "PARTITION BY scene, frame, bx, by, bz ORDER BY vi"


# --- grouping -------------------------------------------------------------------------------------------------------


@query(f"SELECT {FR}, count(*) AS n_voxels FROM d GROUP BY ALL")
def frame_counts(s, d):
    return whole(bricks.frame_counts(scenes.dense(s, d)))


@query(f"SELECT {BR}, count(*) AS n_voxels FROM db GROUP BY ALL")
def brick_counts(s, d):
    return whole(bricks.bricks(scenes.dense(s, d)))


@query("""SELECT scene, frame, count(*) AS n_bricks, sum(n)::BIGINT AS n_voxels, 64 + count(*) * 2112 AS bytes FROM (
  SELECT scene, frame::BIGINT AS frame, bx, by, bz, count(*) AS n FROM db GROUP BY ALL) GROUP BY 1, 2""")
def frame_sizes(s, d):
    return whole(bricks.frame_sizes(scenes.dense(s, d), 8))


@query("""SELECT scene, count(*) AS frames, count(*) * 8 * 512 * 3 AS dense_bytes, sum(64 + bricks * 2112)::BIGINT AS brick_bytes, sum(n)::BIGINT * 9 AS voxel_bytes FROM (
  SELECT scene, frame, count(DISTINCT (bx, by, bz)) AS bricks, count(*) AS n FROM db GROUP BY ALL) GROUP BY 1""")
def size_report(s, d):
    return whole(bricks.size_report(scenes.dense(s, d), 8))


@query("""SELECT scene, frame::BIGINT AS frame, ((bx + 4 * (by + 3 * bz)) // 32)::BIGINT AS word, bit_or(DISTINCT 1::BIGINT << ((bx + 4 * (by + 3 * bz)) % 32)::INT)::BIGINT AS bits, 2::BIGINT AS words
  FROM mb GROUP BY ALL""")
def occupancy_words(s, d):
    return whole(bricks.occupancy(scenes.moving(s, d), 4, 3, 3))


WRITES = "SELECT o_orderkey * 31 % 3 AS frame, o_orderkey * 7 % 16 AS x, o_orderkey * 11 % 16 AS y, o_orderkey * 13 % 16 AS z, o_orderkey % 256 AS r, o_orderkey * 3 % 256 AS g, o_custkey % 256 AS b, o_orderkey AS seq FROM orders"


def writes(s, d):
    k = F.col("o_orderkey")
    cols = {"frame": k * 31 % 3, "x": k * 7 % 16, "y": k * 11 % 16, "z": k * 13 % 16, "r": k % 256, "g": k * 3 % 256, "b": F.col("o_custkey") % 256}
    return table(s, d, "orders").select(F.lit("W").alias("scene"), *(c.cast("int").alias(n) for n, c in cols.items()), k.alias("seq"))


@query(f"SELECT 'W' AS scene, frame, x, y, z, arg_max(r, seq) AS r, arg_max(g, seq) AS g, arg_max(b, seq) AS b FROM ({WRITES}) GROUP BY ALL")
def last_write(s, d):
    return whole(bricks.last_write(writes(s, d)))


@query(f"SELECT {VX}, 255::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b FROM d WHERE x % 2 = 0 AND (x + y + z) % 5 <> 0 UNION ALL SELECT {VX}, {RGB} FROM d WHERE x % 2 = 1 AND (x + y + z) % 5 <> 0")
def brick_edits(s, d):
    v = scenes.dense(s, d)
    return whole(bricks.edited(v, v.where("x % 2 = 0").withColumn("r", F.lit(255)), v.where("(x + y + z) % 5 = 0")).select(*scenes.VOXEL))


GROUPED = """WITH {scenes}, n AS (SELECT scene, frame, bx, by, bz, count(*) AS n_voxels FROM {b} GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY scene, frame ORDER BY bx, by, bz) - 1 AS i, count(*) OVER (PARTITION BY scene, frame) AS n, sum(n_voxels) OVER (PARTITION BY scene, frame ORDER BY bx, by, bz) - n_voxels AS o FROM n),
 a AS (SELECT *, (n + {g} - 1) // {g} AS ng FROM o), c AS (SELECT *, n // ng AS base, n % ng AS rest FROM a),
 e AS (SELECT *, CASE WHEN i < rest * (base + 1) THEN i // (base + 1) ELSE rest + (i - rest * (base + 1)) // base END AS grp FROM c) """


def grouped(select: str, b: str = "mb") -> str:
    return GROUPED.format(scenes=scenes.SQL[1:], b=b, g=GROUP) + select


def brick_groups(s, d):
    return whole(bricks.brick_groups(scenes.moving(s, d), GROUP))


_found["brick_groups"] = brick_groups, grouped(f"SELECT {BR}, n_voxels, i, n, grp, o::BIGINT AS \"offset\" FROM e")


def group_totals(s, d):
    return whole(bricks.group_totals(scenes.moving(s, d), GROUP))


_found["group_totals"] = group_totals, grouped(f"SELECT {FR}, grp, count(*) AS n_bricks, sum(n_voxels)::BIGINT AS n_voxels, min(o)::BIGINT AS \"offset\" FROM e GROUP BY ALL")


@query(f"""SELECT {BR}, count(*) AS n, min(r)::DOUBLE AS low, max(r)::DOUBLE AS high, round(avg(r), 6) AS mean, round(var_pop(r), 6) AS variance, round(stddev_pop(r), 6) AS deviation,
  min(x)::BIGINT AS min_x, max(x)::BIGINT AS max_x, min(y)::BIGINT AS min_y, max(y)::BIGINT AS max_y, min(z)::BIGINT AS min_z, max(z)::BIGINT AS max_z FROM db GROUP BY scene, frame, bx, by, bz""")
def brick_statistics(s, d):
    by = bricks.statistics(scenes.dense(s, d), F.col("r"), ("scene", "frame", "bx", "by", "bz"))
    return whole(by.withColumns({c: F.round(c, 6) for c in ("mean", "variance", "deviation")}))


@query("""SELECT scene, frame::BIGINT AS frame, brick, (4 * grouping(scene) + 2 * grouping(frame) + grouping(brick))::BIGINT AS level, count(*) AS n, min(g)::DOUBLE AS low, max(g)::DOUBLE AS high,
  round(avg(g), 6) AS mean, round(var_pop(g), 6) AS variance FROM (SELECT *, bx || ',' || by || ',' || bz AS brick FROM db) GROUP BY GROUPING SETS ((scene, frame, brick), (scene, frame), (scene))""")
def tree_statistics(s, d):
    return whole(bricks.tree_statistics(scenes.dense(s, d), F.col("g")).withColumns({c: F.round(c, 6) for c in ("mean", "variance")}))


@query(f"SELECT {FR}, count(*) AS n, min(x)::BIGINT AS min_x, max(x)::BIGINT AS max_x, min(y)::BIGINT AS min_y, max(y)::BIGINT AS max_y, min(z)::BIGINT AS min_z, max(z)::BIGINT AS max_z FROM m GROUP BY scene, frame")
def frame_bounds(s, d):
    return whole(bricks.bounds(scenes.moving(s, d)))


@query("""SELECT symbol, freq, (sum(freq) OVER (ORDER BY symbol) - freq)::BIGINT AS cum FROM (SELECT r::BIGINT AS symbol, count(*) AS freq FROM d GROUP BY 1 UNION ALL SELECT 256, 1)""")
def symbol_table(s, d):
    return whole(bricks.symbol_table(scenes.dense(s, d).select(F.col("r").alias("symbol"))))


@query("""SELECT v, symbol FROM (SELECT symbol, freq, sum(freq) OVER (ORDER BY symbol) - freq AS cum FROM (SELECT r::BIGINT AS symbol, count(*) AS freq FROM d GROUP BY 1 UNION ALL SELECT 256, 1)),
  (SELECT o_orderkey AS v FROM orders) WHERE v >= cum AND v < cum + freq""")
def symbol_lookup(s, d):
    t = bricks.symbol_table(scenes.dense(s, d).select(F.col("r").alias("symbol")))
    return whole(bricks.symbol_at(t, table(s, d, "orders").select(F.col("o_orderkey").alias("v"))))


COMPACT_WORDS = ", ".join(f"coalesce(bit_or(1::BIGINT << (vi % 32)) FILTER (vi // 32 = {k}), 0)" for k in range(16))


@query(f"""SELECT {BR}, n AS n_voxels, array_to_string(w, ',') AS bitmap, (sum(n) OVER (PARTITION BY scene, frame ORDER BY bx, by, bz) - n)::BIGINT AS "offset" FROM (
  SELECT scene, frame, bx, by, bz, count(*) AS n, [{COMPACT_WORDS}] AS w FROM db GROUP BY ALL)""")
def compact_frames(s, d):
    return whole(bricks.compact(scenes.dense(s, d)).withColumn("bitmap", F.array_join(F.transform("bitmap", lambda x: x.cast("string")), ",")))


@query(f"SELECT {BR}, (vi // 64)::BIGINT AS word, count(DISTINCT vi) AS count_on, 64 - count(DISTINCT vi) AS count_off, min(vi)::BIGINT AS first_on FROM db GROUP BY ALL")
def bit_sets(s, d):
    return whole(volumes.bit_set(scenes.dense(s, d)).drop("bits"))


@query(f"SELECT {BR}, coalesce(min(vi) FILTER (vi >= 100), 512)::BIGINT AS next_on FROM mb GROUP BY ALL")
def bit_set_next(s, d):
    return whole(volumes.next_on(scenes.moving(s, d), 100))


@query(f"""SELECT {FR}, level::BIGINT AS level, (x >> bits)::BIGINT AS kx, (y >> bits)::BIGINT AS ky, (z >> bits)::BIGINT AS kz, count(*) AS n_voxels FROM m , (VALUES (0, 3), (1, 7), (2, 12)) AS t(level, bits) GROUP BY ALL""")
def tree_nodes(s, d):
    return whole(volumes.tree_nodes(scenes.moving(s, d)))


# --- projections ----------------------------------------------------------------------------------------------------


@query(f"SELECT {BR}, vi::BIGINT AS vi, (bx + 2 * (by + 2 * bz))::BIGINT AS map_index, ((r::BIGINT << 24) | (g::BIGINT << 16) | (b::BIGINT << 8) | 255)::BIGINT AS packed FROM db")
def addresses(s, d):
    v = A.addressed(scenes.dense(s, d))
    return whole(v.select("scene", "frame", *A.BRICK, "vi", A.map_index(2, 2).alias("map_index"), A.pack_colour(F.col("r"), F.col("g"), F.col("b")).alias("packed")))


@query(f"SELECT {VX}, {RGB} FROM d")
def colour_round_trip(s, d):
    v = scenes.dense(s, d).withColumn("w", A.pack_colour(F.col("r"), F.col("g"), F.col("b")))
    return whole(v.select("scene", "frame", "x", "y", "z", *(c.alias(n) for c, n in zip(A.unpack_colour(F.col("w")), "rgb", strict=True))))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, floor(l_discount * 20 * 255 + 0.5)::BIGINT AS rounded, floor(least(greatest(l_discount * 20, 0), 1) * 255)::BIGINT AS truncated, round(l_linenumber / 255.0, 9) AS share
  FROM lineitem""")
def quantised(s, d):
    c = F.col("l_discount") * 20
    return whole(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", A.quantise_rounded(c).alias("rounded"), A.quantise_truncated(c).alias("truncated"), F.round(F.col("l_linenumber") / 255.0, 9).alias("share")))


@query(f"SELECT scene, frame::BIGINT AS frame, z::BIGINT AS x, x::BIGINT AS y, y::BIGINT AS z, {RGB} FROM m")
def axes_permuted(s, d):
    return whole(volumes.permuted(scenes.moving(s, d), ("z", "x", "y")).select(*scenes.VOXEL))


@query(f"SELECT scene, frame::BIGINT AS frame, (z - 9)::BIGINT AS x, (x - 10)::BIGINT AS y, (y - 11)::BIGINT AS z, {RGB} FROM m WHERE z BETWEEN 9 AND 20 AND x BETWEEN 10 AND 21 AND y BETWEEN 11 AND 22")
def sparse_box_read(s, d):
    return whole(volumes.read_box(scenes.moving(s, d), ((9, 10, 11), (20, 21, 22)), ("z", "x", "y")).select(*scenes.VOXEL))


@query(f"SELECT scene, frame::BIGINT AS frame, (x - 2)::BIGINT AS x, (y - 3)::BIGINT AS y, (z - 4)::BIGINT AS z, {RGB} FROM d WHERE x BETWEEN 2 AND 9 AND y BETWEEN 3 AND 10 AND z BETWEEN 4 AND 11")
def clipped(s, d):
    return whole(volumes.clip(scenes.dense(s, d), ((2, 3, 4), (9, 10, 11))).select(*scenes.VOXEL))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_discount AS a FROM lineitem WHERE floor(l_discount * 255)::BIGINT <> 0")
def alpha_filter(s, d):
    return volumes.opaque(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_discount").alias("a")))


PALETTE = "SELECT k, 17 * k % 256 AS r, 29 * k % 256 AS g, 43 * k % 256 AS b FROM generate_series(1, 50) AS t(k)"


@query(f"SELECT p_partkey, p_size::BIGINT AS p_size, r, g, b FROM part JOIN ({PALETTE}) ON k = p_size")
def palette_lookup(s, d):
    k = F.col("id")
    palette = s.range(1, 51).select(k.cast("int").alias("p_size"), (17 * k % 256).alias("r"), (29 * k % 256).alias("g"), (43 * k % 256).alias("b"))
    return whole(table(s, d, "part").select("p_partkey", "p_size").join(F.broadcast(palette), "p_size"))


@query("""SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1::BIGINT << 56 END + o_custkey)::BIGINT AS entry, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS kind, o_custkey AS pointer FROM orders""")
def frame_table_entries(s, d):
    rows = table(s, d, "orders").select("o_orderkey", A.pack_pointer((F.col("o_orderkey") % 4 != 0).cast("int"), F.col("o_custkey")).alias("entry"))
    kind, pointer = A.unpack_pointer(F.col("entry"))
    return whole(rows.withColumns({"kind": kind, "pointer": pointer}))


@query("""SELECT o_orderkey, round(o_orderkey / 30.0, 6) AS seconds, round(CASE WHEN abs(o_custkey / 30.0 - o_orderkey / 30.0) > 0.1 THEN o_orderkey / 30.0 ELSE o_custkey / 30.0 END, 6) AS checked,
  (((o_orderkey % 4) << 24) | ((o_orderkey % 8) << 16) | ((o_orderkey % 16) << 8) | (o_orderkey % 32))::BIGINT AS version, ceil(o_orderkey / 32.0)::BIGINT AS words FROM orders""")
def header_fields(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return whole(table(s, d, "orders").select("o_orderkey", F.round(A.duration(k, F.lit(30.0)), 6).alias("seconds"), F.round(A.duration(k, F.lit(30.0), c / 30.0), 6).alias("checked"), A.pack_version(k % 4, k % 8, k % 16, k % 32).alias("version"), A.map_words(k).alias("words")))


# The error texts as SQL.
@query("""SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN 'success' WHEN 1 THEN 'invalid arguments' WHEN 2 THEN 'invalid input' WHEN 3 THEN 'out of memory' WHEN 4 THEN 'file open'
  WHEN 5 THEN 'file read' WHEN 6 THEN 'file write' WHEN 7 THEN 'runtime' WHEN 8 THEN 'internal' ELSE 'unknown error' END AS message FROM orders""")
def error_texts(s, d):
    return table(s, d, "orders").select("o_orderkey", A.error_text((F.col("o_orderkey") % 12).cast("int")).alias("message"))


MORTON = " + ".join(f"(({a} >> {i}) & 1) * {1 << 3 * i + k}" for i in range(4) for k, a in enumerate("xyz"))


@query(f"SELECT {VX}, ({MORTON})::BIGINT AS morton FROM d")
def morton_order(s, d):
    return whole(scenes.dense(s, d).select("scene", "frame", "x", "y", "z", A.morton(F.col("x"), F.col("y"), F.col("z"), 4).alias("morton")))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, greatest(0, least(25, l_quantity)) AS clamped, l_extendedprice - floor(l_extendedprice) AS fract, floor(l_discount * 10 + 0.5)::BIGINT AS rounded, sign(l_tax - 0.04)::BIGINT AS sgn,
  CASE WHEN l_quantity <= l_partkey AND l_quantity <= l_suppkey THEN 0 WHEN l_partkey <= l_suppkey THEN 1 ELSE 2 END::BIGINT AS least_axis, CASE WHEN l_quantity >= l_partkey AND l_quantity >= l_suppkey THEN 0 WHEN l_partkey >= l_suppkey THEN 1 ELSE 2 END::BIGINT AS greatest_axis FROM lineitem""")
def scalar_math(s, d):
    v = tuple(F.col(c).cast("double") for c in ("l_quantity", "l_partkey", "l_suppkey"))
    return whole(table(s, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", V.clamp(F.col("l_quantity"), 0.0, 25.0).alias("clamped"), V.fract(F.col("l_extendedprice")).alias("fract"), V.round_half_up(F.col("l_discount") * 10).alias("rounded"),
        V.sign(F.col("l_tax") - 0.04).alias("sgn"), V.least_axis(v).alias("least_axis"), V.greatest_axis(v).alias("greatest_axis")))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, (a * 2 + b * 3 + c * 5)::DOUBLE AS dot, (b * 5 - c * 3)::DOUBLE AS cx, (c * 2 - a * 5)::DOUBLE AS cy, (a * 3 - b * 2)::DOUBLE AS cz, round(sqrt(a * a + b * b + c * c), 6) AS len, round(a / sqrt(a * a + b * b + c * c), 6) AS nx
  FROM (SELECT *, l_quantity AS a, l_linenumber::DOUBLE AS b, (l_suppkey % 10)::DOUBLE AS c FROM lineitem)""")
def vector_math(s, d):
    v = (F.col("l_quantity"), F.col("l_linenumber").cast("double"), (F.col("l_suppkey") % 10).cast("double"))
    w = tuple(F.lit(x) for x in (2.0, 3.0, 5.0))
    cx, cy, cz = V.cross(v, w)
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", V.dot(v, w).alias("dot"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz"), F.round(V.length(v), 6).alias("len"), F.round(V.normalised(v)[0], 6).alias("nx"))


@query(f"""SELECT {VX}, (x >> 3)::BIGINT AS leaf_x, (x & 7)::BIGINT AS low_x, (x << 2)::BIGINT AS wide_x, (((x - 8) < 0)::INT + 2 * ((y - 8) < 0)::INT + 4 * ((z - 8) < 0)::INT)::BIGINT AS octant,
  (xor(xor(x::BIGINT * 73856093, y::BIGINT * 19349663), z::BIGINT * 83492791) & 4095)::BIGINT AS hash FROM d""")
def coordinate_math(s, d):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return whole(scenes.dense(s, d).select("scene", "frame", "x", "y", "z", F.shiftright(x, 3).alias("leaf_x"), x.bitwiseAND(F.lit(7)).alias("low_x"), F.shiftleft(x, 2).alias("wide_x"), V.octant(x - 8, y - 8, z - 8).alias("octant"), V.coordinate_hash(x, y, z, 12).alias("hash")))


MATRIX, SHIFT = [[2.0, 0.0, 0.0], [0.0, 4.0, 0.0], [1.0, 0.0, 0.5]], [10.0, -4.0, 1.0]


@query(f"SELECT {VX}, (2.0 * x + 10)::DOUBLE AS wx, (4.0 * y - 4)::DOUBLE AS wy, (x + 0.5 * z + 1)::DOUBLE AS wz, x::DOUBLE AS ix, y::DOUBLE AS iy, z::DOUBLE AS iz, (0.5 * x - z)::DOUBLE AS gx FROM m")
def affine_map(s, d):
    v = tuple(F.col(a) for a in "xyz")
    rows = scenes.moving(s, d).select("scene", "frame", "x", "y", "z", *(c.alias(n) for c, n in zip(V.transform(v, MATRIX, SHIFT), ("wx", "wy", "wz"), strict=True)))
    back = V.inverse_transform(tuple(F.col(a) for a in ("wx", "wy", "wz")), MATRIX, SHIFT)
    return whole(rows.withColumns(dict(zip(("ix", "iy", "iz"), back, strict=True))).withColumn("gx", V.gradient(v, MATRIX)[0]))


@query(f"""SELECT {VX}, least(15, floor((r - lo) / nullif((hi - lo)::DOUBLE, 0) * 15 + 0.5))::BIGINT AS code FROM (SELECT *, min(r) OVER (PARTITION BY scene, frame, bx, by, bz) AS lo, max(r) OVER (PARTITION BY scene, frame, bx, by, bz) AS hi FROM db)""")
def quantised_blocks(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("scene", "frame", *A.BRICK)
    v = A.addressed(scenes.dense(s, d)).withColumns({"lo": F.min("r").over(w).cast("double"), "hi": F.max("r").over(w).cast("double")})
    return whole(v.select("scene", "frame", "x", "y", "z", V.quantise(F.col("r"), F.col("lo"), F.col("hi"), 4).alias("code")))


CODED = "q AS (SELECT *, r / 255.0::DOUBLE AS v FROM db), lh AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM q WINDOW w AS (PARTITION BY scene, frame, bx, by, bz)), cd AS (SELECT *, least(top, floor((v - lo) / nullif(hi - lo, 0) * top + {dither})) AS code FROM lh, (VALUES {widths}) AS b(bits, top)), er AS (SELECT *, abs(lo + code * (hi - lo) / top - v) AS error FROM cd)"


def dithered_blocks(s, d):
    got = volumes.quantised(scenes.dense(s, d), F.col("r") / 255.0, 8, True)
    return whole(got.select("scene", "frame", "x", "y", "z", "code", F.round("error", 9).alias("error")))


_found["dithered_blocks"] = dithered_blocks, f"WITH {scenes.SQL[1:]}, {CODED.format(dither='vi * 40503 % 65536 / 65536.0::DOUBLE', widths='(8, 255.0::DOUBLE)')} SELECT {VX}, code::BIGINT AS code, round(error, 9) AS error FROM er"


def fitted_blocks(s, d):
    return whole(volumes.fitted(scenes.dense(s, d), F.col("r") / 255.0, 0.04))


_found["fitted_blocks"] = fitted_blocks, f"""WITH {scenes.SQL[1:]}, {CODED.format(dither='0.5', widths='(1, 1.0::DOUBLE), (2, 3.0), (4, 15.0), (8, 255.0), (16, 65535.0)')},
  ok AS (SELECT frame, bx, by, bz, coalesce(min(bits) FILTER (worst <= 0.04), 16) AS bits FROM (SELECT frame, bx, by, bz, bits, max(error) AS worst FROM er GROUP BY ALL) GROUP BY frame, bx, by, bz)
  SELECT scene, er.frame::BIGINT AS frame, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, er.bits::BIGINT AS bits, code::BIGINT AS code FROM er JOIN ok ON ok.frame = er.frame AND ok.bx = er.bx AND ok.by = er.by AND ok.bz = er.bz AND ok.bits = er.bits"""


# --- predicates and neighbours ---------------------------------------------------------------------------------------


@query(f"""SELECT {VX}, {RGB} FROM (SELECT *, lag(x) OVER wx = x - 1 AND lead(x) OVER wx = x + 1 AND lag(y) OVER wy = y - 1 AND lead(y) OVER wy = y + 1 AND lag(z) OVER wz = z - 1 AND lead(z) OVER wz = z + 1 AS inside FROM d
  WINDOW wx AS (PARTITION BY scene, frame, y, z ORDER BY x), wy AS (PARTITION BY scene, frame, x, z ORDER BY y), wz AS (PARTITION BY scene, frame, x, y ORDER BY z)) WHERE inside IS NOT TRUE""")
def visible_voxels(s, d):
    return whole(neighbours.visible(scenes.dense(s, d)))


@query("""SELECT scene, frame::BIGINT AS frame, count(*) AS n_visible FROM d LEFT JOIN (
  SELECT frame, x, y, z, count(*) AS k FROM (SELECT d.frame, d.x + dx AS x, d.y + dy AS y, d.z + dz AS z FROM d , (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS o(dx, dy, dz)) GROUP BY ALL) n
  USING (frame, x, y, z) WHERE coalesce(k, 0) < 6 GROUP BY ALL""")
def visible_counts(s, d):
    return whole(neighbours.visible(scenes.dense(s, d)).groupBy("scene", "frame").agg(F.count("*").alias("n_visible")))


@query("""SELECT p_partkey, 'D' AS scene, p.frame, p.x, p.y, p.z, (v.r IS NOT NULL)::BIGINT AS filled, coalesce(v.r, 0)::BIGINT AS r, coalesce(v.g, 0)::BIGINT AS g, coalesce(v.b, 0)::BIGINT AS b
  FROM (SELECT p_partkey, p_partkey % 8 AS frame, p_partkey * 3 % 20 AS x, p_partkey * 7 % 16 AS y, (p_size % 16)::BIGINT AS z FROM part) p LEFT JOIN d v ON p.frame = v.frame AND p.x = v.x AND p.y = v.y AND p.z = v.z""")
def point_lookups(s, d):
    k = F.col("p_partkey")
    cols = {"frame": k % 8, "x": k * 3 % 20, "y": k * 7 % 16, "z": F.col("p_size") % 16}
    cells = table(s, d, "part").select("p_partkey", F.lit("D").alias("scene"), *(c.cast("int").alias(n) for n, c in cols.items()))
    return whole(neighbours.at_cells(scenes.dense(s, d), cells))


@query("""SELECT o_orderkey, xmin, ymin, zmin, xmax, ymax, zmax, dx = 0 OR dy = 0 OR dz = 0 AS empty, dx AS dim_x, dy AS dim_y, dz AS dim_z, dx * dy * dz AS volume, CASE WHEN dx >= dy AND dx >= dz THEN 0 WHEN dy >= dz THEN 1 ELSE 2 END::BIGINT AS max_axis,
  xmin - 1 AS grown_xmin, ymin - 1 AS grown_ymin, zmin - 1 AS grown_zmin, xmax + 1 AS grown_xmax, ymax + 1 AS grown_ymax, zmax + 1 AS grown_zmax FROM (SELECT *, greatest(xmax - xmin + 1, 0) AS dx, greatest(ymax - ymin + 1, 0) AS dy, greatest(zmax - zmin + 1, 0) AS dz FROM (
  SELECT o_orderkey, o_orderkey % 5 AS xmin, o_orderkey % 7 AS ymin, o_orderkey % 3 AS zmin, o_custkey % 11 AS xmax, o_custkey % 6 AS ymax, o_custkey % 13 AS zmax FROM orders))""")
def box_algebra(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return whole(volumes.box_columns(table(s, d, "orders").select("o_orderkey", (k % 5).alias("xmin"), (k % 7).alias("ymin"), (k % 3).alias("zmin"), (c % 11).alias("xmax"), (c % 6).alias("ymax"), (c % 13).alias("zmax"))))


@query(f"SELECT {VX}, {RGB}, CASE WHEN x > 13 THEN 'outside' WHEN g > 250 THEN 'colour' END AS fault FROM d WHERE x > 13 OR g > 250")
def relation_violations(s, d):
    v = scenes.dense(s, d).withColumn("g", F.when(F.col("g") > 250, F.col("g") + 1000).otherwise(F.col("g")))
    return whole(volumes.violations(v, (14, 16, 16)).withColumn("g", F.when(F.col("g") > 1000, F.col("g") - 1000).otherwise(F.col("g"))))


def sample_points(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(F.lit("D").alias("scene"), (k % 8).cast("int").alias("frame"), k.alias("point"), (k % 61 / 4.0).alias("px"), (k % 47 / 4.0).alias("py"), (k % 53 / 4.0).alias("pz"))


POINTS = "SELECT 'D' AS scene, (p_partkey % 8)::INT AS frame, p_partkey AS point, p_partkey % 61 / 4.0::DOUBLE AS px, p_partkey % 47 / 4.0::DOUBLE AS py, p_partkey % 53 / 4.0::DOUBLE AS pz FROM part"
WEIGHTS = {
    0: (0, ["1.0::DOUBLE"]), 1: (0, ["1 - {t}", "{t}"]), 2: (-1, ["0.5 * {t} * ({t} - 1)", "1 - {t} * {t}", "0.5 * {t} * ({t} + 1)"]),
    3: (-1, ["-{t} * ({t} - 1) * ({t} - 2) / 6", "({t} + 1) * ({t} - 1) * ({t} - 2) / 2", "-({t} + 1) * {t} * ({t} - 2) / 2", "({t} + 1) * {t} * ({t} - 1) / 6"]),
}


def sample_sql(order: int) -> str:
    first, weights = WEIGHTS[order]
    base = "floor({p} + 0.5)" if order in (0, 2) else "floor({p})"
    axes = {a: "CASE o" + a + " " + " ".join(f"WHEN {k} THEN {w.format(t=f'(p{a} - b{a})')}" for k, w in enumerate(weights)) + " END" for a in "xyz"}
    bases = ", ".join(f"{base.format(p='p' + a)} AS b{a}" for a in "xyz")
    steps = " , ".join(f"generate_series(0, {order}) AS s{a}(o{a})" for a in "xyz")
    return f"""WITH {scenes.SQL[1:]}, p AS (SELECT *, {bases} FROM ({POINTS})), q AS (SELECT *, {axes['x']} AS wx, {axes['y']} AS wy, {axes['z']} AS wz FROM p, {steps})
    SELECT q.scene, q.frame::BIGINT AS frame, point, px, py, pz, round(sum(wx * wy * wz * coalesce(r, 0)), 6) + 0.0 AS sample FROM q LEFT JOIN d v ON v.frame = q.frame AND v.x = bx + {first} + ox AND v.y = by + {first} + oy AND v.z = bz + {first} + oz GROUP BY ALL"""


def _sampler(name: str, order: int):
    def f(s, d):
        got = neighbours.at_points(scenes.dense(s, d), sample_points(s, d), F.col("r"), order)
        return whole(got.withColumn("sample", F.round("sample", 6) + 0.0))

    f.__name__ = name
    _found[name] = f, sample_sql(order)


for _name, _order in (("sample_nearest", 0), ("sample_trilinear", 1), ("sample_triquadratic", 2), ("sample_tricubic", 3)):
    _sampler(_name, _order)

STENCIL = ", ".join(f"coalesce(max(r) FILTER (n = '{n}'), 0)::DOUBLE AS {n}" for n in neighbours.FACES | neighbours.EDGES)
OFFSETS = ", ".join(f"('{n}', {x}, {y}, {z})" for n, (x, y, z) in ({"v": (0, 0, 0)} | neighbours.FACES | neighbours.EDGES).items())
GATHERED = f"""st AS (SELECT scene, frame, x, y, z, max(r) FILTER (n = 'v')::DOUBLE AS v, {STENCIL} FROM (SELECT scene, frame, n, d.x - ox AS x, d.y - oy AS y, d.z - oz AS z, r FROM d , (VALUES {OFFSETS}) AS o(n, ox, oy, oz)) GROUP BY ALL HAVING v IS NOT NULL)"""


def gradients(s, d):
    return whole(neighbours.gradients(scenes.dense(s, d), F.col("r")))


UP = {a: f"({a}p - v)" for a in "xyz"}
DOWN = {a: f"(v - {a}m)" for a in "xyz"}
OUT = " + ".join(f"greatest(greatest({DOWN[a]}, 0) ** 2, least({UP[a]}, 0) ** 2)" for a in "xyz")
IN = " + ".join(f"greatest(least({DOWN[a]}, 0) ** 2, greatest({UP[a]}, 0) ** 2)" for a in "xyz")
_found["gradients"] = gradients, f"WITH {scenes.SQL[1:]}, {GATHERED} SELECT {VX}, v, 0.5 * (xp - xm) AS gx, 0.5 * (yp - ym) AS gy, 0.5 * (zp - zm) AS gz, xp + xm + yp + ym + zp + zm - 6 * v AS laplacian, CASE WHEN v > 0 THEN {OUT} ELSE {IN} END AS norm_squared FROM st"


def curvature(s, d):
    return whole(neighbours.curvature(scenes.dense(s, d), F.col("r")).withColumns({c: F.round(c, 5) + 0.0 for c in ("mean", "gaussian")}))


_found["curvature"] = curvature, f"""WITH {scenes.SQL[1:]}, {GATHERED}, df AS (SELECT *, 0.5 * (xp - xm) AS fx, 0.5 * (yp - ym) AS fy, 0.5 * (zp - zm) AS fz, xp - 2 * v + xm AS fxx, yp - 2 * v + ym AS fyy, zp - 2 * v + zm AS fzz,
  0.25 * (xpyp - xpym - xmyp + xmym) AS fxy, 0.25 * (xpzp - xpzm - xmzp + xmzm) AS fxz, 0.25 * (ypzp - ypzm - ymzp + ymzm) AS fyz FROM st), n AS (SELECT *, fx * fx + fy * fy + fz * fz AS n2 FROM df)
  SELECT {VX}, round((fx * fx * (fyy + fzz) + fy * fy * (fxx + fzz) + fz * fz * (fxx + fyy) - 2 * (fx * fy * fxy + fx * fz * fxz + fy * fz * fyz)) / (2 * pow(n2, 1.5)), 5) + 0.0 AS mean,
  round((fx * fx * (fyy * fzz - fyz * fyz) + fy * fy * (fxx * fzz - fxz * fxz) + fz * fz * (fxx * fyy - fxy * fxy) + 2 * (fx * fy * (fxz * fyz - fxy * fzz) + fx * fz * (fxy * fyz - fxz * fyy) + fy * fz * (fxy * fxz - fyz * fxx))) / (n2 * n2), 5) + 0.0 AS gaussian FROM n WHERE n2 > 0"""


CURVED = _found["curvature"][1].split("SELECT scene, frame::BIGINT")[0]
MEAN, GAUSS = re.search(r"round\((\(.*), 5\) \+ 0.0 AS mean,\s+round\((\(.*), 5\) \+ 0.0 AS gaussian", _found["curvature"][1], re.S).groups()


def principal_curvatures(s, d):
    return whole(neighbours.principal_curvatures(scenes.dense(s, d), F.col("r")).withColumns({c: F.round(c, 4) + 0.0 for c in ("least", "greatest")}))


_found["principal_curvatures"] = principal_curvatures, f"{CURVED} , pc AS (SELECT *, {MEAN} AS h, {GAUSS} AS kk FROM n WHERE n2 > 0) SELECT {VX}, round(h - sqrt(greatest(h * h - kk, 0)), 4) + 0.0 AS least, round(h + sqrt(greatest(h * h - kk, 0)), 4) + 0.0 AS greatest FROM pc"


def closest_points(s, d):
    return whole(neighbours.closest_points(scenes.dense(s, d), F.col("r")))


_found["closest_points"] = closest_points, f"WITH {scenes.SQL[1:]}, {GATHERED} SELECT {VX}, x - v * 0.5 * (xp - xm) AS cx, y - v * 0.5 * (yp - ym) AS cy, z - v * 0.5 * (zp - zm) AS cz FROM st"


def sample_slopes(s, d):
    got = neighbours.slopes_at_points(scenes.dense(s, d), sample_points(s, d), F.col("r"), 100.0)
    return whole(got.withColumns({c: F.round(c, 6) + 0.0 for c in ("gx", "gy", "gz")}))


def _cell_weights(a: str) -> str:
    return f"CASE o{a} WHEN 0 THEN 1 - (p{a} - floor(p{a})) ELSE p{a} - floor(p{a}) END AS w{a}, 2 * o{a} - 1 AS s{a}"


_found["sample_slopes"] = sample_slopes, f"""WITH {scenes.SQL[1:]}, q AS (SELECT *, {', '.join(map(_cell_weights, 'xyz'))} FROM ({POINTS}), generate_series(0, 1) AS a(ox), generate_series(0, 1) AS b(oy), generate_series(0, 1) AS c(oz))
  SELECT q.scene, q.frame::BIGINT AS frame, point, px, py, pz, round(sum(sx * wy * wz * coalesce(r, 0)), 6) + 0.0 AS gx, round(sum(wx * sy * wz * coalesce(r, 0)), 6) + 0.0 AS gy, round(sum(wx * wy * sz * coalesce(r, 0)), 6) + 0.0 AS gz,
  count(*) FILTER (coalesce(r, 0) < 100) BETWEEN 1 AND 7 AS crosses FROM q LEFT JOIN d v ON v.frame = q.frame AND v.x = floor(px) + ox AND v.y = floor(py) + oy AND v.z = floor(pz) + oz GROUP BY ALL"""


def weno_norms(s, d):
    return whole(neighbours.weno_norms(scenes.dense(s, d), F.col("r")).withColumn("norm_squared", F.round("norm_squared", 4)))




def _slope_sql(v: str) -> str:
    """The slope from five differences in a list, by the three stencils' parabolas, their smoothness and the weights 1 : 6 : 3."""
    return f"""list_transform([{v}], lambda v: list_transform([[
      1 / pow(1e-6 + 13 / 12.0 * pow(v[1] - 2 * v[2] + v[3], 2) + pow(v[1] - 4 * v[2] + 3 * v[3], 2) / 4.0, 2), 6 / pow(1e-6 + 13 / 12.0 * pow(v[2] - 2 * v[3] + v[4], 2) + pow(v[2] - v[4], 2) / 4.0, 2),
      3 / pow(1e-6 + 13 / 12.0 * pow(v[3] - 2 * v[4] + v[5], 2) + pow(3 * v[3] - 4 * v[4] + v[5], 2) / 4.0, 2)]], lambda w:
      (w[1] * (v[1] / 3.0 - 7 * v[2] / 6.0 + 11 * v[3] / 6.0) + w[2] * (-v[2] / 6.0 + 5 * v[3] / 6.0 + v[4] / 3.0) + w[3] * (v[3] / 3.0 + 5 * v[4] / 6.0 - v[5] / 6.0)) / (w[1] + w[2] + w[3]))[1])[1]"""


_found["weno_norms"] = weno_norms, f"""WITH {scenes.SQL[1:]}, o AS (SELECT a, k FROM (VALUES (0), (1), (2)) AS s(a), generate_series(-3, 3) AS t(k)),
  ne AS (SELECT q.scene, q.frame, q.x, q.y, q.z, q.r::DOUBLE AS v, a, k, coalesce(p.r, 0)::DOUBLE AS w FROM d q CROSS JOIN o LEFT JOIN d p ON p.frame = q.frame AND p.x = q.x + CASE a WHEN 0 THEN k ELSE 0 END AND p.y = q.y + CASE a WHEN 1 THEN k ELSE 0 END AND p.z = q.z + CASE a WHEN 2 THEN k ELSE 0 END),
  ln AS (SELECT scene, frame, x, y, z, v, a, list(w ORDER BY k) AS l FROM ne GROUP BY ALL),
  df AS (SELECT *, [l[2] - l[1], l[3] - l[2], l[4] - l[3], l[5] - l[4], l[6] - l[5]] AS low, [l[7] - l[6], l[6] - l[5], l[5] - l[4], l[4] - l[3], l[3] - l[2]] AS high FROM ln),
  sl AS (SELECT *, {_slope_sql('low')} AS down, {_slope_sql('high')} AS up FROM df)
  SELECT {VX}, round(sum(CASE WHEN v > 0 THEN greatest(pow(greatest(down, 0), 2), pow(least(up, 0), 2)) ELSE greatest(pow(least(down, 0), 2), pow(greatest(up, 0), 2)) END), 4) AS norm_squared FROM sl GROUP BY scene, frame, x, y, z"""


@query("SELECT scene, frame::BIGINT AS frame, y::BIGINT AS y, z::BIGINT AS z, min(x)::BIGINT AS x FROM (SELECT *, lag(x) OVER w = x - 1 AND (lag(r) OVER w > 150) <> (r > 150) AS crosses FROM d WINDOW w AS (PARTITION BY scene, frame, y, z ORDER BY x)) WHERE crosses GROUP BY scene, frame, y, z")
def zero_crossings(s, d):
    return whole(neighbours.zero_crossings(scenes.dense(s, d), F.col("r"), "x", 150.0))


@query(f"SELECT scene, frame::BIGINT AS frame, y::BIGINT AS y, z::BIGINT AS z, min(x)::BIGINT AS x, arg_min(r, x)::BIGINT AS r, arg_min(g, x)::BIGINT AS g, arg_min(b, x)::BIGINT AS b FROM d GROUP BY scene, frame, y, z")
def axis_first_hits(s, d):
    return whole(neighbours.first_hits_along(scenes.dense(s, d), "x"))


def ray_table(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(F.lit("D").alias("scene"), (k % 8).cast("int").alias("frame"), k.alias("ray"), (k % 13 - 3.25).alias("ox"), (k % 11 + 0.3125).alias("oy"), F.lit(-2.125).alias("oz"), (k % 3 - 1.0).alias("dx"), (k % 5 / 4.0 - 0.5).alias("dy"), F.lit(1.0).alias("dz"))


RAYS = "SELECT (s_suppkey % 8)::INT AS frame, s_suppkey AS ray, (s_suppkey % 13 - 3.25)::DOUBLE AS ox, (s_suppkey % 11 + 0.3125)::DOUBLE AS oy, -2.125::DOUBLE AS oz, (s_suppkey % 3 - 1.0)::DOUBLE AS dx, (s_suppkey % 5 / 4.0 - 0.5)::DOUBLE AS dy, 1.0::DOUBLE AS dz FROM supplier"


def _slabs(low: float, high: float) -> str:
    def side(f: str, pick: str) -> str:
        each = ", ".join(f"CASE WHEN d{a} <> 0 THEN {pick}(({low} - o{a}) / d{a}, ({high} - o{a}) / d{a}) WHEN o{a} BETWEEN {low} AND {high} THEN {'0.0' if pick == 'least' else chr(39) + 'infinity' + chr(39) + '::DOUBLE'} ELSE {chr(39) + 'infinity' + chr(39) + '::DOUBLE' if pick == 'least' else '-1.0'} END" for a in "xyz")
        return f"{f}({'0.0, ' if pick == 'least' else ''}{each})"

    return f"{side('greatest', 'least')} AS near, {side('least', 'greatest')} AS far"


@query(f"""SELECT ray, round(CASE WHEN near <= far THEN near END, 6) AS box_near, round(CASE WHEN near <= far THEN far END, 6) AS box_far, round(CASE WHEN disc >= 0 THEN (-sb - sqrt(greatest(disc, 0))) / (2 * sa) END, 6) AS sphere_near, round((8 - oz) / dz, 6) AS plane_at FROM (
  SELECT *, sb * sb - 4 * sa * ((ox - 8) ** 2 + (oy - 8) ** 2 + (oz - 8) ** 2 - 25) AS disc FROM (SELECT *, dx * dx + dy * dy + dz * dz AS sa, 2 * ((ox - 8) * dx + (oy - 8) * dy + (oz - 8) * dz) AS sb, {_slabs(0.0, 16.0)} FROM ({RAYS})))""")
def ray_intersections(s, d):
    o, v = (tuple(F.col(f"{p}{a}") for a in "xyz") for p in "od")
    lit = lambda x: (F.lit(x),) * 3
    near, far = neighbours.ray_box(o, v, lit(0.0), lit(16.0))
    ball, _ = neighbours.ray_sphere(o, v, lit(8.0), F.lit(5.0))
    plane = neighbours.ray_plane(o, v, (F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(8.0))
    return ray_table(s, d).select("ray", *(F.round(c, 6).alias(n) for c, n in ((near, "box_near"), (far, "box_far"), (ball, "sphere_near"), (plane, "plane_at"))))


@query(f"""SELECT ray, round(CASE WHEN greatest(near, 1) <= least(far, 12) THEN greatest(near, 1) END, 6) AS "start", round(CASE WHEN greatest(near, 1) <= least(far, 12) THEN least(far, 12) END, 6) AS stop FROM (SELECT *, {_slabs(2.0, 14.0)} FROM ({RAYS}))""")
def ray_clips(s, d):
    o, v = (tuple(F.col(f"{p}{a}") for a in "xyz") for p in "od")
    start, stop = neighbours.ray_clip(o, v, (F.lit(2.0),) * 3, (F.lit(14.0),) * 3, F.lit(1.0), F.lit(12.0))
    return ray_table(s, d).select("ray", F.round(start, 6).alias("start"), F.round(stop, 6).alias("stop"))


def ray_first_hits(s, d):
    return whole(neighbours.first_hits(scenes.dense(s, d), ray_table(s, d), (0, 0, 0), (15, 15, 15)).withColumn("t", F.round("t", 6)))


_found["ray_first_hits"] = ray_first_hits, f"""WITH {scenes.SQL[1:]}, q AS (SELECT *, {_slabs(0.0, 16.0)} FROM ({RAYS})), h AS (
  SELECT q.ray, q.frame, v.x, v.y, v.z, {', '.join(f"CASE WHEN d{a} > 0 THEN (v.{a} - o{a}) / d{a} WHEN d{a} < 0 THEN (v.{a} + 1 - o{a}) / d{a} ELSE -1e9 END AS n{a}, CASE WHEN d{a} > 0 THEN (v.{a} + 1 - o{a}) / d{a} WHEN d{a} < 0 THEN (v.{a} - o{a}) / d{a} ELSE 1e9 END AS f{a}" for a in 'xyz')}
  FROM q JOIN d v ON v.frame = q.frame WHERE near <= far AND {' AND '.join(f"(d{a} <> 0 OR (o{a} >= v.{a} AND o{a} < v.{a} + 1))" for a in 'xyz')}), t AS (SELECT *, greatest(nx, ny, nz, 0) AS t, least(fx, fy, fz) AS u FROM h)
  SELECT 'D' AS scene, frame::BIGINT AS frame, ray, arg_min(x, t)::BIGINT AS x, arg_min(y, t)::BIGINT AS y, arg_min(z, t)::BIGINT AS z, round(min(t), 6) AS t FROM t WHERE t < u GROUP BY frame, ray"""


# --- time -----------------------------------------------------------------------------------------------------------


@query(f"SELECT {FR}, CASE WHEN frame % 4 = 0 THEN 'I' ELSE 'P' END AS type, (frame // 4)::BIGINT AS gop, (frame + 1) % 4 = 0 AS can_free FROM (SELECT DISTINCT scene, frame FROM d )")
def frame_index(s, d):
    return whole(frames.frame_index(scenes.dense(s, d).select("scene", "frame").distinct(), GOP))


@query("""SELECT scene, frame, type, coalesce(max(CASE WHEN type = 'I' THEN frame END) OVER (ORDER BY frame), -1) AS prev_i, coalesce(min(CASE WHEN type = 'I' THEN frame END) OVER (ORDER BY frame DESC), -1) AS next_i FROM (
  SELECT DISTINCT scene, frame::BIGINT AS frame, CASE WHEN frame % 4 = 0 THEN 'I' ELSE 'P' END AS type FROM d )""")
def key_frames(s, d):
    return whole(frames.key_frames(frames.frame_index(scenes.dense(s, d).select("scene", "frame").distinct(), GOP)))


@query("SELECT scene, frame, unnest(generate_series(frame // 4 * 4, frame - 1)) AS needs FROM (SELECT DISTINCT scene, frame::BIGINT AS frame FROM d ) WHERE frame % 4 <> 0")
def dependencies_recursive(s, d):
    return whole(frames.dependencies(frames.frame_index(scenes.dense(s, d).select("scene", "frame").distinct(), GOP), True))


@query("SELECT scene, frame, frame - 1 AS needs FROM (SELECT DISTINCT scene, frame::BIGINT AS frame FROM d ) WHERE frame % 4 <> 0")
def dependencies_direct(s, d):
    return whole(frames.dependencies(frames.frame_index(scenes.dense(s, d).select("scene", "frame").distinct(), GOP), False))


@query("SELECT scene, 2::BIGINT AS needs, 3::BIGINT AS frame FROM (SELECT DISTINCT scene FROM d )")
def dependencies_missing(s, d):
    return whole(frames.missing_dependencies(frames.frame_index(scenes.dense(s, d).where("frame <> 2").select("scene", "frame").distinct(), GOP)))


@query(f"SELECT {BR}, vi::BIGINT AS vi, {', '.join(f'(({c} - coalesce(lag({c}) OVER w, 0) + 256) % 256)::BIGINT AS d{c}' for c in 'rgb')} FROM db WINDOW w AS ({P})")
def intra_deltas(s, d):
    return whole(frames.intra_deltas(scenes.dense(s, d)))


@query(f"SELECT {BR}, vi::BIGINT AS vi, {RGB} FROM db")
def intra_round_trip(s, d):
    return whole(frames.intra_colours(frames.intra_deltas(scenes.dense(s, d))))


@query(f"SELECT scene, frame, bx, by, bz, min(vi)::BIGINT AS start, count(*) AS len, ((count(*) + 126) // 127)::BIGINT AS bytes FROM (SELECT {BR}, vi, vi - row_number() OVER ({P}) AS island FROM db) GROUP BY scene, frame, bx, by, bz, island")
def filled_runs(s, d):
    return whole(frames.runs(A.addressed(scenes.dense(s, d))))


@query(f"""SELECT scene, frame, bx, by, bz, min(vi)::BIGINT AS start, count(*) AS len, ((count(*) + 126) // 127)::BIGINT AS bytes, f::BIGINT AS filled FROM (SELECT *, vi - row_number() OVER (PARTITION BY scene, frame, bx, by, bz, f ORDER BY vi) AS island FROM (
  SELECT c.*, (e.vi IS NOT NULL)::INT AS f FROM (SELECT DISTINCT {BR}, i AS vi FROM db , generate_series(0, 511) AS t(i)) c LEFT JOIN db e ON e.frame = c.frame AND e.bx = c.bx AND e.by = c.by AND e.bz = c.bz AND e.vi = c.vi)) GROUP BY scene, frame, bx, by, bz, f, island""")
def occupancy_runs(s, d):
    return whole(frames.all_runs(A.addressed(scenes.dense(s, d))))


@query(f"SELECT {BR}, vi::BIGINT AS vi FROM db")
def runs_round_trip(s, d):
    return whole(frames.expand_runs(frames.all_runs(A.addressed(scenes.dense(s, d)))))


CHANGES = f"""ch AS (SELECT coalesce(c.scene, p.scene) AS scene, coalesce(c.frame, p.frame + 1) AS frame, coalesce(c.x, p.x) AS x, coalesce(c.y, p.y) AS y, coalesce(c.z, p.z) AS z, (c.x IS NOT NULL)::INT AS filled, (p.x IS NOT NULL)::INT AS was,
  coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b, coalesce(p.r, 0) AS pr, coalesce(p.g, 0) AS pg, coalesce(p.b, 0) AS pb FROM d c FULL JOIN d p ON c.frame = p.frame + 1 AND c.x = p.x AND c.y = p.y AND c.z = p.z), chb AS (SELECT *, {scenes.ADDRESS} FROM ch)"""


def frame_changes(s, d):
    return whole(frames.changes(scenes.dense(s, d)))


_found["frame_changes"] = frame_changes, f"WITH {scenes.SQL[1:]}, {CHANGES} SELECT {VX}, filled::BIGINT AS filled, was::BIGINT AS was, {RGB}, pr::BIGINT AS pr, pg::BIGINT AS pg, pb::BIGINT AS pb FROM ch"


def brick_modes(s, d):
    return whole(frames.brick_modes(scenes.dense(s, d), GOP))


_found["brick_modes"] = brick_modes, f"WITH {scenes.SQL[1:]}, {CHANGES} SELECT {BR.replace("frame::", "chb.frame::")}, sum(filled)::BIGINT AS n_voxels, sum((filled <> was)::INT)::BIGINT AS n_changed, CASE WHEN chb.frame % 4 = 0 OR sum((filled <> was)::INT) >= sum(filled) // 2 THEN 'I' ELSE 'P' END AS mode FROM chb GROUP BY scene, chb.frame, bx, by, bz HAVING sum(filled) > 0"


def change_runs(s, d):
    return whole(frames.change_runs(scenes.dense(s, d)))


_found["change_runs"] = change_runs, f"WITH {scenes.SQL[1:]}, {CHANGES} SELECT scene, frame, bx, by, bz, min(vi)::BIGINT AS start, count(*) AS len, ((count(*) + 126) // 127)::BIGINT AS bytes FROM (SELECT {BR}, vi, vi - row_number() OVER ({P}) AS island FROM chb WHERE filled <> was AND (frame, bx, by, bz) IN (SELECT (frame, bx, by, bz) FROM db)) GROUP BY scene, frame, bx, by, bz, island"


def colour_residuals(s, d):
    return whole(frames.residuals(scenes.dense(s, d)))


_found["colour_residuals"] = colour_residuals, f"WITH {scenes.SQL[1:]}, {CHANGES} SELECT {BR}, vi::BIGINT AS vi, {', '.join(f'(({c} - p{c} + 256) % 256)::BIGINT AS d{c}' for c in 'rgb')} FROM chb WHERE filled = 1"

NEAR = f"""o AS (SELECT dx, dy, dz FROM (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy), (VALUES (-1), (0), (1)) AS c(dz)),
 pv AS (SELECT frame + 1 AS frame, {{t}}.x - dx AS x, {{t}}.y - dy AS y, {{t}}.z - dz AS z, dx, dy, dz, r, g, b FROM {{t}} , o),
 sh AS (SELECT pv.frame, pv.x // 8 AS bx, pv.y // 8 AS by, pv.z // 8 AS bz, dx, dy, dz, count(*) AS nb, count(v.x) AS nm, sum(CASE WHEN v.x IS NULL THEN 0 ELSE abs(v.r - pv.r) + abs(v.g - pv.g) + abs(v.b - pv.b) END) AS sad FROM pv LEFT JOIN {{t}} v USING (frame, x, y, z) WHERE pv.x >= 0 AND pv.y >= 0 AND pv.z >= 0 GROUP BY ALL),
 nc AS (SELECT scene, frame, bx, by, bz, count(*) AS n FROM {{t}}b WHERE frame > 0 GROUP BY ALL),
 cost AS (SELECT scene, nc.frame, nc.bx, nc.by, nc.bz, o.dx, o.dy, o.dz, (768 * (n + coalesce(nb, 0) - 2 * coalesce(nm, 0)) + coalesce(sad, 0))::BIGINT AS cost FROM nc CROSS JOIN o LEFT JOIN sh ON sh.frame = nc.frame AND sh.bx = nc.bx AND sh.by = nc.by AND sh.bz = nc.bz AND sh.dx = o.dx AND sh.dy = o.dy AND sh.dz = o.dz)"""
VEC = "dx::BIGINT AS dx, dy::BIGINT AS dy, dz::BIGINT AS dz, cost"
BEST = "QUALIFY row_number() OVER (PARTITION BY scene, cost.frame, cost.bx, cost.by, cost.bz ORDER BY cost, (dx <> 0 OR dy <> 0 OR dz <> 0), cost.dz, cost.dy, cost.dx) = 1"


def near_motion_costs(s, d):
    return whole(motion.near_costs(scenes.dense(s, d)))


_found["near_motion_costs"] = near_motion_costs, f"WITH {scenes.SQL[1:]}, {NEAR.format(t='d')} SELECT {BR}, {VEC} FROM cost"


def near_motion(s, d):
    return whole(motion.best_near(scenes.dense(s, d)))


_found["near_motion"] = near_motion, f"WITH {scenes.SQL[1:]}, {NEAR.format(t='d')} SELECT {BR}, {VEC} FROM cost {BEST}"


def motion_search(s, d):
    """The whole hierarchical search on the moving scene; its best vectors are near ones there, so the near search's SQL says the same."""
    return whole(motion.search(scenes.moving(s, d)))


_found["motion_search"] = motion_search, f"WITH {scenes.SQL[1:]}, {NEAR.format(t='m')} SELECT {BR}, {VEC} FROM cost {BEST}"


def motion_search_dense(s, d):
    return whole(motion.search(scenes.dense(s, d)))


def _cost_sql(candidates: str) -> str:
    """Costs of candidate vectors of bricks: mismatches of the shifted frame before, and colour differences where both are filled."""
    return f"""SELECT k.frame, k.bx, k.by, k.bz, k.dx, k.dy, k.dz, 768 * (any_value(k.n) + count(p.x) - 2 * count(v.x)) + coalesce(sum(abs(v.r - p.r) + abs(v.g - p.g) + abs(v.b - p.b)), 0) AS cost FROM {candidates} k
      LEFT JOIN d p ON p.frame = k.frame - 1 AND (p.x - k.dx) // 8 = k.bx AND p.x >= k.dx AND (p.y - k.dy) // 8 = k.by AND p.y >= k.dy AND (p.z - k.dz) // 8 = k.bz AND p.z >= k.dz
      LEFT JOIN d v ON v.frame = k.frame AND v.x = p.x - k.dx AND v.y = p.y - k.dy AND v.z = p.z - k.dz GROUP BY ALL"""


def _better_sql(before: str, costs: str) -> str:
    """The best vector so far, or the first of the least cost if that is less."""
    return f"""SELECT b.frame, b.bx, b.by, b.bz, n, CASE WHEN k.cost < b.cost THEN k.dx ELSE b.dx END AS dx, CASE WHEN k.cost < b.cost THEN k.dy ELSE b.dy END AS dy, CASE WHEN k.cost < b.cost THEN k.dz ELSE b.dz END AS dz, least(b.cost, coalesce(k.cost, b.cost)) AS cost FROM {before} b
      LEFT JOIN (SELECT * FROM {costs} c QUALIFY row_number() OVER (PARTITION BY c.frame, c.bx, c.by, c.bz ORDER BY c.cost, c.dz, c.dy, c.dx) = 1) k ON k.frame = b.frame AND k.bx = b.bx AND k.by = b.by AND k.bz = b.bz"""


_found["motion_search_dense"] = motion_search_dense, f"""WITH {scenes.SQL[1:]}, o AS (SELECT ox, oy, oz FROM (VALUES (-1), (0), (1)) AS a(ox), (VALUES (-1), (0), (1)) AS b(oy), (VALUES (-1), (0), (1)) AS c(oz)),
  nb AS (SELECT frame, bx, by, bz, count(*) AS n FROM db WHERE frame > 0 GROUP BY ALL),
  z0 AS (SELECT *, 0 AS dx, 0 AS dy, 0 AS dz FROM nb), y0 AS ({_cost_sql('z0')}), b0 AS (SELECT nb.*, dx, dy, dz, cost FROM nb JOIN y0 USING (frame, bx, by, bz)),
  z1 AS (SELECT nb.*, ox AS dx, oy AS dy, oz AS dz FROM nb, o), y1 AS ({_cost_sql('z1')}), b1 AS ({_better_sql('b0', 'y1')}),
  z2 AS (SELECT nb.*, 4 * ox AS dx, 4 * oy AS dy, 4 * oz AS dz FROM nb, o), y2 AS ({_cost_sql('z2')}), b2 AS ({_better_sql('b1', 'y2')}),
  w2 AS (SELECT *, greatest(abs(dx), abs(dy), abs(dz)) AS far FROM b2),
  z3 AS (SELECT w2.frame, w2.bx, w2.by, w2.bz, n, dx + s * ox AS dx, dy + s * oy AS dy, dz + s * oz AS dz FROM (SELECT *, CASE WHEN far > 1 THEN 2 ELSE 1 END AS s FROM w2 WHERE far > 0) w2, o WHERE far > 1 OR greatest(abs(dx + ox), abs(dy + oy), abs(dz + oz)) > 1),
  y3 AS ({_cost_sql('z3')}), b3 AS ({_better_sql('b2', 'y3')}),
  z4 AS (SELECT b3.frame, b3.bx, b3.by, b3.bz, b3.n, b3.dx + ox AS dx, b3.dy + oy AS dy, b3.dz + oz AS dz FROM b3 JOIN w2 USING (frame, bx, by, bz), o WHERE far > 1), y4 AS ({_cost_sql('z4')}), b4 AS ({_better_sql('b3', 'y4')})
  SELECT 'D' AS scene, frame::BIGINT AS frame, bx::BIGINT AS bx, by::BIGINT AS by, bz::BIGINT AS bz, dx::BIGINT AS dx, dy::BIGINT AS dy, dz::BIGINT AS dz, cost::BIGINT AS cost FROM b4"""


def motion_residuals(s, d):
    v = scenes.moving(s, d)
    return whole(frames.residuals(v, motion.best_near(v).drop("cost")))


_found["motion_residuals"] = motion_residuals, f"WITH {scenes.SQL[1:]} SELECT {BR}, vi::BIGINT AS vi, CASE WHEN frame = 0 THEN r ELSE 0 END::BIGINT AS dr, CASE WHEN frame = 0 THEN g ELSE 0 END::BIGINT AS dg, CASE WHEN frame = 0 THEN b ELSE 0 END::BIGINT AS db FROM mb"


@query("""WITH e AS (SELECT 'V' || o_custkey % 50 AS scene, o_orderkey % 97 AS k, min(o_orderkey) AS m FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL), f AS (SELECT scene, unnest(generate_series(0, max(k))) AS frame FROM e GROUP BY scene)
  SELECT scene, frame, coalesce(max_by(m, k) FILTER (k <= frame), min_by(m, k))::BIGINT AS model FROM f JOIN e USING (scene) GROUP BY scene, frame""")
def model_fill(s, d):
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").where(k % 5 == 0).groupBy(F.concat(F.lit("V"), F.col("o_custkey") % 50).alias("scene"), (k % 97).cast("int").alias("frame"))
    return whole(frames.fill_frames(rows.agg(F.min(k).alias("model"))))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_orderkey END AS frame FROM orders")
def model_frames(s, d):
    """The frame of a model from its attributes: its `_f` as a number, 0 if that isn't one, or the entry where there is none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    attributes = F.when(k % 3 == 0, F.create_map(F.lit("_f"), c)).when(k % 3 == 1, F.create_map(F.lit("_f"), F.lit("none"))).otherwise(F.create_map(F.lit("name"), c))
    rows = table(s, d, "orders").select("o_orderkey", attributes.alias("attributes"))
    return whole(rows.select("o_orderkey", voxfile.frame_of("attributes", k).alias("frame")))


@query(f"SELECT scene, frame::BIGINT AS frame, x::BIGINT AS x, z::BIGINT AS y, y::BIGINT AS z, {RGB} FROM m")
def up_axis_swapped(s, d):
    return whole(volumes.permuted(scenes.moving(s, d), ("x", "z", "y")).select(*scenes.VOXEL))


@query()
def brick_checksums(s, d):
    return whole(bricks.checksums(scenes.dense(s, d)))


# --- streams --------------------------------------------------------------------------------------------------------


@query(f"SELECT 'joined' AS scene, frame::BIGINT AS frame, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {RGB} FROM d UNION ALL SELECT 'joined', (SELECT n FROM dn) + frame::BIGINT, x, y, z, r, g, b FROM m UNION ALL SELECT 'joined', (SELECT n FROM dn) + (SELECT n FROM mn) + frame::BIGINT, x, y, z, r, g, b FROM d")
def stream_concat(s, d):
    one, two = scenes.dense(s, d), scenes.moving(s, d)
    return whole(frames.concat([one, two, one], counts=[scenes.dense_frames(s, d), scenes.moving_frames(s, d), scenes.dense_frames(s, d)]).select(*scenes.VOXEL))


@query(f"SELECT {VX}, {RGB}, (frame // 3)::BIGINT AS part, (frame % 3)::BIGINT AS part_frame FROM d")
def stream_split(s, d):
    return whole(frames.split(scenes.dense(s, d), 1.0, 3.5))


@query(f"SELECT {VX}, CASE WHEN bool_or(k = 1) THEN 'first' ELSE 'second' END AS only_in FROM (SELECT *, 1 AS k FROM d WHERE x < 12 UNION ALL SELECT *, 2 AS k FROM d WHERE x > 3) GROUP BY scene, frame, x, y, z HAVING count(*) = 1")
def occupancy_difference(s, d):
    v = scenes.dense(s, d)
    return whole(frames.occupancy_difference(v.where("x < 12"), v.where("x > 3")))


@query(f"SELECT {VX}, {RGB} FROM d WHERE frame = 5")
def single_frame(s, d):
    return whole(scenes.dense(s, d).where("frame = 5"))


@query("SELECT scene, frame::BIGINT AS frame, round(avg(r / 255.0), 6) AS r, round(avg(g / 255.0), 6) AS g, round(avg(b / 255.0), 6) AS b, 'frame_' || frame || '.nvdb' AS file FROM m GROUP BY scene, frame")
def dump_frames(s, d):
    share = [F.round(F.avg(F.col(c) / 255.0), 6).alias(c) for c in "rgb"]
    return whole(scenes.moving(s, d).groupBy("scene", "frame").agg(*share).withColumn("file", F.concat(F.lit("frame_"), F.col("frame"), F.lit(".nvdb"))))


# --- volumes --------------------------------------------------------------------------------------------------------

CUBE = "SELECT x, y, z FROM generate_series(-12, 12) AS a(x), generate_series(-12, 12) AS b(y), generate_series(-12, 12) AS c(z)"
BOX = ((-12, -12, -12), (12, 12, 12))


def _primitive(name: str, distance, sql: str, kind: str):
    def f(s, d):
        cells = volumes.grid(s, BOX)
        got = (volumes.level_set if kind == "level_set" else volumes.fog)(cells, distance())
        return whole(got.withColumn("value", F.round("value", 6) + 0.0))

    f.__name__ = name
    shown, kept = (f"round({sql}, 6) + 0.0", f"abs({sql}) < 3") if kind == "level_set" else (f"round(least(1.0, -({sql}) / 3), 6) + 0.0", f"least(1.0, -({sql}) / 3) > 0")
    _found[name] = f, f"SELECT x, y, z, {shown} AS value FROM ({CUBE}) WHERE {kept}"


_primitive("sphere_level_set", lambda: volumes.sphere_distance(8.0), "sqrt(x * x + y * y + z * z) - 8", "level_set")
_primitive("sphere_fog", lambda: volumes.sphere_distance(8.0), "sqrt(x * x + y * y + z * z) - 8", "fog")
_primitive("torus_level_set", lambda: volumes.torus_distance(8.0, 3.0), "sqrt(pow(sqrt(x * x + z * z) - 8, 2) + y * y) - 3", "level_set")
_primitive("box_level_set", lambda: volumes.box_distance((10, 8, 6)), "sqrt(pow(greatest(abs(x) - 5.0, 0), 2) + pow(greatest(abs(y) - 4.0, 0), 2) + pow(greatest(abs(z) - 3.0, 0), 2)) + least(greatest(abs(x) - 5.0, abs(y) - 4.0, abs(z) - 3.0), 0)", "level_set")
_primitive("octahedron_level_set", lambda: volumes.octahedron_distance(16.0), "(abs(x) + abs(y) + abs(z) - 8.0)::DOUBLE * 0.57735027::DOUBLE", "level_set")


TORUS = "sqrt(pow(sqrt(x * x + z * z) - 8, 2) + y * y) - 3"
BOXED = "sqrt(pow(greatest(abs(x) - 5.0, 0), 2) + pow(greatest(abs(y) - 4.0, 0), 2) + pow(greatest(abs(z) - 3.0, 0), 2)) + least(greatest(abs(x) - 5.0, abs(y) - 4.0, abs(z) - 3.0), 0)"
_primitive("torus_fog", lambda: volumes.torus_distance(8.0, 3.0), TORUS, "fog")
_primitive("box_fog", lambda: volumes.box_distance((10, 8, 6)), BOXED, "fog")
_primitive("octahedron_fog", lambda: volumes.octahedron_distance(16.0), "(abs(x) + abs(y) + abs(z) - 8.0)::DOUBLE * 0.57735027::DOUBLE", "fog")


def _surface_points(name: str, distance, sql: str):
    def f(s, d):
        cells = volumes.level_set(volumes.grid(s, BOX), distance(), 1.0)
        points = volumes.scatter(cells.select("x", "y", "z"), 3).withColumns({"scene": F.lit("P"), "frame": F.lit(0)})
        return whole(volumes.points_by(points, "voxel").drop("scene", "frame"))

    f.__name__ = name
    _found[name] = f, f"SELECT x AS kx, y AS ky, z AS kz, 3::BIGINT AS n_points FROM ({CUBE}) WHERE abs({sql}) < 1"


_surface_points("sphere_points", lambda: volumes.sphere_distance(8.0), "sqrt(x * x + y * y + z * z) - 8")
_surface_points("box_points", lambda: volumes.box_distance((10, 8, 6)), BOXED)


def _frame_sql() -> str:
    p = {a: f"(abs({a}) - {h})" for a, h in zip("xyz", (6.0, 5.0, 4.0), strict=True)}
    q = {a: f"(abs({p[a]} + 1) - 1)" for a in "xyz"}
    bars = []
    for along in "xyz":
        b = [p[a] if a == along else q[a] for a in "xyz"]
        bars.append(f"(sqrt({' + '.join(f'pow(greatest({x}, 0), 2)' for x in b)}) + least(greatest({', '.join(b)}), 0))")
    return f"least({', '.join(bars)})::DOUBLE"


_primitive("box_frame_level_set", lambda: volumes.box_frame_distance((12, 10, 8), 1.0), _frame_sql(), "level_set")


@query(f"SELECT x AS kx, y AS ky, z AS kz, 2::BIGINT AS n_points FROM ({CUBE}) WHERE abs(sqrt(pow(sqrt(x * x + z * z) - 8, 2) + y * y) - 3) < 1")
def torus_points(s, d):
    cells = volumes.level_set(volumes.grid(s, BOX), volumes.torus_distance(8.0, 3.0), 1.0)
    points = volumes.scatter(cells.select("x", "y", "z"), 2).withColumns({"scene": F.lit("P"), "frame": F.lit(0)})
    return whole(volumes.points_by(points, "voxel").drop("scene", "frame"))


@query("SELECT (k // 81)::BIGINT AS x, (k // 9 % 9)::BIGINT AS y, (k % 9)::BIGINT AS z, 3::BIGINT AS n_points FROM generate_series(0, 728) AS t(k)")
def point_scatter(s, d):
    points = volumes.scatter(volumes.grid(s, ((0, 0, 0), (8, 8, 8))), 3).withColumns({"scene": F.lit("P"), "frame": F.lit(0)})
    by = volumes.points_by(points, "voxel")
    return whole(by.select(F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z"), "n_points"))


@query("""SELECT 'D' AS scene, (p_partkey % 8) AS frame, (floor(p_partkey % 61 / 4.0 + 0.5)::BIGINT // 8) AS kx, (floor(p_partkey % 47 / 4.0 + 0.5)::BIGINT // 8) AS ky, (floor(p_partkey % 53 / 4.0 + 0.5)::BIGINT // 8) AS kz, count(*) AS n_points FROM part GROUP BY ALL""")
def points_by_leaf(s, d):
    return whole(volumes.points_by(sample_points(s, d), "leaf"))


# --- files ----------------------------------------------------------------------------------------------------------


def _round_trip(name: str, scene, dims: tuple[int, int, int], t: str, gop: int, group: int, motion_vectors: bool):
    def f(s, d):
        import warnings

        folder = shared_folder(s, name)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            params = container.Params(gop, group, motion_vectors)
        container.write(scene(s, d), folder, dims, 30.0, params, 8)
        return whole(container.read(s, folder).withColumn("scene", F.regexp_extract("scene", r"^([^.]*)", 1)))

    f.__name__ = name
    _found[name] = f, f"WITH {scenes.SQL[1:]} SELECT {VX}, {RGB} FROM {t}"


_round_trip("encode_decode_dense", scenes.dense, (16, 16, 16), "d", 4, 3, False)
_round_trip("encode_decode_moving", scenes.moving, (32, 24, 24), "m", 4, 0, True)


@query(f"SELECT {FR}, CASE WHEN frame % 4 = 0 THEN 'I' ELSE 'P' END AS type, count(*) AS voxels FROM d GROUP BY ALL")
def encoded_frames(s, d):
    blocks = container.encode_groups(scenes.dense(s, d), (16, 16, 16), container.Params(4, 0, True))
    return whole(blocks.select("scene", "frame", "type", "voxels"))


@query()
def encoded_sizes(s, d):
    return whole(container.encoded_sizes(container.encode_groups(scenes.moving(s, d), (32, 24, 24), container.Params(4, 0, True))))


@query(f"SELECT {VX}, {RGB} FROM m")
def grid_files(s, d):
    folder = shared_folder(s, "grids")
    nvdb.save(scenes.moving(s, d), folder).collect()  # one row a frame
    rows = nvdb.load(s.read.format("binaryFile").load(f"{folder}/M"), ((0, 0, 0), (31, 31, 31)))
    return whole(rows.withColumn("frame", F.regexp_extract("scene", r"frame_(\d+)", 1).cast("int")).withColumn("scene", F.lit("M")))


@query("SELECT 'frame_' || frame || '.nvdb' AS scene, 'volume' AS grid, count(*) AS voxels, '' AS faults FROM d GROUP BY frame")
def grid_checks(s, d):
    folder = shared_folder(s, "checked-grids")
    nvdb.save(scenes.dense(s, d), folder).collect()  # one row a frame
    return nvdb.checked(s.read.format("binaryFile").load(f"{folder}/D"))


@query(f"SELECT {VX}, {RGB} FROM d WHERE r + g > 100")
def dense_array_frames(s, d):
    v = scenes.dense(s, d)
    share = {f"c{c}": (F.col(c) + 0.25) / 255.0 for c in "rgb"} | {"ca": F.when(F.col("r") + F.col("g") > 100, 1.0).otherwise(0.003)}
    return whole(arrays.dense_cells(v.withColumns(share).select("scene", "frame", "x", "y", "z", "cr", "cg", "cb", "ca")))


@query(f"SELECT {VX}, {RGB} FROM d")
def flat_array_frames(s, d):
    v = scenes.dense(s, d)
    cell = F.struct(*((F.col(c) + 0.25) / 255.0 for c in "rgb"), F.lit(1.0))
    listed = v.select("scene", "frame", (F.col("x") + 16 * F.col("y") + 256 * F.col("z")).alias("i"), cell.cast("struct<r:double,g:double,b:double,a:double>").alias("c"))
    none = F.struct(*(F.lit(0.0).alias(c) for c in "rgba"))
    return whole(arrays.flat_arrays(arrays.filled_arrays(listed, 4096, none), (16, 16, 16)))
