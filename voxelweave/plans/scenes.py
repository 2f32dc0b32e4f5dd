"""Two deterministic scenes made from the driver's tables, as DataFrames and as SQL.

Frames are 16^3 cells; their number grows with the table, so queries read as much as the scale factor says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXEL = ("scene", "frame", "x", "y", "z", "r", "g", "b")


#: Rows of lineitem and of part for each eight frames.
DENSE_ROWS, MOVING_ROWS = 150_000, 5_000


def frames_of(rows: DataFrame, each: int) -> int:
    return 8 * max(1, rows.count() // each)


def dense_frames(spark: SparkSession, sf_dir: str) -> int:
    return frames_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), DENSE_ROWS)


def moving_frames(spark: SparkSession, sf_dir: str) -> int:
    return frames_of(spark.read.parquet(f"{sf_dir}/part.parquet"), MOVING_ROWS)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene D: 16^3 cells, unrelated from frame to frame."""
    n = dense_frames(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    k = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 1299709, F.lit(4096 * n))
    # a cell has some four rows, spread over the table: adding up before the shuffle would hold nearly all rows of a task, and save little
    rows = rows.select(k.alias("k"), (F.col("l_quantity").cast("long") * 5).alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).repartition("k")
    by = rows.groupBy("k").agg(*(F.max(c).alias(c) for c in "qps"))
    k = F.col("k")
    cols = {"frame": k % n, "x": F.floor(k / n) % 16, "y": F.floor(k / (16 * n)) % 16, "z": F.floor(k / (256 * n)) % 16, "r": F.col("q") % 256, "g": F.col("p") % 256, "b": F.col("s") % 256}
    return by.select(F.lit("D").alias("scene"), *(c.cast("int").alias(n) for n, c in cols.items()))


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene M: a cloud that moves by one cell in x from frame to frame, seven times forth, then back."""
    n = moving_frames(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    by = part.groupBy(F.pmod(F.col("p_partkey") * 7919, F.lit(4096)).alias("k")).agg(F.min(F.col("p_partkey") * 37 % 256).alias("r"), F.min(F.col("p_partkey") * 101 % 256).alias("g"), F.min("p_size").alias("b"))
    # a join with the frames and not an explosion, whose rows the planner wouldn't count: it would broadcast the scene, and make it in one task
    rows = spark.range(n).withColumnRenamed("id", "frame").crossJoin(F.broadcast(by))
    moved = F.least(F.col("frame") % 16, 15 - F.col("frame") % 16)
    cols = {"frame": F.col("frame"), "x": 8 + F.col("k") % 16 + moved, "y": 8 + F.floor(F.col("k") / 16) % 16, "z": 8 + F.floor(F.col("k") / 256), "r": F.col("r"), "g": F.col("g"), "b": F.col("b")}
    return rows.select(F.lit("M").alias("scene"), *(c.cast("int").alias(n) for n, c in cols.items()))


ADDRESS = "x // 8 AS bx, y // 8 AS by, z // 8 AS bz, x % 8 + 8 * (y % 8) + 64 * (z % 8) AS vi"

SQL = f"""
dn AS (SELECT 8 * greatest(1, count(*) // {DENSE_ROWS}) AS n FROM lineitem), mn AS (SELECT 8 * greatest(1, count(*) // {MOVING_ROWS}) AS n FROM part),
d AS (SELECT 'D' AS scene, (k % n)::INT AS frame, (k // n % 16)::INT AS x, (k // (16 * n) % 16)::INT AS y, (k // (256 * n) % 16)::INT AS z, (q % 256)::INT AS r, (p % 256)::INT AS g, (s % 256)::INT AS b FROM (
  SELECT (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % (4096 * n) AS k, n, max(l_quantity::BIGINT * 5) AS q, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem, dn GROUP BY 1, 2)),
m AS (SELECT 'M' AS scene, f::INT AS frame, (8 + k % 16 + least(f % 16, 15 - f % 16))::INT AS x, (8 + k // 16 % 16)::INT AS y, (8 + k // 256)::INT AS z, r::INT AS r, g::INT AS g, b::INT AS b FROM (
  SELECT p_partkey * 7919 % 4096 AS k, min(p_partkey * 37 % 256) AS r, min(p_partkey * 101 % 256) AS g, min(p_size) AS b FROM part GROUP BY 1), (SELECT unnest(generate_series(0, n - 1)) AS f FROM mn)),
db AS (SELECT *, {ADDRESS} FROM d),
mb AS (SELECT *, {ADDRESS} FROM m)"""
