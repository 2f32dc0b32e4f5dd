"""Column expressions of scalar, vector, integer-coordinate and affine arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def fract(x: Column) -> Column:
    return x - F.floor(x)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sign(x: Column) -> Column:
    return (x > 0).cast("int") - (x < 0).cast("int")


def least_axis(v: Vector) -> Column:
    """0-based axis of the smallest component, the first on ties."""
    values = F.array(*v)
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def greatest_axis(v: Vector) -> Column:
    values = F.array(*v)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dot(a: Vector, b: Vector) -> Column:
    first, *rest = (x * y for x, y in zip(a, b, strict=True))
    for x in rest:
        first = first + x
    return first


def cross(a: Vector, b: Vector) -> Vector:
    return tuple(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3))


def length(v: Vector) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Vector) -> Vector:
    n = length(v)
    return tuple(x / F.nullif(n, F.lit(0.0)) for x in v)


def transform(v: Vector, matrix: list[list[float]], shift: list[float]) -> Vector:
    """Index space to world space."""
    return tuple(dot(tuple(F.lit(float(m)) for m in row), v) + float(s) for row, s in zip(matrix, shift, strict=True))


def inverse(matrix: list[list[float]]) -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(matrix, dtype=float)).tolist()


def inverse_transform(v: Vector, matrix: list[list[float]], shift: list[float]) -> Vector:
    """World space to index space."""
    return transform(tuple(x - float(s) for x, s in zip(v, shift, strict=True)), inverse(matrix), [0, 0, 0])


def direction(v: Vector, matrix: list[list[float]]) -> Vector:
    return transform(v, matrix, [0, 0, 0])


def gradient(v: Vector, matrix: list[list[float]]) -> Vector:
    """A gradient goes by the inverse transpose."""
    return transform(v, [list(c) for c in zip(*inverse(matrix), strict=True)], [0, 0, 0])


def octant(x: Column, y: Column, z: Column) -> Column:
    """Which of the eight sign octants: bit 0 for x < 0, 1 for y < 0, 2 for z < 0."""
    return (x < 0).cast("int") + 2 * (y < 0).cast("int") + 4 * (z < 0).cast("int")


def coordinate_hash(x: Column, y: Column, z: Column, bits: int) -> Column:
    # The multipliers of the spatial hash.
    mixed = (x.cast("long") * 73856093).bitwiseXOR(y.cast("long") * 19349663).bitwiseXOR(z.cast("long") * 83492791)
    return mixed.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def quantise(value: Column, low: Column, high: Column, bits: int, dither: Column | float = 0.5) -> Column:
    """A value in low..high as an integer code of `bits` bits."""
    top = (1 << bits) - 1
    return F.least(F.lit(top), F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * top + dither)).cast("int")


def dequantise(code: Column, low: Column, high: Column, bits: int) -> Column:
    return low + code * (high - low) / float((1 << bits) - 1)
