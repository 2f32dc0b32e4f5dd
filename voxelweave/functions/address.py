"""Column expressions of voxel addresses, packed words and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8
CELLS = SIDE**3
BRICK = ("bx", "by", "bz")
#: Bytes of a brick in memory: a 512-bit map and 512 four-byte colours.
BRICK_BYTES = CELLS // 8 + 4 * CELLS


def brick_of(axis: str) -> Column:
    return F.floor(F.col(axis) / SIDE).cast("int")


def cell_of(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Place in the brick; x runs fastest."""
    a, b, c = (F.pmod(F.col(k), F.lit(SIDE)) for k in (x, y, z))
    return (a + SIDE * b + SIDE * SIDE * c).cast("int")


def addressed(voxels):
    """Voxels with their brick and their place `vi` in it."""
    return voxels.withColumns({b: brick_of(a) for b, a in zip(BRICK, "xyz", strict=True)} | {"vi": cell_of()})


def map_index(width: int, height: int) -> Column:
    """Bit of a brick in its frame's map; width and height are in bricks."""
    return F.col("bx") + width * (F.col("by") + height * F.col("bz"))


def pack_colour(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 24).bitwiseOR(F.shiftleft(g.cast("long"), 16)).bitwiseOR(F.shiftleft(b.cast("long"), 8)).bitwiseOR(F.lit(255).cast("long"))


def unpack_colour(word: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(word, s).bitwiseAND(F.lit(255).cast("long")).cast("int") for s in (24, 16, 8))


def quantise_rounded(c: Column) -> Column:
    """A colour share as a byte, rounded half up and not clamped."""
    return F.floor(c * 255 + 0.5).cast("int")


def quantise_truncated(c: Column) -> Column:
    """A colour share as a byte, clamped to 0..1 and truncated."""
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def pack_pointer(kind: Column, pointer: Column) -> Column:
    """A frame-table entry; kind is 0 for an I-frame and 1 for a P-frame."""
    return F.shiftleft(kind.cast("long"), 56).bitwiseOR(pointer.cast("long"))


def unpack_pointer(entry: Column) -> tuple[Column, Column]:
    return F.shiftright(entry, 56).cast("int"), entry.bitwiseAND(F.lit((1 << 56) - 1))


def pack_version(major: Column, minor: Column, patch: Column, sub: Column) -> Column:
    return F.shiftleft(major.cast("long"), 24).bitwiseOR(F.shiftleft(minor.cast("long"), 16)).bitwiseOR(F.shiftleft(patch.cast("long"), 8)).bitwiseOR(sub.cast("long"))


def map_words(cells: Column) -> Column:
    """32-bit words that hold so many bits."""
    return F.ceil(cells / 32).cast("long")


def duration(frames: Column, rate: Column, stored: Column | None = None) -> Column:
    """Seconds; a stored value counts unless it is off by more than a tenth."""
    own = frames / rate
    return own if stored is None else F.when(F.abs(stored - own) > 0.1, own).otherwise(stored)


def morton(x: Column, y: Column, z: Column, bits: int = 3) -> Column:
    """The coordinates' bits interleaved, x lowest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 3 * i + k))
    return out


# Error codes and their texts.
ERRORS = {
    0: "success", 1: "invalid arguments", 2: "invalid input", 3: "out of memory", 4: "file open",
    5: "file read", 6: "file write", 7: "runtime", 8: "internal", 9: "unknown error",
}


def error_text(code: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    return F.coalesce(F.try_element_at(texts, code), F.lit("unknown error"))


def bit(place: Column, bits: int) -> Column:
    """A word with the bit of a place in words of so many bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(bits)).cast("int"))
