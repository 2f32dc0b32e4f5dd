"""Near-duplicate embeddings of one label, by randomly rotated binary codes with stored correction factors.

Vectors are made unit length and rotated. For each distinct vector a row of codes is stored, once: the signs of its rotated
coordinates as bits; the correction factor c = <s, u>, where s is the signs of the first rotation as a vector of length one and u the
rotated vector; and u itself in steps of 4 bits, with the length of what the steps leave out. For another vector v, <s, v> / c is
an unbiased estimate of <u, v> over random rotations. A pair of a cosine of at least t has an estimate of at least
t - sqrt(1 - t^2) sqrt(1 - c^2) / c, since the part of v across u is no longer than sqrt(1 - t^2) and meets s in no more than sqrt(1 - c^2);
the steps add their error over c. A pair whose estimate, either way round, is below that bound is out for certain; the others are
undecided and recomputed in double precision from the vectors.

Candidates share `bits` of the code in one of `tables` places. From the largest label's rows n: bits is log2(n) and SPARE_BITS more,
at least 16, and tables is what leaves a pair at the threshold unseen with at most `miss`. Only codes go to the buckets of candidates; a
vector goes to those where an undecided pair of it is met that was in no earlier table. Equal vectors are one row with a weight.
A large bucket is cut into blocks; a task compares two blocks and gives each row's count and a spanning forest, never the pairs.

Cases: a null label, and a vector that is null, zero or holds a null or non-finite component, link with nothing and are
their own component; labels of any type are equal if they are as strings; a null vec_id isn't linked and has a null component; rows of
one vec_id are returned each with its own links, and vectors whose groups of equals have the same least vec_id share a component; an
empty table gives no rows; other columns are ignored; vectors of different lengths don't link.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_weight, materialise, pairs_in_runs, runs_of
from .components import components

COSINE, MISS, SEED = 0.98, 1e-5, 7
#: Rows of a block of a bucket, rows of small buckets that are compared in one go (about), and rows of one side of a product.
BLOCK, TOGETHER, STRIP = 2048, 4096, 64
SPARE_BITS = 4
LEVELS = 15


def plan_tables(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """bits and tables for this many rows of a label."""
    bits = max(16, math.ceil(math.log2(max(2, rows))) + SPARE_BITS)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


@functools.lru_cache(maxsize=4)
def rotations(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """At least `bits` orthonormal directions in groups of dim: rows of random rotations."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-bits // dim))])


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def stored(units: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: packed signs (at least `bits`, and one for each dimension), correction factors, packed steps, their width and error."""
    dim = units.shape[1]
    turned = units @ rotations(dim, bits).T
    first = turned[:, :dim]
    factor = np.abs(first).sum(axis=1) / math.sqrt(dim)
    top = np.abs(first).max(axis=1)
    step = 2 * top / LEVELS
    level = np.clip(np.rint((first + top[:, None]) / step[:, None]), 0, LEVELS).astype(np.uint8)
    error = np.linalg.norm(level * step[:, None] - top[:, None] - first, axis=1)
    if dim % 2:
        level = np.concatenate((level, np.zeros((len(level), 1), np.uint8)), axis=1)
    return np.packbits(turned > 0, axis=1, bitorder="little"), factor, level[:, ::2] | level[:, 1::2] << 4, step, error


class Codes:
    """Codes of some vectors, to estimate the cosines of pairs."""

    def __init__(self, sign: np.ndarray, factor: np.ndarray, level: np.ndarray, step: np.ndarray, error: np.ndarray, dim: int, bits: int, tables: int, cosine: float):
        flat = np.unpackbits(sign, axis=1, bitorder="little")
        self.keys = flat[:, : bits * tables].reshape(len(flat), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
        scaled = (1 / (math.sqrt(dim) * factor))[:, None]
        self.code = np.where(flat[:, :dim], scaled, -scaled).astype(np.float32)
        half = np.empty((len(level), 2 * level.shape[1]), np.uint8)
        half[:, ::2], half[:, 1::2] = level & 15, level >> 4
        self.steps = ((half[:, :dim] - LEVELS / 2) * step[:, None]).astype(np.float32)
        self.least = cosine - math.sqrt(1 - cosine**2) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor - 1e-4
        self.error, self.per = error, 1 / factor

    def undecided_pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of these pairs may be linked."""
        one = np.einsum("ij,ij->i", self.code[i], self.steps[j]) >= self.least[i] - self.error[j] * self.per[i]
        return one & (np.einsum("ij,ij->i", self.code[j], self.steps[i]) >= self.least[j] - self.error[i] * self.per[j])

    def undecided(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of a row of x and one of y may be linked, as a matrix."""
        one = self.code[x] @ self.steps[y].T >= self.least[x][:, None] - self.error[y][None, :] * self.per[x][:, None]
        return one & (self.steps[x] @ self.code[y].T >= self.least[y][None, :] - self.error[x][:, None] * self.per[y][None, :])

    def fresh(self, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Which pairs share no key of a table before the one in which they are met."""
        before = np.arange(self.keys.shape[1])[None, :] < table[i][:, None]
        return ~((self.keys[i] == self.keys[j]) & before).any(axis=1)


def met(codes: Codes, key: np.ndarray, side: np.ndarray | None, exact=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Undecided pairs of rows of equal keys, or of two sides; with `exact`, a matrix product of rows, those that it confirms. A row is in few products at a time."""
    if side is not None:
        whole = [(np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)]
        order, sizes, starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        order, starts, sizes = runs_of(key)
        whole = [(order[s : s + n], order[s : s + n], True) for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True)]
    for x, y, own in whole:
        for at in range(0, len(x), STRIP):
            rows, cols = x[at : at + STRIP], y[at:] if own else y
            maybe = codes.undecided(rows, cols)
            if own:
                maybe &= np.arange(len(cols))[None, :] > np.arange(len(rows))[:, None]
            if exact is not None:
                maybe &= exact(rows, cols)
            i, j = np.nonzero(maybe)
            yield rows[i], cols[j]
    for i, j in pairs_in_runs(order, starts, sizes):
        maybe = codes.undecided_pairs(i, j)
        i, j = i[maybe], j[maybe]
        if exact is not None and len(i):
            maybe = exact(i, j, True)
            i, j = i[maybe], j[maybe]
        yield i, j


def forest(i: np.ndarray, j: np.ndarray, root: list[int]) -> list[tuple[int, int]]:
    """The links that join trees of the forest `root`, which they extend."""

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def codes_of(rows: pd.DataFrame, dim: int, bits: int, tables: int, cosine: float) -> Codes:
    unpacked = (np.frombuffer(b"".join(rows[c]), np.uint8).reshape(len(rows), -1) for c in ("sign", "level"))
    sign, level = unpacked
    return Codes(sign, rows["factor"].to_numpy(), level, rows["step"].to_numpy(), rows["error"].to_numpy(), dim, bits, tables, cosine)


def by_kind(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each number of dimensions of one group."""
    for _, part in rows.groupby("dim", sort=False):
        yield part.reset_index(drop=True)


def propose(rows: pd.DataFrame, bits: int, tables: int, cosine: float) -> pd.DataFrame:
    """Rows of some buckets, or two blocks of one bucket: those of an undecided pair that is met here first."""
    out = []
    for part in by_kind(rows):
        codes, table = codes_of(part, int(part["dim"].iloc[0]), bits, tables, cosine), part["tab"].to_numpy()
        some = np.zeros(len(part), bool)
        for i, j in met(codes, part["bucket"].to_numpy(), part["side"].to_numpy() if part["one"].iloc[0] != part["two"].iloc[0] else None):
            new = codes.fresh(i, j, table)
            some[i[new]] = some[j[new]] = True
        out.append(part.loc[some, ["bucket", "tab", "blocks", "one", "two", "side", "nid"]])
    return pd.concat(out)


def decide(rows: pd.DataFrame, bits: int, tables: int, cosine: float) -> pd.DataFrame:
    """The same rows with their vectors: link weights of nodes, and a spanning forest of the links, by exact cosines of undecided pairs."""
    out = []
    for part in by_kind(rows):
        dim, table, weight, node, nid = int(part["dim"].iloc[0]), part["tab"].to_numpy(), part["weight"].to_numpy(), part["node"].to_numpy(), part["nid"].to_numpy()
        label = part["lab"].to_numpy()
        units = unit_rows(np.stack(part["v"].to_numpy()).astype(np.float64))

        def exact(x: np.ndarray, y: np.ndarray, pairs: bool = False, units: np.ndarray = units) -> np.ndarray:
            return np.einsum("ij,ij->i", units[x], units[y]) >= cosine if pairs else units[x] @ units[y].T >= cosine

        codes = codes_of(part, dim, bits, tables, cosine)
        count, tree, root = np.zeros(len(part)), [], list(range(len(part)))
        for i, j in met(codes, part["bucket"].to_numpy(), part["side"].to_numpy() if part["one"].iloc[0] != part["two"].iloc[0] else None, exact):
            new = codes.fresh(i, j, table) & (label[i] == label[j])
            i, j = i[new], j[new]
            count += np.bincount(i, weight[j], len(part)) + np.bincount(j, weight[i], len(part))
            tree += forest(i, j, root)
        some, ends = np.flatnonzero(count), np.array(tree, dtype=np.int64).reshape(-1, 2)
        out.append(pd.DataFrame({
            "nid": np.concatenate((nid[some], nid[ends[:, 0]])),
            "n": np.concatenate((count[some].astype(np.int64), np.zeros(len(tree), np.int64))),
            "a": pd.array([*[None] * len(some), *node[ends[:, 0]].tolist()], dtype="Int64"),
            "b": pd.array([*[None] * len(some), *node[ends[:, 1]].tolist()], dtype="Int64"),
        }))
    return pd.concat(out)


def in_groups(rows: DataFrame, total: int):
    """Rows in the groups that are compared: some small buckets together, two blocks of a large one each for themselves."""
    small = F.pmod(F.xxhash64("bucket"), F.lit(max(1, total // TOGETHER))).cast("long")
    return rows.withColumn("group", F.when(F.col("blocks") == 1, small).otherwise(F.col("bucket"))).groupBy(F.col("blocks") == 1, "group", "one", "two")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    # floats stay floats where they came so; -0.0 and 0.0 are the same
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    kind = "array<float>" if single else "array<double>"
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(values, lambda x: x != 0)
    label = F.col("label").cast("string")
    ok = F.coalesce(sound & label.isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.when(ok, values.cast(kind)).alias("v"))

    def hashed(salt: int) -> Column:
        return F.lpad(F.hex(F.xxhash64(F.lit(salt), "label", F.size("v"), "v")), 16, "0")

    rows = rows.withColumn("tag", F.when(F.col("v").isNotNull(), F.concat(hashed(0), hashed(1))))
    same = rows.where("tag is not null").groupBy("tag").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    same = materialise(same.select(F.monotonically_increasing_id().alias("nid"), "*"), "vectors")
    largest = same.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = plan_tables(largest, cosine, miss)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            for n in np.unique(sizes):
                of = np.flatnonzero(sizes == n)
                for at in range(0, len(of), 4096):
                    rest = batch.take(pa.array(of[at : at + 4096]))
                    units = unit_rows(rest.column(2).flatten().to_numpy().astype(np.float64).reshape(len(rest), int(n)))
                    sign, factor, level, step, error = stored(units, max(int(n), bits * tables))
                    packed = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (sign, level)]
                    yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array(np.full(len(rest), n, np.int32)), packed[0], pa.array(factor), packed[1], pa.array(step), pa.array(error)], ["nid", "lab", "dim", "sign", "factor", "level", "step", "error"])

    schema = "nid long, lab string, dim int, sign binary, factor double, level binary, step double, error double"
    codes = materialise(same.select("nid", "label", "v").mapInArrow(encoded, schema), "vector-codes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                if not len(part):
                    continue
                rows, cut = part.column(3).to_pylist(), -(-bits * tables // 8)
                flat = np.unpackbits(np.frombuffer(b"".join(x[:cut] for x in rows), np.uint8).reshape(len(rows), cut), axis=1, bitorder="little")
                key = flat[:, : bits * tables].reshape(len(rows), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                rest = part.take(pa.array(np.repeat(np.arange(len(rows)), tables)))
                yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), rest.column(2), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(key.ravel())], ["nid", "lab", "dim", "tab", "key"])

    # a bucket's number is a hash of label, length, table and key; labels are compared again where pairs are decided
    keys = codes.select("nid", "lab", "dim", "sign").mapInArrow(keyed, "nid long, lab string, dim int, tab int, key long")
    keys = keys.select(F.xxhash64("lab", "dim", "tab", "key").alias("bucket"), "tab", "nid")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    member = materialise(keys.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m"), "bucket-members")
    total = member.count()
    own = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("one"), F.greatest(k, F.col("own")).alias("two"), (k < F.col("own")).cast("int").alias("side")))
    dealt = member.join(codes.drop("lab"), "nid").withColumn("own", own).select("*", F.explode(meets).alias("meet")).select("bucket", "tab", "blocks", "meet.*", "nid", "dim", "sign", "factor", "level", "step", "error")
    names = "bucket long, tab int, blocks int, one int, two int, side int, nid long"
    proposed = materialise(in_groups(dealt, total).applyInPandas(lambda x: propose(x, bits, tables, cosine), names), "undecided")
    payload = proposed.join(codes.drop("lab").join(same.select("nid", "node", "weight", "v", F.xxhash64(F.lit(2), "label").alias("lab")), "nid"), "nid")
    found = in_groups(payload, proposed.count()).applyInPandas(lambda x: decide(x, bits, tables, cosine), "nid long, n long, a long, b long")
    found = materialise(found, "vector-links")
    counts = found.where("a is null").groupBy("nid").agg(F.sum("n").alias("n"))
    joined = components(found.where("a is not null").select("a", "b"))
    nodes = same.select("nid", "tag", "node", "weight").join(counts, "nid", "left").join(joined, "node", "left")
    nodes = nodes.select("tag", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    out = join_by_weight(rows.select("vec_id", "tag"), nodes, "tag", "weight", "vec_id")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
