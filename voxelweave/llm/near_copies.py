"""Near-copies of documents by SimHash and Golay keys: five-word shingles, Jaccard similarity of at least 0.8.

A text's words are as in `simhash`, its shingles five words in a row (fewer words: all of them). Texts of a similarity of 0.8 differ
in some 15 of 100 bits of a SimHash, more than the pigeonhole of `simhash.links` bears. So a text has several fingerprints of two
segments of 23 bits (three beyond some millions of texts), and of each the keys are the tuples of Golay codewords that its votes are for
most (`simhash.soft_keys`). A key goes with a size: of two texts that are alike the larger has at most 5/4 of the other's shingles.
A pair at exactly the threshold shares no key with a probability of some 0.0007, closer ones far less (tests measure it).

Texts that share a key are candidates. Their fingerprints are compared first, in the keys' groups: a pair of over BITS
different bits isn't near. Then whole shingle sets decide, so no other pair is linked, in two steps. Each text is verified against the least
one that it is near to in any group; that joins most of a crowd at the price of one pair a text. What is still in different
components in some group, and near there, is walked: a walk over those that aren't reached yet finds their components without making pairs.
Where sets have over VOLUME shingles, they are cut into blocks and each two blocks are walked together.

Cases: texts without words are unlike any other; a row without doc_id stays; of a component the row of the least doc_id stays (if it has
several texts there, the one of the least text hash); rows of one doc_id whose texts aren't alike each stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pairs_in_runs, runs_of, spread, text_slices, work_on
from .components import components
from .simhash import PLANS, mixed, plan_soft_keys, soft_keys, votes

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction.
SHARED, OF = 4, 5
#: Most bits of a fingerprint in which near ones differ: of 276, where 42 or 52 (sets of a few shingles) are to be expected and 138 by chance.
BITS = 92
#: Shingles of the candidates that are walked together, about; candidates of a block of a large group, and of small groups that are compared in one go.
VOLUME, BLOCK, TOGETHER = 1 << 21, 4096, 1 << 15
#: Bits and 64-bit words of a fingerprint that is compared: all of the plan of two segments.
PRINT = 46 * PLANS[2][0]
WORDS = -(-PRINT // 64)
#: Sizes from one power of this to the next go together.
CELL = (OF / SHARED) ** 2


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    out = hashes[:n]
    for j in range(1, k):
        out = mixed(out) + hashes[j : j + n]
    return np.unique(mixed(out))


def node(hashes: np.ndarray) -> int:
    """One name for texts of the same shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    work_on("near_copies")
    for batch in batches:
        for a, b in text_slices(batch.column(batch.num_columns - 1)):
            part = batch.slice(a, b - a)
            yield part, [shingles(x) for x in part.column(batch.num_columns - 1).to_pylist()]


def cells(size: int) -> list[int]:
    """The cells of a set's size: its own, and the next if a set of 5/4 the size is there. Of two such sets the smaller one's hold the other's own."""
    own = int(math.log(size) / math.log(CELL) + 1e-9)
    return [own, own + 1] if math.log(size * OF / SHARED) / math.log(CELL) + 1e-9 >= own + 1 else [own]


def named(docs: DataFrame, segments: int) -> DataFrame:
    """doc_id, text_key, node, size, fingerprint, cells and keys of every document; no keys without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in parts(batches):
            full = [x for x in sets if len(x)]
            each = np.array([votes(x, segments) for x in full], np.int64).reshape(len(full), PLANS[segments][0], 23 * segments)
            bits = np.zeros((len(full), 64 * WORDS), np.uint8)
            bits[:, :PRINT] = each.reshape(len(full), -1)[:, :PRINT] > 0
            prints = iter(np.packbits(bits, axis=1, bitorder="little"))
            keys = iter(soft_keys(each, segments) if full else ())
            of = [(next(prints).tobytes(), next(keys), cells(len(x))) if len(x) else (b"", np.zeros(0, np.int64), []) for x in sets]
            columns = pa.array([node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in of], pa.binary()), pa.array([x[2] for x in of], pa.list_(pa.int32())), pa.array([x[1] for x in of], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "text_key", "node", "size", "print", "cells", "keys"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, node long, size long, print binary, cells array<int>, keys array<long>")


def whole_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes binary")


def near_pairs(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of one key and different components whose fingerprints are near; of two blocks if there are two."""
    prints = np.frombuffer(b"".join(group.column("print").to_pylist()), "<u8").reshape(-1, WORDS)
    key, comp, side = (group.column(c).to_numpy() for c in ("key", "component", "side"))

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (comp[x] != comp[y]) & (np.bitwise_count(prints[x] ^ prints[y]).sum(axis=-1, dtype=np.int64) <= BITS)

    if side.any():
        large, order, starts, sizes = [(np.flatnonzero(side == 0), np.flatnonzero(side == 1))], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        order, starts, sizes = runs_of(key)
        large = [(order[s : s + n],) * 2 for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True)]
    for i, j in pairs_in_runs(order, starts, sizes):
        hit = near(i, j)
        yield i[hit], j[hit]
    for x, y in large:
        if x is y:  # all but the largest component's, each against the others
            names, n = np.unique(comp[x], return_counts=True)
            x = x[comp[x] != names[n.argmax()]]
        for i in x.tolist():
            j = y[near(np.array([i]), y)]
            yield np.full(len(j), i), j


def hubs(group: pa.Table) -> pa.Table:
    """Each row's least near partner of a smaller node in its key's group."""
    nodes = group.column("node").to_numpy()
    least: dict[int, int] = {}
    for i, j in near_pairs(group):
        for a, b in zip(np.maximum(nodes[i], nodes[j]).tolist(), np.minimum(nodes[i], nodes[j]).tolist(), strict=True):
            if b < least.get(a, a):
                least[a] = b
    return pa.table({"a": pa.array(least.keys(), pa.int64()), "b": pa.array(least.values(), pa.int64())})


def apart(group: pa.Table) -> pa.Table:
    """The rows that are near to one of another component."""
    some = np.zeros(len(group), bool)
    for i, j in near_pairs(group):
        some[i] = some[j] = True
    return group.select(["key", "node"]).filter(pa.array(some))


def forest(sets: list[np.ndarray], comp: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets that are alike, enough of them to join all that any chain of such links joins. Sets of one component are joined already."""
    size = np.array([len(x) for x in sets], np.int64)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(len(distinct), np.int64)
    left, found, queue = np.arange(len(sets)), [], []
    flat, changed = codes, False
    while len(left):
        if not queue:
            queue, left, changed = [int(left[0])], left[1:], True
        x = queue.pop()
        same = comp[left] == comp[x]
        if same.any():
            queue += left[same].tolist()
            left, changed = left[~same], True
        if not len(left):
            break
        if changed:
            flat, changed = spread(codes, start[left], size[left]), False
        own = codes[start[x] : start[x] + size[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], np.cumsum(size[left]) - size[left])
        mark[own] = 0
        near = both * (SHARED + OF) >= SHARED * (size[x] + size[left])
        if near.any():
            hit = left[near].tolist()
            found += [(x, y) for y in hit]
            queue += hit
            left, changed = left[~near], True
    return found


def walk(group: pa.Table) -> pa.Table:
    nodes = group.column("node").to_pylist()
    found = forest([np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()], group.column("component").to_numpy())
    return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[i] for _, i in found], pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose shingle sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in (2, 3))
            good = [len(np.intersect1d(x, y, assume_unique=True)) * (SHARED + OF) >= SHARED * (len(x) + len(y)) for x, y in zip(one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("one"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("two"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def only(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 1 << 18) -> DataFrame:
    """The documents of these doc_id and text_key, which are broadcast if they are few."""
    ids = materialise(ids.select("doc_id", "text_key"), "needed-texts")
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, ["doc_id", "text_key"], "left_semi")


def dealt(members: DataFrame, blocks) -> DataFrame:
    """Members once for each two blocks of their group that they are in: blocks one and two, and their side of them."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("one"), F.greatest(k, F.col("own")).alias("two"), (k < F.col("own")).cast("int").alias("side")))
    return members.withColumn("blocks", blocks.cast("int")).withColumn("own", own).select("*", F.explode(meets).alias("meet")).select("*", "meet.*").drop("meet", "own")


def in_groups(members: DataFrame, total: int):
    small = F.pmod(F.xxhash64("key"), F.lit(max(1, total // TOGETHER)))
    rows = dealt(members, F.ceil(F.col("n") / BLOCK)).withColumn("group", F.when(F.col("blocks") == 1, small).otherwise(F.col("key")))
    return rows.select("key", "node", "component", "print", "side", "group", "one", "two", (F.col("blocks") == 1).alias("whole")).groupBy("whole", "group", "one", "two")


def links(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Links a, b between nodes."""
    distinct = names.where("size > 0").groupBy("node").agg(F.min_by(F.struct("doc_id", "text_key", "size", "print", "cells", "keys"), F.struct("doc_id", "text_key")).alias("of")).select("node", "of.*")
    distinct = materialise(distinct, "distinct-texts")
    in_cell = distinct.select("node", F.explode("cells").alias("cell"), "keys")
    keyed = in_cell.select("node", F.explode(F.transform("keys", lambda k: F.shiftleft(F.col("cell").cast("long"), 44) + k)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(shared, "key"), "key-members")
    total = members.count()
    prints = distinct.select("node", "print")
    least = in_groups(members.join(prints, "node").withColumn("component", F.col("node")), total).applyInArrow(hubs, "a long, b long")
    pairs = materialise(least.groupBy("a").agg(F.min("b").alias("b")), "near-hubs")
    # whole sets of what is near to anything
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = distinct.join(need, "node", "left_semi").select("doc_id", "text_key")
    sets = materialise(whole_sets(only(docs, sets)).dropDuplicates(["node"]), "shingle-sets")
    first = materialise(verified(pairs, sets), "hub-links")
    joined = components(first)
    placed = members.join(prints, "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = materialise(in_groups(placed, total).applyInArrow(apart, "key long, node long").distinct(), "members-apart")
    found = distinct.join(left.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key", "size").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = materialise(whole_sets(only(docs, found)).dropDuplicates(["node"]), "sets-apart")
    walked = left.join(found.select("node", "size", "component"), "node")
    volume = walked.groupBy("key").agg(F.ceil(F.sum("size") / VOLUME).alias("blocks"))
    walked = walked.join(volume, "key")
    rows = dealt(walked, F.col("blocks")).join(more, "node").select("key", "node", "component", "hashes", "one", "two")
    return first.union(rows.groupBy("key", "one", "two").applyInArrow(walk, "a long, b long")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-copies of a smaller doc_id; repeated rows go too, rows without doc_id stay."""
    rows = docs.withColumn("text_key", F.xxhash64("text"))
    told = rows.where("doc_id is not null")
    names = materialise(named(told.withColumn("doc_id", F.col("doc_id").cast("long")), plan_soft_keys(told.count())), "fingerprints")
    joined = components(links(told, names))
    least = names.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("of")).join(joined, "node", "left")
    kept = least.groupBy(F.coalesce("component", "node")).agg(F.min("of").alias("of")).select("of.*").distinct()
    one = told.join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return one.select(docs.columns).union(docs.where("doc_id is null"))
