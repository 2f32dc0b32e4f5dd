"""Near-duplicate documents by SimHash and Golay-code fuzzy hashing.

A fingerprint has 64 bits over word shingles. It is cut into segments of 23, 23 and 18 bits. Two fingerprints that
differ in at most 2 bits agree wholly in one segment (pigeonhole), and in each other segment a word at most one bit
away from both exists; so the sets of codewords that the words within one bit of either segment decode to, in the
perfect (23, 12) Golay code, meet. The keys of a fingerprint are thus, for each segment, its bits and the indices of the
next segment's nearby codewords: one or six. Fingerprints that share a key are candidates; the distance is verified.

Distinct fingerprints are worked on, so copies cost nothing. A key with over PAIRWISE of them isn't expanded to pairs:
its fingerprints are grouped by the words at most one bit away; all that share such a word are within 2 bits,
and any two within 2 bits share one, so a star per word loses no link and makes none that isn't there.

`soft_keys` are the keys for a least similarity of texts, where fingerprints differ in more bits than any pigeonhole bears: the votes of the
shingles, not the bits alone, say which codewords a segment is near to, as in soft-decision decoding (see `near_copies`).

Cases: a null or empty text, or one without words, has fingerprint 0; a null doc_id gets a fingerprint and a null
component; repeated rows are each returned; rows of one doc_id are in one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_weight, materialise, text_slices
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Soft keys by the segments of a key: how many fingerprints of so many segments of 23 bits, and how many keys of each.
PLANS = {2: (6, 12), 3: (12, 24)}
#: Texts up to which keys of two segments seldom meet by chance.
TWO_SEGMENTS = 1 << 22
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of a key that are still compared pair by pair.
PAIRWISE = 24
#: Generator of the perfect binary (23, 12) Golay code.
GOLAY = 0b110001110101


def set_bits(words: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words, (n, k), have each bit set: (k * 64) counts."""
    raw = np.ascontiguousarray(words).astype("<u8").view(np.uint8).reshape(len(words), -1)
    count = np.zeros(8 * raw.shape[1], np.int64)
    for at in range(0, len(raw), 255):  # as many as a byte can count
        count += np.add.reduce(np.unpackbits(raw[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return count


def fingerprint(text: str | None) -> int:
    """SimHash of one text: a bit is set if it is in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)
    count = set_bits(hashes[:, None])
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error of each syndrome."""

    def syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << i - 11
        return word

    low = np.array([syndrome(x) for x in range(1 << 12)], dtype=np.uint64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], dtype=np.uint64)
    error = np.zeros(1 << 11, dtype=np.uint64)
    one = [1 << i for i in range(23)]
    for e in [a | b | c for a in one for b in one for c in one]:
        error[syndrome(e)] = e
    return low, high, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword (at most 3 bits away) of 23-bit words."""
    low, high, error = golay_tables()
    fault = error[low[words & np.uint64(0xFFF)] ^ high[words >> np.uint64(12)]]
    return (words ^ fault) >> np.uint64(11)


def nearby(words: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the codewords that words and those one bit away decode to; -1 fills each row."""
    flips = np.array([0, *(1 << i for i in range(bits))], dtype=np.uint64)
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]).astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all fingerprints."""
    parts = [prints >> np.uint64(at) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    rows, out = [], []
    for s, part in enumerate(parts):
        t = (s + 1) % len(parts)
        index = nearby(parts[t], SEGMENTS[t][1])
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        out.append(s << 60 | part.astype(np.int64)[row] << 12 | index[row, col])
    return np.concatenate(rows), np.concatenate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B185EBCA87)
    return x ^ x >> np.uint64(32)


@functools.cache
def codewords() -> np.ndarray:
    """The 4,096 codewords by index, as rows of 1 and -1."""
    words = (np.arange(1 << 12, dtype=np.uint64) << np.uint64(11))
    low, high, _ = golay_tables()
    words ^= low[words & np.uint64(0xFFF)] ^ high[words >> np.uint64(12)]
    return (2.0 * (words[:, None] >> np.arange(23, dtype=np.uint64) & np.uint64(1)).astype(np.float32) - 1).astype(np.float32)


def plan_soft_keys(texts: int) -> int:
    """The segments of a key for this many texts: a key has 12 bits of each, and there are 4,096 times as many keys of one more."""
    return 2 if texts <= TWO_SEGMENTS else 3


def votes(shingles: np.ndarray, segments: int = 2) -> np.ndarray:
    """(fingerprints, segments * 23) votes of shingle hashes: those for a set bit less those against, at most some 2^18."""
    n = PLANS[segments][0] * segments
    turned = mixed(shingles[:, None] ^ mixed(np.arange(1, -(-n // 2) + 1, dtype=np.uint64))[None, :])
    out = 2 * set_bits(turned).reshape(-1, 64)[:, :46].reshape(-1, 23)[:n] - len(shingles)
    return (out >> max(0, int(np.abs(out).max()).bit_length() - 18)).reshape(-1, segments * 23)


def soft_keys(all_votes: np.ndarray, segments: int = 2) -> np.ndarray:
    """Keys of texts, from their votes: for each fingerprint the tuples of codewords that the votes of its segments are for most."""
    n, (tables, places) = len(all_votes), PLANS[segments]
    found = []
    for at in range(0, n, 4):  # some texts at a time: each has 4,096 scores a segment
        part = all_votes[at : at + 4].reshape(-1, 23).astype(np.float32)
        score = (part @ codewords().T).astype(np.int64)
        score <<= 12
        score |= np.arange(1 << 12)
        score.partition(-8, axis=1)
        found.append(score[:, -8:].copy())
    best = np.concatenate(found).reshape(n * tables, segments, 8)
    score, key = best[:, 0] >> 12, best[:, 0] & 4095
    for s in range(1, segments):
        score = (score[:, :, None] + (best[:, s] >> 12)[:, None, :]).reshape(n * tables, -1)
        key = (key[:, :, None] << 12 | (best[:, s] & 4095)[:, None, :]).reshape(n * tables, -1)
    # of equal sums the larger keys, so that texts choose alike
    order = np.lexsort((key, score))[:, -places:]
    return (np.tile(np.arange(tables), n)[:, None] << 12 * segments | np.take_along_axis(key, order, axis=1)).reshape(n, tables * places)


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                prints = np.array([fingerprint(x) for x in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def links(distinct: DataFrame) -> DataFrame:
    """distinct(print, node), one row per fingerprint: links a, b between nodes whose fingerprints differ in at most RADIUS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(prints), 8192):
                row, key = keys(prints[at : at + 8192])
                part = batch.slice(at, 8192).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], ["key", "print", "node"])

    keyed = materialise(distinct.select("print", "node").mapInArrow(run, "key long, print long, node long"), "golay-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = materialise(keyed.join(shared, "key"), "shared-keys")
    few = sized.where(F.col("n") <= PAIRWISE)
    one, two = few.alias("x"), few.alias("y")
    near = F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print"))) <= RADIUS
    pairs = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & near).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)))
    many = sized.where(F.col("n") > PAIRWISE).select("print", "node").distinct()
    words = many.select("node", F.explode(F.transform(flips, lambda f: F.col("print").bitwiseXOR(f))).alias("word"))
    hubs = words.groupBy("word").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = words.join(hubs, "word").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return pairs.union(stars).distinct()


def links_of_ids(told: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links between the fingerprints of one doc_id, where it has several."""
    each = told.select("doc_id", "print").distinct()
    several = each.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("print").alias("low")).where("n > 1").drop("n")
    pairs = each.join(several, "doc_id").where("print <> low").select("print", "low").distinct()
    low = distinct.select(F.col("print").alias("low"), F.col("node").alias("b"))
    return pairs.join(distinct.select("print", F.col("node").alias("a")), "print").join(low, "low").select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint's bits as a long) and component_id of every document."""
    prints = materialise(fingerprints(docs), "fingerprints")
    told = prints.where("doc_id is not null")
    distinct = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "distinct-prints")
    nodes = distinct.where("node is not null")
    joined = components(links(nodes).union(links_of_ids(told, nodes)))
    named = distinct.join(joined, "node", "left").select("print", "rows", F.coalesce("component", "node").alias("component_id"))
    found = join_by_weight(prints, named, "print", "rows", "doc_id")
    return found.select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
