"""Packing of tokenised documents into windows: best-fit decreasing over a segment tree of remaining capacities.

An overlong document is first cut into full windows; what is left, and every shorter document, is placed in
the open window with the least room that still holds it, longest first. A task packs its own documents, in
rounds of at most `round_docs`, so memory is bounded and no row moves between machines; each round
leaves at most a few windows part-filled.

Cases: a null or empty text is its end id alone; a null doc_id is kept as null; repeated rows are packed each
for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices
from .word_tokens import load, with_end

WINDOW = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Counts of open windows by remaining capacity, as a segment tree: finds the least capacity that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least with an open window, or -1."""
        count, i = self.count, least + self.size
        if count[i]:
            return least
        while i > 1:
            if not i & 1 and count[i + 1]:  # the right sibling holds larger capacities
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """For lengths of 1 to window: each one's window, its offset there, and the number of windows."""
    tree, open_at, used = CapacityTree(window), [[] for _ in range(window + 1)], []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.tightest(n)
        if room < 0:
            w, room = len(used), window
            used.append(0)
        else:
            w = open_at[room].pop()
            tree.add(room, -1)
        where[i], offset[i] = w, used[w]
        used[w] += n
        if room > n:
            open_at[room - n].append(w)
            tree.add(room - n, 1)
    return where, offset, len(used)


def pieces(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of documents of these token counts: each piece's document, start, length, sequence and offset there."""
    full, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    tails = np.flatnonzero(rest)
    where, offset, _ = best_fit(rest[tails], window)
    k = len(doc)
    return (
        np.concatenate((doc, tails)),
        np.concatenate((nth * window, full[tails] * window)),
        np.concatenate((np.full(k, window), rest[tails])),
        np.concatenate((np.arange(k), k + where)),
        np.concatenate((np.zeros(k, np.int64), offset)),
    )


def pack(docs: DataFrame, tokenizer: str, end: int = 1, window: int = WINDOW, round_docs: int = 1 << 16) -> DataFrame:
    """One row per piece of a document: where its ids lie in the document and in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, base = load(tokenizer), TaskContext.get().partitionId() << 40
        ids_of, lengths, sums = [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal base
            if not lengths:
                return
            n = np.array(lengths, dtype=np.int64)
            doc, start, length, sequence, offset = pieces(n, window)
            nth = start // window
            first = np.cumsum([0, *map(len, sums)])[:-1]
            crc = np.array([c for x in sums for c in x], dtype=np.int64)[first[doc] + nth]
            names = pa.array(ids_of, pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([names, *map(pa.array, (start, length, crc, n[doc], base + sequence, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base += int(sequence.max()) + 1
            for x in (ids_of, lengths, sums):
                x.clear()

        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                for name, ids in zip(part.column(0).to_pylist(), with_end(*tokens.encode(part.column(1)), end), strict=True):
                    ids_of.append(name)
                    lengths.append(len(ids))
                    sums.append([zlib.crc32(ids[i : i + window]) for i in range(0, len(ids), window)])
                if len(lengths) >= round_docs:
                    yield from close()
        yield from close()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
