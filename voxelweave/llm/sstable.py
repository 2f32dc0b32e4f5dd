"""Sorted-string-table shards of token ids, with a reader and a binary-search lookup.

A shard file holds, in this order:
  data blocks   entries in key order, then the u32 places of its restart entries and their u32 count. An entry is
                varint shared, varint unshared (key bytes shared with the entry before, and not), varint tokens,
                varint local start, the unshared key bytes, the ids as little-endian integers of the footer's width.
  sparse index  for each block: its first key (u16 length, bytes), u64 offset, u32 length, u32 entries
  Bloom filter  u32 hash count, then the bits
  footer        u64 index offset, u64 index length, u64 Bloom offset, u64 Bloom length, u64 entries, u64 tokens,
                u32 id width, u32 crc32 of index, Bloom bytes and the footer so far, 8 bytes MAGIC
A key is a zero byte for a null identifier; else a one byte and the identifier, offset to be unsigned, big-endian.

Shards are cut by identifier and then by a hash of the text, so that rows of one identifier spread over shards too. They are
read back in as many tasks as there are shards.

Cases: a null or empty text has its end id alone; null identifiers come first; equal identifiers keep all their
rows, in order of their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import filesystem, text_slices
from .word_tokens import load, with_end

MAGIC = b"TOKTABL1"
NUMBERS, FOOTER = struct.Struct("<QQQQQQI"), struct.Struct("<QQQQQQII8s")
BLOCK_BYTES, RESTART = 64 << 10, 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MANIFEST = "shard int, path string, docs long, tokens long, bytes long"
ROWS = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def key_of(name: int | None) -> bytes:
    return b"\0" if name is None else b"\1" + struct.pack(">Q", name + (1 << 63))


def name_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Takes rows in key order; what it holds is one block, the sparse index and 8 bytes a key for the Bloom filter."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.entries = self.tokens = 0
        self.index, self.hashes = [], []
        self.block, self.restarts, self.n, self.first, self.last = bytearray(), [], 0, b"", b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if not self.n:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(ids)) + varint(self.tokens) + key[shared:]
        self.block += ids.astype(f"<u{self.width}").tobytes()
        self.last, self.n = key, self.n + 1
        self.entries += 1
        self.tokens += len(ids)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.n:
            data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index.append(struct.pack("<H", len(self.first)) + self.first + struct.pack("<QII", self.at, len(data), self.n))
            self.sink.write(data)
            self.at += len(data)
            self.block, self.restarts, self.n = bytearray(), [], 0

    def close(self) -> int:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.hashes) + 7 & ~7)
        h = np.array(self.hashes, dtype=np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        filled = np.zeros(bits, dtype=np.uint8)
        for i in range(BLOOM_HASHES):
            filled[(a + np.uint64(i) * b) % np.uint64(bits)] = 1
        bloom = struct.pack("<I", BLOOM_HASHES) + np.packbits(filled, bitorder="little").tobytes()
        numbers = self.at, len(index), self.at + len(index), len(bloom), self.entries, self.tokens, self.width
        foot = FOOTER.pack(*numbers, zlib.crc32(index + bloom + NUMBERS.pack(*numbers)), MAGIC)
        self.sink.write(index + bloom + foot)
        return self.at + len(index) + len(bloom) + len(foot)


def block_entries(data: bytes, width: int, start: int = 0) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """Key, local start and ids of a block's entries, from the restart place `start` on."""
    end, at, key = len(data) - 4 - 4 * struct.unpack_from("<I", data, len(data) - 4)[0], start, b""
    while at < end:
        shared, at = read_varint(data, at)
        unshared, at = read_varint(data, at)
        n, at = read_varint(data, at)
        first, at = read_varint(data, at)
        key = key[:shared] + data[at : at + unshared]
        at += unshared
        yield key, first, np.frombuffer(data, dtype=f"<u{width}", count=n, offset=at)
        at += n * width


class ShardReader:
    """Reads one shard: all rows block by block, or the rows of one identifier."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{uri}: too short for a shard")
        *numbers, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        io, il, bo, bl, self.entries, self.tokens, self.width = numbers
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        if max(io + il, bo + bl) > size:
            raise ValueError(f"{uri}: its footer is damaged")
        index, bloom = self.file.read_at(il, io), self.file.read_at(bl, bo)
        if zlib.crc32(index + bloom + NUMBERS.pack(*numbers)) != crc:
            raise ValueError(f"{uri}: its index is damaged")
        self.hashes, self.bloom = struct.unpack_from("<I", bloom)[0], bloom[4:]
        self.first, self.blocks, at = [], [], 0
        while at < il:
            n = struct.unpack_from("<H", index, at)[0]
            self.first.append(index[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QI", index, at + 2 + n))
            at += 2 + n + 16

    def rows(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for offset, length in self.blocks:
            for key, first, ids in block_entries(self.file.read_at(length, offset), self.width):
                yield name_of(key), first, ids

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, 8 * len(self.bloom), self.hashes))

    def lookup(self, name: int | None) -> list[np.ndarray]:
        key, found = key_of(name), []
        if not self.may_hold(key):
            return found
        for b in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.blocks)):
            if self.first[b] > key:
                break
            offset, length = self.blocks[b]
            data = self.file.read_at(length, offset)
            n = struct.unpack_from("<I", data, len(data) - 4)[0]
            restarts = struct.unpack_from(f"<{n}I", data, len(data) - 4 - 4 * n)
            keys = [next(block_entries(data, self.width, r))[0] for r in restarts]
            for k, _, ids in block_entries(data, self.width, restarts[max(0, bisect.bisect_left(keys, key) - 1)]):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 2) -> DataFrame:
    """Writes docs as shards in ascending doc_id order below `folder`; returns the manifest table, one row per shard.

    A range partition is a shard. A task writes to a name of its own and then renames, so a task that runs twice
    leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tokens, out = TaskContext.get(), load(tokenizer), None
        shard = task.partitionId()
        fs, root = filesystem(folder)
        final, own = f"{root}/shard-{shard:06d}.sst", f"{root}/.shard-{shard:06d}.{task.taskAttemptId()}"
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                for name, ids in zip(part.column(0).to_pylist(), with_end(*tokens.encode(part.column(1)), end), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        sink = fs.open_output_stream(own)
                        out = ShardWriter(sink, tokens.width)
                    out.add(key_of(name), ids)
        if out is not None:
            size = out.close()
            sink.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (f"{folder}/shard-{shard:06d}.sst", pa.string()), (out.entries, pa.int64()), (out.tokens, pa.int64()), (size, pa.int64()))], ["shard", "path", "docs", "tokens", "bytes"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    place = F.xxhash64("text")
    made = rows.repartitionByRange("doc_id", place).sortWithinPartitions("doc_id", place, "text").mapInArrow(run, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, shards: list[tuple[int, str]]) -> DataFrame:
    """One row per document of these (shard, path): shard, doc_id, start in the shard, token count and crc32 of its ids. A task a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for name, first, ids in ShardReader(path).rows():
                    rows.append((shard, name, first, len(ids), zlib.crc32(ids.astype("<u4"))))
                    if len(rows) == 50_000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    # a range of n numbers in n partitions deals one shard to each task, which neither a hash nor adaptive execution would
    nth = spark.createDataFrame([(i, *x) for i, x in enumerate(shards)], "id long, shard int, path string")
    tasks = spark.range(0, len(shards), 1, max(1, len(shards)))
    return tasks.join(F.broadcast(nth), "id").select("shard", "path").mapInArrow(run, ROWS)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Writes the shards, reads them back, and gives each document its start among all ids in doc_id order.

    Only the manifest, one row per shard, is put in one place for the running sum.
    """
    total, before, shards = 0, [], []
    for shard, path, tokens in sorted(map(tuple, write(docs, tokenizer, shared_folder(spark, "token-shards"), end).select("shard", "path", "tokens").collect())):
        before.append((shard, total))
        shards.append((shard, path))
        total += tokens
    base = spark.createDataFrame(before, "shard int, before long")
    return read(spark, shards).join(F.broadcast(base), "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
