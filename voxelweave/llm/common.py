"""What the training-data operators share: the shared folder, Arrow slices, bounded word caches."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Bytes of text that a Python worker looks at together.
SLICE_BYTES = 4 << 20
#: Rows that Spark hands to a Python worker together; texts may be long.
ARROW_ROWS = 1000


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a Parquet table in the shared folder and reads it back."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; small Arrow batches, since rows may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for file:, hdfs:, s3: and like addresses."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, to
        at = to


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in order of key, and where in that order each key's run starts and how long it is."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(key) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(key)))


def pairs_in_runs(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 32, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of runs of at most `most`, those of `step` rows at a time."""
    left = np.repeat(np.where(sizes <= most, sizes, 0), sizes)
    after = np.maximum(0, left - 1 - (np.arange(len(order)) - np.repeat(starts, sizes)))
    for at in range(0, len(order), step):
        n = after[at : at + step]
        i = np.repeat(np.arange(at, at + len(n)), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield order[i], order[j]


_holds: list = ["", None]


def work_on(name: str, let_go: Callable[[], None] | None = None) -> None:
    """Says what operator a Python worker works on now; what it holds for another one, whose tasks it has had before, is let go."""
    if _holds[0] != name and _holds[1]:
        _holds[1]()
        gc.collect()
    _holds[:] = name, let_go


class PieceCache:
    """Ids of distinct strings as packed bytes. It is emptied when it holds `room` bytes, so memory is bounded; ids never change by that."""

    #: Bytes that an entry takes besides its string and ids, about.
    ENTRY = 200

    def __init__(self, encode: Callable[[list[str]], list[bytes]], width: int, room: int = 96 << 20):
        self.encode, self.width, self.room, self.known, self.held = encode, width, room, {"": b""}, 0

    def ids_of(self, strings: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """strings: the pieces of all rows, row i at offsets[i]:offsets[i+1]. Returns all ids and the offsets of each row's ids."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        missing = [x for x in distinct if x not in known]
        if missing:
            found = self.encode(missing)
            known.update(zip(missing, found, strict=True))
            self.held += self.ENTRY * len(missing) + 4 * sum(map(len, missing)) + sum(map(len, found))
        packed = list(map(known.__getitem__, distinct))
        if self.held > self.room:
            known.clear()
            self.held = 0
        flat = np.frombuffer(b"".join(packed), dtype=f"<u{self.width}")
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // self.width
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        each = size[which]
        ends = np.concatenate(([0], np.cumsum(each)))
        return spread(flat, start[which], each), ends[offsets]


def join_by_weight(rows: DataFrame, names: DataFrame, key: str, weight: str, spread_by: str, most: int = 4096) -> DataFrame:
    """rows with the columns of `names`, whose rows have one key each, where the keys meet; keys are longs or strings.

    weight says how many rows hold a key. Keys with over 1/most of all rows, fewer than `most`, are broadcast; no other key can fill a
    task, and the rows of those heavy keys are dealt by `spread_by`.
    """
    total = names.agg(F.sum(weight)).first()[0] or 0
    found = F.struct(*(F.col(c) for c in names.columns if c not in (key, weight))).alias("_found")
    heavy = names.where(F.col(weight) * most > total).select(F.col(key).alias("_heavy"), found)
    light = names.where(F.col(weight) * most <= total).select(F.col(key).alias("_light"), found.alias("_other"))
    met = rows.join(F.broadcast(heavy), rows[key] == F.col("_heavy"), "left")
    elsewhere = F.xxhash64(F.lit(key), spread_by).cast(rows.schema[key].dataType)
    met = met.withColumn("_key", F.when(F.col("_heavy").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(elsewhere))
    met = met.join(light, F.col("_key") == F.col("_light"), "left")
    own = F.coalesce("_found", F.when(F.col("_heavy").isNull() & F.col(key).isNotNull(), F.col("_other")))
    return met.withColumn("_own", own).select(*(rows[c] for c in rows.columns), "_own.*")


def split_rows(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array without nulls, and its offsets from 0."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]
