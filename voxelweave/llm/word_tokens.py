"""Ids of a `tokenizers` file whose pre-tokeniser drops white space, through distinct white-space chunks.

No match of such a pre-tokeniser crosses white space, so a text's ids are those of its chunks. Chunks of
Latin-1 characters are cut into words here and given to the BPE model; any other chunk goes through the
whole tokenizer.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import PieceCache, split_rows, work_on

#: The pre-tokeniser's pattern for lower-case Latin-1 text.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte: printable Latin-1 stands for itself, the rest is counted from 256."""
    printable = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.chunks = PieceCache(self.encode_chunks, self.width)

    def word(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(byte_letters())
        return np.array([x.id for x in self.model.tokenize(mapped)], dtype=f"<u{self.width}").tobytes()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        odd, words = [], self.words
        if self.held > self.chunks.room:
            words.clear()
            self.held = 0
        for i, chunk in enumerate(chunks):
            if (chunk.isascii() or max(chunk) < "Ā") and "<|" not in chunk:
                got = []
                for w in WORDS.findall(chunk.lower()):
                    ids = words.get(w)
                    if ids is None:
                        ids = words[w] = self.word(w)
                        self.held += PieceCache.ENTRY + 2 * len(w) + len(ids)
                    got.append(ids)
                out[i] = got[0] if len(got) == 1 else b"".join(got)
            else:
                odd.append(i)
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=f"<u{self.width}").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none) and the offsets of each text's ids."""
        return self.chunks.ids_of(*split_rows(pc.ascii_split_whitespace(pc.fill_null(texts, ""))))


@functools.cache
def loaded(path: str) -> WordTokens:
    return WordTokens(path)


def load(path: str) -> WordTokens:
    work_on("word_tokens", loaded.cache_clear)
    return loaded(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> Iterator[np.ndarray]:
    """Each text's ids and then `end`, as little-endian unsigned 32-bit integers."""
    tail = np.array([end], dtype="<u4")
    for a, b in itertools.pairwise(offsets.tolist()):
        yield np.concatenate((ids[a:b].astype("<u4"), tail))
