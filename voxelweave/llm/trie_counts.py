"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

A text is cut at white space; each word, with the word mark before it, is a pre-token. Distinct pre-tokens go into
a trie. A node keeps the best score of its prefix under the unigram model and that segmentation's token count, made
once from the nodes above it; a pre-token's count is its last node's. The model gives the piece of rank r the score
-ln(1 + r), as whole millionths, so sums are exact; equal scores take the fewer tokens. A character in no piece costs
UNKNOWN and counts one token per UTF-8 byte.

A task keeps its own trie and empties it when it takes `room` bytes, so no row moves and memory is bounded: by that and one word's nodes.

Cases: a null or empty text counts 0; a null doc_id is kept; repeated rows are counted each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import split_rows, text_slices, work_on

MARK = "▁"
UNKNOWN = -20_000_000
SCHEMA = "doc_id long, n_words long, n_tokens long"


def piece_scores(model: str) -> dict[str, int]:
    """Scores of a sentencepiece vocabulary's ordinary pieces, by their rank in it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {sp.id_to_piece(i): -round(1e6 * math.log1p(r)) for r, i in enumerate(ordinary)}


class Trie:
    """Pre-tokens and their counts. Node n has best[n], a score and minus the token count, and terminal counts when asked for."""

    #: Bytes that a node takes, and an entry of the terminals besides its string, about.
    NODE, ENTRY = 250, 150

    def __init__(self, scores: dict[str, int], room: int = 400 << 20):
        self.scores, self.longest, self.room = scores, max(map(len, scores), default=1), room
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best: list[tuple[int, int]] = [(0, 0)]
        self.terminal: dict[str, int] = {}
        self.held = 0

    def count(self, word: str) -> int:
        """Tokens of the pre-token; makes the nodes that it adds to the trie."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        if self.held + self.NODE * len(self.best) > self.room:
            self.clear()
        path, node, children = [0], 0, self.children
        for d, c in enumerate(word, 1):
            below = children.get((node, c))
            if below is None:
                below = children[node, c] = len(self.best)
                self.best.append(self.forward(word, d, path))
            node = below
            path.append(node)
        self.terminal[word] = n = -self.best[node][1]
        self.held += self.ENTRY + 4 * len(word)
        return n

    def forward(self, word: str, d: int, path: list[int]) -> tuple[int, int]:
        best, scores, found = self.best, self.scores, []
        for j in range(max(0, d - self.longest), d):
            s = scores.get(word[j:d])
            if s is not None:
                before = best[path[j]]
                found.append((before[0] + s, before[1] - 1))
        if word[d - 1] not in scores:
            before = best[path[d - 1]]
            found.append((before[0] + UNKNOWN, before[1] - len(word[d - 1].encode())))
        return max(found)


@functools.cache
def loaded(model: str) -> Trie:
    return Trie(piece_scores(model))


def load(model: str) -> Trie:
    work_on("trie_counts", loaded.cache_clear)
    return loaded(model)


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, words and unigram tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(model)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                words, offsets = split_rows(pc.utf8_split_whitespace(pc.fill_null(part.column(1), "")))
                coded = words.dictionary_encode()
                each = np.array([trie.count(MARK + w) if w else 0 for w in coded.dictionary.to_pylist()], dtype=np.int64)
                real = np.array([bool(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)
                which = coded.indices.to_numpy(zero_copy_only=False)
                sums = [np.concatenate(([0], np.cumsum(x[which]))) if len(which) else np.zeros(1, np.int64) for x in (real, each)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s[offsets[1:]] - s[offsets[:-1]]) for s in sums)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
