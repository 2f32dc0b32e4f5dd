"""Encoding and decoding with a sentencepiece BPE model, by vectorised merge rounds.

A text is normalised (spaces become the word mark, one mark goes before it) and cut before each run of marks; no piece
crosses such a cut. The distinct units that a task meets are laid out as one flat array of symbols. Each round
finds every pair's merged piece, takes each unit's best rank by a segmented minimum and merges the leftmost
occurrences in all units at once; units without a pair left are compacted away. All occurrences of a unit's best
pair merge in one round, unless the merged piece could at once form a pair as good or better: then only the first does.
A unit of over LONG symbols, such as a text without spaces, would take a round for nearly each of its merges; it goes through
a queue of its pairs by rank and place, whose merges are the same.

Only models with BPE, the identity normaliser, byte fallback and the word mark before words are taken.

Cases: a null or empty text has no ids; a null doc_id is kept; repeated rows are encoded each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import PieceCache, split_rows, text_slices, work_on

MARK = "▁"
NONE = np.int64(1) << 60
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Symbols that one set of merge rounds lays out together.
ROUND_SYMBOLS = 1 << 20
#: Symbols of the longest unit that rounds take.
LONG = 512
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceBpe:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        kind = ["byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "" for i in range(n)]
        ordinary = {p: i for i, p in enumerate(self.pieces) if not kind[i]}
        if any(MARK in p.lstrip(MARK) for p in ordinary):
            raise ValueError("a piece crosses the start of a word")
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if kind[i] == "byte"}
        self.width = 2 if n <= 1 << 16 else 4
        # symbols: the pieces, then the characters that occur in pieces but are none themselves
        self.symbol = dict(ordinary)
        for c in sorted({c for p in ordinary for c in p} - set(ordinary)):
            self.symbol[c] = n + len(self.symbol)
        self.inner = {i: c for c, i in self.symbol.items() if i >= n}
        self.base = max(self.symbol.values(), default=0) + n + 1
        scores = sorted({sp.get_score(i) for i in ordinary.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for p, i in ordinary.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        rank = np.full(self.base, NONE, dtype=np.int64)
        for i in ordinary.values():
            rank[i] = order[sp.get_score(i)]
        self.rank = rank[self.made]
        self.pair = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        self.hasty = np.zeros(self.base, dtype=bool)  # merged pieces that could at once form a pair as good or better
        for side in (self.keys // self.base, self.keys % self.base):
            self.hasty[side[self.rank <= rank[side]]] = True
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if kind[i] == "byte" else b"" if kind[i] == "control" else " ⁇ ".encode() if kind[i] == "unknown" else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.kind, self.digits = kind, list(map(str, range(n)))
        self.odd = {i for i, k in enumerate(kind) if k in ("unknown", "control")}
        self.units = PieceCache(self.encode_units, self.width)
        self.letters: dict[str, list[int]] = {}

    def symbols(self, char: str) -> list[int]:
        """A character's symbol, or those of its bytes if no piece has it."""
        found = self.letters.get(char)
        if found is None:
            i = self.symbol.get(char)
            found = self.letters[char] = [i] if i is not None else [self.byte[b] for b in char.encode()]
        return found

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def merge(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of units, unit i from start[i]: the same after all merges."""
        size = np.diff(np.append(start, len(sym)))
        live, done = np.arange(len(start)), []
        while len(live):
            start = np.cumsum(size) - size
            left, right = sym, np.append(sym[1:], 0)
            rank, made = self.look_up(left, right)
            rank[start + size - 1] = NONE
            best = np.minimum.reduceat(rank, start)
            going = best < NONE
            if not going.all():
                ended = np.flatnonzero(~going)
                done.append((live[ended], spread_units(sym, start[ended], size[ended]), size[ended]))
                keep = np.repeat(going, size)
                sym, rank, made = sym[keep], rank[keep], made[keep]
                live, size, best = live[going], size[going], best[going]
                if not len(live):
                    break
                start = np.cumsum(size) - size
            unit = np.repeat(np.arange(len(live)), size)
            at = np.flatnonzero(rank == best[unit])
            # leftmost first: of touching occurrences every other one counts
            run = np.concatenate(([True], np.diff(at) > 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            u = unit[at]
            lead = np.concatenate(([True], np.diff(u) > 0))
            hasty = np.zeros(len(live), dtype=bool)
            hasty[u[self.hasty[made[at]]]] = True
            at = at[lead | ~hasty[u]]
            sym = sym.copy()
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym = sym[keep]
            size = size - np.bincount(unit[at], minlength=len(live))
        return ordered(done)

    def merge_long(self, sym: list[int]) -> list[int]:
        """Symbols of one unit after all merges: the best pair first, of equal ones the leftmost."""
        pair, base, n = self.pair, self.base, len(sym)
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        queue = [(found[0], i, found[1], key) for i in range(n - 1) if (found := pair.get(key := sym[i] * base + sym[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, made, key = heapq.heappop(queue)
            j = after[i]
            if j < 0 or sym[i] < 0 or sym[i] * base + sym[j] != key:
                continue
            sym[i], sym[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for at in (before[i], i):
                if at >= 0 and after[at] >= 0 and (found := pair.get(key := sym[at] * base + sym[after[at]])):
                    heapq.heappush(queue, (found[0], at, found[1], key))
        return [x for x in sym if x >= 0]

    def encode_units(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(units):
            flat, sizes = [], []
            while at < len(units) and (not sizes or len(flat) < ROUND_SYMBOLS):
                own = [x for c in units[at] for x in self.symbols(c)]
                if len(own) > LONG:
                    own = self.merge_long(own)
                flat += own
                sizes.append(len(own))
                at += 1
            size = np.array(sizes, dtype=np.int64)
            full = np.flatnonzero(size)
            sym, got = self.merge(np.array(flat, dtype=np.int64), (np.cumsum(size) - size)[full]) if len(full) else (np.zeros(0, np.int64), size)
            size[full] = got
            ends = np.cumsum(size)
            if self.inner and len(inside := np.flatnonzero(sym >= len(self.pieces))):
                spelt = [[self.byte[b] for b in self.inner[i].encode()] for i in sym[inside].tolist()]
                extra = np.zeros(len(sym) + 1, dtype=np.int64)
                extra[inside + 1] = [len(x) - 1 for x in spelt]
                size = size + np.add.reduceat(np.append(extra[1:], 0), np.minimum(ends - size, len(sym)))
                parts = np.split(sym, np.sort(np.concatenate((inside, inside + 1))))
                sym = np.concatenate([np.array(spelt[k // 2], dtype=np.int64) if k % 2 else p for k, p in enumerate(parts)])
                ends = np.cumsum(size)
            packed, w = sym.astype(f"<u{self.width}").tobytes(), self.width
            out += [packed[w * (e - n) : w * e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the offsets of each text's ids."""
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        flat, offsets = split_rows(cut)
        marked = pc.binary_join_element_wise(pa.scalar(MARK), flat, "")
        # rows with marks of their own, or with spaces side by side or at an end, are cut by pattern
        odd = np.zeros(len(texts), dtype=bool)
        if len(flat):
            bare = pc.equal(flat, "").to_numpy(zero_copy_only=False) | pc.match_substring(flat, MARK).to_numpy(zero_copy_only=False)
            some = np.concatenate(([0], np.cumsum(bare)))
            odd = some[offsets[1:]] > some[offsets[:-1]]
        if odd.any():
            lists = []
            for i in np.flatnonzero(odd).tolist():
                text = texts[i].as_py()
                lists.append(UNITS.findall(MARK + text.replace(" ", MARK)) if text else [])
            sizes = np.diff(offsets)
            keep = np.repeat(~odd, sizes)
            plain = marked.filter(pa.array(keep))
            units = pa.concat_arrays([plain, pa.array([u for x in lists for u in x], pa.string())])
            new = sizes.copy()
            new[odd] = [len(x) for x in lists]
            where = np.zeros(len(texts), dtype=np.int64)
            where[~odd] = np.cumsum(sizes[~odd]) - sizes[~odd]
            where[odd] = len(plain) + np.cumsum(new[odd]) - new[odd]
            order = spread_units(np.arange(len(units)), where, new)
            marked, offsets = units.take(pa.array(order)), np.concatenate(([0], np.cumsum(new)))
        return self.units.ids_of(marked, offsets)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids of the vocabulary."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        if self.odd.isdisjoint(ids):
            try:
                text = raw.decode()
                return text[1:] if text[:1] == " " and self.pieces[ids[0]][:1] == MARK else text
            except UnicodeDecodeError:
                pass
        out, held, fresh = [], bytearray(), True
        for i in ids:
            if self.kind[i] == "byte":
                held += self.bytes_of[i]
                fresh = False
                continue
            out.append(lenient(bytes(held)))
            held.clear()
            piece = self.bytes_of[i].decode()
            out.append(piece[1:] if fresh and self.kind[i] == "" and piece[:1] == " " else piece)
            fresh = fresh and self.kind[i] == "control"
        out.append(lenient(bytes(held)))
        return "".join(out)


def lenient(raw: bytes) -> str:
    """UTF-8 text, with the replacement character for each byte that starts no whole character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def spread_units(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(len(shift))]


def ordered(done: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Puts finished units back in their first order."""
    unit = np.concatenate([d[0] for d in done])
    sym, size = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
    order = np.argsort(unit)
    return spread_units(sym, (np.cumsum(size) - size)[order], size[order]), size[order]


@functools.cache
def loaded(path: str) -> PieceBpe:
    return PieceBpe(path)


def load(path: str) -> PieceBpe:
    work_on("piece_bpe", loaded.cache_clear)
    return loaded(path)


def encode_decode(docs: DataFrame, model: str, fields: str = "digest") -> DataFrame:
    """Per document its ids and the text decoded from them; fields="digest" gives their count and SHA-256 instead."""
    real = fields != "digest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, offsets = bpe.encode(part.column(1))
                rows = []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = ids[i:j].tolist()
                    text = bpe.decode(own)
                    rows.append((own, text) if real else (j - i, hashlib.sha256(",".join([bpe.digits[x] for x in own]).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                kinds = (pa.list_(pa.int32()), pa.string()) if real else (pa.int64(), pa.string(), pa.string())
                names = ["ids", "decoded"] if real else ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string" if real else SCHEMA)
