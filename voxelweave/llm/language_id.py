"""Language identification: known words first, then ever shorter character n-grams.

Fitting counts words, and n-grams of 1 to LONGEST characters of marked words, by language over a sample of labelled
documents of at most `per_language` each, taken by a hash of doc_id; the model's size is bounded by that. A word
seen in the sample scores its log frequency in each language. For an unseen word the n-grams of LONGEST characters that were seen
are averaged; if none was, those one shorter, and so on. A text's languages are ranked by the sum over its words; score is the
best one's share after the mean word score is scaled to at most CERTAIN words.

Cases: a null text, or one without a letter, is `und` with score 0, and so is any text if nothing was learned; equal sums take the
first language by name; a null doc_id isn't held out and isn't learned from; repeated rows are each predicted; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_rows, text_slices, work_on

LONGEST, CERTAIN, SMOOTHING, PER_LANGUAGE = 4, 30, 0.5, 2000
UNDETERMINED = "und"
#: Distinct words, and bytes of text that they come from, that a task holds before it hands their counts on.
HELD, HELD_BYTES = 250_000, 32 << 20
#: Bytes of text that are looked at together.
SLICE = 1 << 20
#: Bytes of unseen words and their scores that a model keeps at hand, about.
CACHED = 16 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters and marks of all texts, and the offsets of each text's."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM]+", " ")
    return split_rows(pc.split_pattern(pc.utf8_trim(plain, " "), " "))


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def counts(docs: DataFrame) -> DataFrame:
    """lang, n (0 for words), gram and its count over docs(lang, text); summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work_on("language_id")
        held: dict[str, Counter] = {}
        taken = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                found: Counter = Counter()
                for w, c in words.items():
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            found[n, g] += c
                for part in itertools.batched(itertools.chain((((0, w), c) for w, c in words.items()), found.items()), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([k[0] for k, _ in part], pa.int32()), pa.array([k[1] for k, _ in part]), pa.array([c for _, c in part], pa.int64())], ["lang", "n", "gram", "c"])
            held.clear()

        for batch in batches:
            for a, b in text_slices(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                words, offsets = words_of(part.column(1))
                words = words.to_pylist()
                for lang, i, j in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    held.setdefault(lang, Counter()).update(filter(None, words[i:j]))
                taken += part.column(1).nbytes
                if taken > HELD_BYTES or sum(map(len, held.values())) > HELD:
                    yield from given()
                    taken = 0
        yield from given()

    return docs.select("lang", "text").mapInArrow(run, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


class Model:
    """Log frequencies by language: one table of words, one for each n-gram length."""

    def __init__(self, found: pa.Table):
        self.langs = sorted(set(found["lang"].to_pylist()))
        at = {x: i for i, x in enumerate(self.langs)}
        lang = np.array([at[x] for x in found["lang"].to_pylist()], dtype=np.int64)
        n, c, gram = found["n"].to_numpy(), found["c"].to_numpy(), found["gram"].to_pylist()
        self.index, self.logs = [], []
        for k in range(LONGEST + 1):
            own = np.flatnonzero(n == k)
            index: dict[str, int] = {}
            rows = np.array([index.setdefault(gram[i], len(index)) for i in own.tolist()], dtype=np.int64)
            table = np.full((len(index), len(self.langs)), SMOOTHING)
            if len(own):
                np.add.at(table, (rows, lang[own]), c[own])
            self.index.append(index)
            self.logs.append(np.log(table / table.sum(axis=0)) if len(index) else table)
        self.cache: dict[str, np.ndarray] = {}
        self.held = 0

    def forget(self) -> None:
        self.cache.clear()
        self.held = 0

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            index = self.index[n]
            rows = [index[g] for g in grams(word, n) if g in index]
            if rows:
                return self.logs[n][rows].mean(axis=0)
        return np.zeros(len(self.langs))

    def word_scores(self, words: list[str]) -> np.ndarray:
        known, out = self.index[0], np.zeros((len(words), len(self.langs)))
        at = np.array([known.get(w, -1) for w in words], dtype=np.int64)
        seen = at >= 0
        out[seen] = self.logs[0][at[seen]]
        if self.held > CACHED:
            self.cache.clear()
            self.held = 0
        for i in np.flatnonzero(~seen).tolist():
            w = words[i]
            if w:
                found = self.cache.get(w)
                if found is None:
                    found = self.cache[w] = self.unseen(w)
                    self.held += 250 + 4 * len(w) + found.nbytes
                out[i] = found
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words, offsets = words_of(texts)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        coded = words.dictionary_encode()
        each, which = self.word_scores(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False)
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            sums = np.concatenate(([0.0], np.cumsum(each[which, k])))
            total[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
        n = np.maximum(1, np.diff(offsets))
        scaled = total * (np.minimum(n, CERTAIN) / n)[:, None]
        share = np.exp(scaled - scaled.max(axis=1)[:, None])
        share /= share.sum(axis=1)[:, None]
        best = total.argmax(axis=1)
        score = np.where(lettered, share[np.arange(len(best)), best], 0.0)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of docs(doc_id, lang, text), from at most about per_language documents of each language, chosen by a hash of doc_id."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    sizes = dict(labelled.groupBy("lang").count().collect())
    if sizes:
        share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        labelled = labelled.where(place < share[F.col("lang")])
    return Model(counts(labelled).toArrow())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names; every other column is kept."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work_on("language_id", shared.value.forget)
        for batch in batches:
            for a, b in text_slices(batch.column(text_at), SLICE):
                part = batch.slice(a, b - a)
                langs, score = shared.value.predict(part.column(text_at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kind}, lang_pred string, score double")
