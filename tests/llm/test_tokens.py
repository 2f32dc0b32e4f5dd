import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelweave.llm import packing, piece_bpe, sstable, trie_counts, word_tokens
from voxelweave.llm.queries import PIECE_FILE, WORD_FILE, tokenizer_file

KINDS = "doc_id long, text string"


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_FILE))


def word_ids(text):
    return word_tokens.load(tokenizer_file(WORD_FILE)).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_word_tokens(texts):
    ids, offsets = word_tokens.load(tokenizer_file(WORD_FILE)).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == word_ids(t), t


def test_cache_that_overflows(texts):
    w = word_tokens.WordTokens(tokenizer_file(WORD_FILE))
    w.chunks.room = 4000
    ids, offsets = w.encode(pa.array(texts * 2, pa.string()))
    assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == [word_ids(t) for t in texts]


def test_a_worker_lets_go_of_another_operators_caches():
    one = word_tokens.load(tokenizer_file(WORD_FILE))
    assert word_tokens.load(tokenizer_file(WORD_FILE)) is one
    trie_counts.load(tokenizer_file(PIECE_FILE))
    assert word_tokens.load(tokenizer_file(WORD_FILE)) is not one


def test_piece_bpe(texts, pieces):
    bpe = piece_bpe.load(tokenizer_file(PIECE_FILE))
    ids, offsets = bpe.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == pieces.encode(t or ""), t
        assert bpe.decode(own) == pieces.decode(own)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "ABCDabcd0123+/", "日本語は難しい", "aaab", "the"])
def test_piece_bpe_of_100_000_code_points_without_spaces(pieces, alphabet):
    import random
    import time

    rnd = random.Random(len(alphabet))
    text = "".join(rnd.choice(alphabet) for _ in range(100_000))
    bpe = piece_bpe.PieceBpe(tokenizer_file(PIECE_FILE))
    start = time.time()
    ids, _ = bpe.encode(pa.array([text]))
    assert time.time() - start < 10
    assert ids.tolist() == pieces.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeilnrst", min_size=1, max_size=300))
def test_queue_of_pairs_gives_what_rounds_give(text):
    bpe = piece_bpe.load(tokenizer_file(PIECE_FILE))
    own = [x for c in text for x in bpe.symbols(c)]
    assert bpe.merge_long(list(own)) == bpe.merge(np.array(own), np.zeros(1, np.int64))[0].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_piece_bpe_any_text(text):
    import sentencepiece

    bpe = piece_bpe.load(tokenizer_file(PIECE_FILE))
    ids, _ = bpe.encode(pa.array([text]))
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_FILE))
    assert ids.tolist() == sp.encode(text)
    assert bpe.decode(ids.tolist()) == sp.decode(ids.tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999)), max_size=12))
def test_decode_any_ids(ids):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE_FILE))
    assert piece_bpe.load(tokenizer_file(PIECE_FILE)).decode(ids) == sp.decode(ids)


def test_op4_rows(make, texts, pieces):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    got = piece_bpe.encode_decode(make(rows, KINDS), tokenizer_file(PIECE_FILE)).collect()
    expected = []
    for i, t in rows:
        ids = pieces.encode(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    whole = piece_bpe.encode_decode(make(rows[-2:], KINDS), tokenizer_file(PIECE_FILE), "whole").collect()
    assert [r["ids"] for r in sorted(whole, key=lambda r: r["doc_id"])] == [pieces.encode(t or "") for _, t in rows[-2:]]
    assert piece_bpe.encode_decode(make([], KINDS), tokenizer_file(PIECE_FILE)).collect() == []


def slow_count(word, scores):
    """Best score and fewest tokens over all cuts, by plain dynamic programming over ends."""
    best = [(0, 0)]
    for d in range(1, len(word) + 1):
        options = [(best[j][0] + scores[word[j:d]], best[j][1] - 1) for j in range(d) if word[j:d] in scores]
        if word[d - 1] not in scores:
            options.append((best[d - 1][0] + trie_counts.UNKNOWN, best[d - 1][1] - len(word[d - 1].encode())))
        best.append(max(options))
    return -best[-1][1]


def every_cut(word, scores):
    def cuts(at):
        if at == len(word):
            yield 0, 0
        for to in range(at + 1, len(word) + 1):
            p = word[at:to]
            own = (scores[p], 1) if p in scores else (trie_counts.UNKNOWN, len(p.encode())) if to == at + 1 else None
            if own:
                for s, n in cuts(to):
                    yield s + own[0], n + own[1]

    return min((-s, n) for s, n in cuts(0))[1]


def test_trie_counts_against_every_cut():
    scores = {"a": -5, "b": -6, "ab": -8, "ba": -9, "aba": -14, "▁": -3, "▁a": -7, "bb": -12}
    trie = trie_counts.Trie(scores)
    for n in range(1, 8):
        for k in range(2**n):
            word = "▁" + "".join("ab"[k >> i & 1] for i in range(n)) + "é" * (k % 2)
            assert trie.count(word) == every_cut(word, scores) == slow_count(word, scores), word


def test_trie_counts_rows(make, texts):
    scores = trie_counts.piece_scores(tokenizer_file(PIECE_FILE))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (1, "twice"), (1, "twice")]
    got = trie_counts.count_tokens(make(rows, KINDS), tokenizer_file(PIECE_FILE)).collect()
    words = [[w for w in pa.compute.utf8_split_whitespace(pa.array([t or ""]))[0].as_py() if w] for _, t in rows]
    expected = [(i, len(w), sum(slow_count("▁" + x, scores) for x in w[:300]) * (len(w) <= 300)) for (i, _), w in zip(rows, words, strict=True)]
    short = [r for r in map(tuple, got) if r[1] <= 300]
    assert sorted(short, key=repr) == sorted((e for e in expected if e[1] <= 300), key=repr)
    assert len(got) == len(rows)
    small = trie_counts.Trie(scores, room=50_000)
    assert [small.count("▁" + w) for w in words[-4][:40]] == [slow_count("▁" + w, scores) for w in words[-4][:40]]


def test_capacity_tree():
    import random

    rnd, tree, have = random.Random(1), packing.CapacityTree(100), []
    for _ in range(2000):
        want = rnd.randrange(101)
        fits = sorted(c for c in have if c >= want)
        assert tree.tightest(want) == (fits[0] if fits else -1)
        if have and rnd.random() < 0.45:
            have.remove(c := rnd.choice(have))
            tree.add(c, -1)
        else:
            have.append(c := rnd.randrange(101))
            tree.add(c, 1)


def plain_best_fit(lengths, window):
    room, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if fits:
            least = min(fits)[0]
            w = [w for r, w in fits if r == least][0]
        else:
            w = len(room)
            room.append(window)
        room[w] -= lengths[i]
        where[i] = w
    return len(room), sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_best_fit_decreasing(lengths):
    where, offset, n = packing.best_fit(np.array(lengths), 30)
    assert (n, sorted(30 - sum(v for v, w in zip(lengths, where, strict=True) if w == k) for k in range(n))) == plain_best_fit(lengths, 30)
    for k in range(n):
        own = sorted((o, v) for v, w, o in zip(lengths, where, offset, strict=True) if w == k)
        assert [o for o, _ in own] == np.cumsum([0, *[v for _, v in own]])[:-1].tolist()


def test_op7_rows(make, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[-1]), (None, "null id")]
    got = packing.pack(make(rows, KINDS), tokenizer_file(WORD_FILE)).collect()
    ids = {(i, len(x)): x for i, x in ((i, [*word_ids(t), 1]) for i, t in rows)}
    seqs = {}
    for r in got:
        own = ids[r["doc_id"], r["doc_tokens"]]
        assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist() and sum(n for _, n in s) <= packing.WINDOW
    assert sum(r["length"] for r in got) == sum(len(word_ids(t)) + 1 for _, t in rows)
    assert packing.pack(make([], KINDS), tokenizer_file(WORD_FILE)).collect() == []


def test_op10_rows(spark, make, texts):
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts)] + [(None, "null id"), (2, "again"), (2, "and again")]
    got = sstable.round_trip(spark, make(rows, KINDS), tokenizer_file(WORD_FILE)).collect()
    start, expected = 0, []
    place = dict(map(tuple, spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").selectExpr("text", "xxhash64(text)").collect()))
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place[r[1]])):
        ids = [*word_ids(t), 2]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert sstable.round_trip(spark, make([], KINDS), tokenizer_file(WORD_FILE)).collect() == []


def test_shards_are_read_by_as_many_tasks(spark, make, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i if i % 3 else 7, f"text {i} " * 50) for i in range(400)]  # a third has one identifier
    manifest = sstable.write(make(rows, KINDS).repartition(3), tokenizer_file(WORD_FILE), f"file://{tmp_path}/shards")
    shards = sorted(map(tuple, manifest.select("shard", "path").collect()))
    many = [(i, shards[i % len(shards)][1]) for i in range(37)]
    got = sstable.read(spark, many)
    assert got.rdd.getNumPartitions() == 37
    by_task = got.select("shard", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["task"] for r in by_task}) == len(by_task) == 37
    read = sstable.read(spark, shards)
    assert read.count() == 400
    assert read.where("doc_id = 7").select("shard").distinct().count() > 1 or len(shards) == 1


def test_shard_lookup(tmp_path):
    path, rnd = str(tmp_path / "x.sst"), np.random.default_rng(3)
    rows = {int(k): rnd.integers(0, 60000, int(rnd.integers(0, 400))) for k in sorted(set(rnd.integers(-(10**9), 10**9, 3000).tolist()))}
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, 2)
        w.add(sstable.key_of(None), np.array([7]))
        for k, ids in rows.items():
            w.add(sstable.key_of(k), ids)
        last = max(rows)
        w.add(sstable.key_of(last), np.array([1, 2]))
        w.close()
    r = sstable.ShardReader(path)
    assert len(r.blocks) > 5 and r.entries == len(rows) + 2
    assert [n for n, _, _ in r.rows()] == [None, *rows, last]
    for k in list(rows)[::37]:
        assert [x.tolist() for x in r.lookup(k)][0] == rows[k].tolist()
    assert len(r.lookup(last)) == 2 and r.lookup(None)[0].tolist() == [7]
    absent = [k for k in range(0, 10**6, 997) if k not in rows]
    assert not any(r.lookup(k) for k in absent)
    assert sum(r.may_hold(sstable.key_of(k)) for k in absent) < 0.05 * len(absent)
    raw = bytearray(open(path, "rb").read())
    for at in (-1, -20, -sstable.FOOTER.size - 3):
        bad = bytearray(raw)
        bad[at] ^= 255
        (tmp_path / "bad").write_bytes(bytes(bad))
        with pytest.raises(ValueError):
            sstable.ShardReader(str(tmp_path / "bad"))
