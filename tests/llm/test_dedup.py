import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelweave.llm import components, embedding_dedup, simhash

DOCS = "doc_id long, text string"


def plain_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB é\t\n\x1c\x85Ö", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_golay_decodes_three_errors():
    rng = np.random.default_rng(1)
    for _ in range(200):
        info = int(rng.integers(0, 4096))
        word = info << 11
        rest = word
        for i in range(22, 10, -1):
            if rest >> i & 1:
                rest ^= simhash.GOLAY << i - 11
        code = word ^ rest
        for n in range(4):
            bad = code
            for b in rng.choice(23, n, replace=False):
                bad ^= 1 << int(b)
            assert simhash.codeword_index(np.array([bad], np.uint64))[0] == info
    near = simhash.nearby(rng.integers(0, 1 << 23, 5000).astype(np.uint64), 23)
    assert set((near >= 0).sum(1)) == {1, 6}


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2 + rng.integers(0, 2, 4000, dtype=np.uint64)
    one, two = rng.integers(0, 64, 4000, dtype=np.uint64), rng.integers(0, 64, 4000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << one) ^ np.where(one == two, np.uint64(0), np.uint64(1) << two)
    keys = []
    for x in (a, b):
        row, key = simhash.keys(x)
        keys.append(set(zip(row.tolist(), key.tolist(), strict=True)))
    assert {r for r, _ in keys[0] & keys[1]} == set(range(4000))


def near_links(prints, radius=2):
    return [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]


@pytest.mark.parametrize("pairwise", [24, 2])
def test_links_of_crowded_fingerprints(spark, roots, monkeypatch, pairwise):
    """Both ways, pairs and stars, and a crowd of fingerprints within a few bits."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = list(dict.fromkeys([*base, *(base[0] ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(150)), *(b ^ 1 << 63 for b in base[:10]), 0, 1, 3, 15]))
    rows = [(p - (1 << 64) * (p >> 63), i) for i, p in enumerate(prints)]
    got = components.components(simhash.links(spark.createDataFrame(rows, "print long, node long")))
    found = dict(map(tuple, got.collect()))
    expected = roots(len(prints), near_links(prints))
    assert [found.get(i, i) for i in range(len(prints))] == expected


def test_op1_rows(make, roots):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(300)]
    long = [rnd.choice(words) for _ in range(400)]
    texts = ["", None, " \n", "one", "one two", "ONE  two", " ".join(long), " ".join(long).upper(), " ".join(long[:-1] + ["zz"]), " ".join(long[:200] + ["zz"] + long[201:]), *(" ".join(rnd.choice(words) for _ in range(20)) for _ in range(30)), "x" * 200_000]
    rows = [(100 - 2 * i, t) for i, t in enumerate(texts)] + [(100, ""), (94, "one"), (None, "one")]
    got = simhash.classes(make(rows, DOCS)).collect()
    prints = [plain_print(t) for _, t in rows[:-1]]
    ids = [i for i, _ in rows[:-1]]
    comp = roots(len(ids), near_links(prints) + [(i, j) for i in range(len(ids)) for j in range(i) if ids[i] == ids[j]])
    least = {c: min(i for i, k in zip(ids, comp, strict=True) if k == c) for c in set(comp)}
    expected = [(i, p - (1 << 64) * (p >> 63), least[c]) for i, p, c in zip(ids, prints, comp, strict=True)]
    p = plain_print("one")
    assert sorted(map(tuple, got), key=repr) == sorted([*expected, (None, p - (1 << 64) * (p >> 63), None)], key=repr)
    assert len({r["component_id"] for r in got if r["doc_id"] == 94}) == 1
    assert simhash.classes(make([], DOCS)).collect() == []


@pytest.mark.parametrize("segments", [2, 3])
def test_soft_keys_meet_from_a_similarity_of_four_fifths(segments):
    rng = np.random.default_rng(11)
    missed = {}
    for n in (5, 9, 45, 400):
        shared = 4 if n == 5 else round(2 * n * 0.8 / 1.8)
        one, two = [], []
        for _ in range(400):
            both = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            one.append(simhash.votes(both[:n], segments))
            two.append(simhash.votes(np.concatenate((both[:shared], both[n : n + (0 if n == 5 else n - shared)])), segments))
        a, b = simhash.soft_keys(np.array(one), segments), simhash.soft_keys(np.array(two), segments)
        missed[n] = sum(not set(x.tolist()) & set(y.tolist()) for x, y in zip(a, b, strict=True))
        tables, places = simhash.PLANS[segments]
        assert len(set(a[0].tolist())) == tables * places
        assert (simhash.soft_keys(np.array(one)[:3], segments) == a[:3]).all()
    assert max(missed.values()) <= 4, missed


def test_sizes_of_alike_sets_share_a_cell():
    from voxelweave.llm import near_copies

    for size in range(1, 3000):
        for other in {size, size * 5 // 4, (size + size * 5 // 4) // 2}:
            assert set(near_copies.cells(size)) & {near_copies.cells(other)[0]}, (size, other)


def test_components_of_chains_and_stars(spark, roots):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + rnd.randrange(1, 80)) for _ in range(60)] + [(200 + rnd.randrange(50), 200 + rnd.randrange(50)) for _ in range(40)]
    rnd.shuffle(links)
    got = dict(map(tuple, components.components(spark.createDataFrame([(b, a) if rnd.random() < 0.5 else (a, b) for a, b in links], "a long, b long")).collect()))
    expected = roots(300, links)
    assert got == {i: expected[i] for a, b in links if a != b for i in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute(rows, cosine=0.98):
    n = len(rows)
    links = []
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine - (1e-12 if (unit[i] == unit[j]).all() else 0):
                links.append((i, j))
    return links


@pytest.mark.parametrize("block", [512, 8])
def test_op6_rows(make, roots, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    vectors = [*base, *(base[0] + 0.04 * rng.standard_normal((60, 16))), *(base[1] * k for k in (1, 2, 0.5)), *(b + 0.06 * rng.standard_normal(16) for b in base)]
    rows = [(1000 - i, [float(np.float32(x)) for x in v], i % 3 if i > 110 else 0) for i, v in enumerate(vectors)]
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [1.0] * 15 + [None], 0), (4, [1.0] * 15 + [float("nan")], 0), (5, [float("inf")] + [1.0] * 15, 0), (6, rows[0][1], None), (7, rows[0][1], 0), (8, [-0.0, *rows[0][1][1:]], 0), (9, [0.0, *rows[0][1][1:]], 0), (10, [1.0, 2.0], 0), (11, [2.0, 4.0], 0), (12, [], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(make(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = brute(rows)
    comp, degree = roots(len(rows), links), np.bincount(np.array(links).ravel(), minlength=len(rows))
    least = {c: min(r[0] for r, k in zip(rows, comp, strict=True) if k == c) for c in set(comp)}
    for i, (v, _, _) in enumerate(rows):
        r = got[v]
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], least[comp[i]], v == least[comp[i]]), v


def test_op6_repeats_and_nulls(make):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (-1, [0.0, 1.0], 0)]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(make(rows, "vec_id long, embedding array<float>, label int")).collect()), key=repr)
    # vec_id 2 has two vectors, one of them equal to another's
    assert got == sorted([(-1, 1, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, -1, False), (2, 2, 1, False), (None, 0, None, False)], key=repr)
    assert embedding_dedup.near_duplicates(make([], "vec_id long, embedding array<float>, label int")).collect() == []


def made_codes(v, bits=16, tables=20, cosine=0.98):
    sign, factor, level, step, error = embedding_dedup.stored(v, max(v.shape[1], bits * tables))
    return embedding_dedup.Codes(sign, factor, level, step, error, v.shape[1], bits, tables, cosine)


@pytest.mark.parametrize("dim", [32, 33, 64])
def test_binary_codes_bound_and_estimate(dim):
    rng = np.random.default_rng(6)
    u = rng.standard_normal((300, dim))
    v = u + 0.15 * rng.standard_normal((300, dim))
    u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (u, v))
    codes, n = made_codes(np.concatenate((u, v))), np.arange(300)
    close = np.einsum("ij,ij->i", u, v) >= 0.98
    assert 20 < close.sum() < 300
    may = codes.undecided(n, n + 300)
    assert may[n, n][close].all() and may.sum() < 0.02 * may.size + 300
    assert (codes.undecided_pairs(n, n + 300) == may[n, n]).all()
    # the estimate from the stored signs, factor and steps is unbiased over rotations
    a, b, estimates = u[0], v[1], []
    for seed in range(400):
        turn = embedding_dedup.rotations(dim, 1, seed)
        s = np.where(turn @ a > 0, 1, -1) / np.sqrt(dim)
        estimates.append(s @ (turn @ b) / (s @ (turn @ a)))
    assert abs(np.mean(estimates) - a @ b) < 0.03
    # and what the stored steps leave out is within the stored error
    exact = v @ embedding_dedup.rotations(dim, 1)[:dim].T
    assert (np.linalg.norm(codes.steps[300:] - exact, axis=1) <= codes.error[300:] + 1e-6).all()
    for rows in (100, 10**6, 10**10):
        bits, tables = embedding_dedup.plan_tables(rows)
        assert bits < 63 and (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= embedding_dedup.MISS


@pytest.mark.parametrize(("label", "values"), [("string", ["a", "b"]), ("long", [2**40, 2**40 + 2**32]), ("double", [0.5, 1.5]), ("boolean", [True, False])])
def test_op6_labels_of_any_type(make, label, values):
    rows = [(1, [1.0, 0.0], values[0]), (2, [1.0, 0.01], values[0]), (3, [1.0, 0.0], values[1]), (4, [1.0, 0.0], None)]
    got = sorted(map(tuple, embedding_dedup.near_duplicates(make(rows, f"vec_id long, embedding array<double>, label {label}")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_op6_recall_on_pairs_at_the_threshold(spark):
    """Pairs of a cosine from 0.98 on, the hardest to meet, among vectors that are near to many."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    u = centres[rng.integers(0, 40, 1200)] + 0.8 * rng.standard_normal((1200, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.standard_normal((1200, 32))
    w -= np.einsum("ij,ij->i", w, u)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    t = rng.uniform(0.9801, 0.982, 1200)[:, None]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate((u, t * u + np.sqrt(1 - t * t) * w)))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    assert [got[i] for i in range(2400)] == ((x @ x.T >= 0.98).sum(1) - 1).tolist()


def test_op6_sql(spark):
    import duckdb

    from voxelweave.llm.queries import op6_embedding_dedup, oracle_sql

    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    rel = con.sql(oracle_sql()["op6_embedding_dedup"])
    got = op6_embedding_dedup(spark, "/root/testdata/sf0.001")
    assert rel.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
