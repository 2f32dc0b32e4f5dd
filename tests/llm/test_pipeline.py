import zlib

import numpy as np

import corpus_pipeline
from voxelweave.llm import simhash
from voxelweave.llm.queries import WORD_FILE, tokenizer_file
from voxelweave.llm.word_tokens import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_plain_python(spark, tmp_path, roots):
    import random

    rnd = random.Random(8)
    words = {"en": ["the", "and", "cat", "dog", "over", "lazy"], "de": ["der", "und", "hund", "katze", "faul", "die"]}
    texts = [(" ".join(rnd.choice(words[x]) + str(rnd.randrange(9)) * (k % 3 == 0) + rnd.choice(["", "", "q", "zz"]) for _ in range(60)), x) for k in range(30) for x in words]
    texts += [texts[0], (texts[2][0].upper(), "en"), ("123 !!", "en"), (None, None), ("", "de"), ('the cat password="hunter22" and the dog', "en"), ("der hund " * 3000, "de")]
    rows = [(i, t, x, "s", len(t or "")) for i, (t, x) in enumerate(texts)]
    spark.createDataFrame([*rows, rows[5]], DOCS).selectExpr("*", "1 AS score", "'z' AS spans", "2 AS component_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    prints = [simhash.fingerprint(r[1]) for r in kept]
    comp = roots(len(kept), [(i, j) for i in range(len(kept)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    kept = [r for i, r in enumerate(kept) if comp[i] == i]
    tokens = load(tokenizer_file(WORD_FILE)).tokenizer
    expected = {r[0]: [*tokens.encode(r[1].replace('password="hunter22', "[SECRET]"), add_special_tokens=False).ids, 1] for r in kept}
    assert {r["doc_id"] for r in got} == set(expected)
    for i, ids in expected.items():
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4")) == c for a, n, c in own)


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert docs.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "near-dedup", "secret scan", "packing"]


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_dedup_against_brute_force_jaccard(spark, roots):
    """Every pair of at least 0.8 over the documents of sf0.01, few bits of SimHash apart or many."""
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    sets = [plain_shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(h[0], i) for h in holders.values() for i in h[1:]} | {(i, j) for h in holders.values() if len(h) <= 60 for i in h for j in h if i < j}
    links = [(i, j) for i, j in pairs if alike(sets[i], sets[j])]
    assert any(sets[i] != sets[j] and (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > 2 for i, j in links)
    comp = roots(len(rows), links)
    empty = [i for i, s in enumerate(sets) if not s]
    expected = {rows[i][0] for i in range(len(rows)) if comp[i] == i} - {rows[i][0] for i in empty[1:]}
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted(expected)


def test_near_dedup_of_crowds_chains_and_repeated_ids(spark, roots, monkeypatch):
    import random

    from voxelweave.llm import near_copies

    monkeypatch.setattr(near_copies, "VOLUME", 2000)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(150):  # a crowd about one text, a few edits each
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(120)] = "edit%d" % rnd.randrange(10**6)
        texts.append(" ".join(t))
    for _ in range(12):  # a chain: each a step from the one before
        base = base[6:] + [f"w{rnd.randrange(10**6)}" for _ in range(6)]
        texts.append(" ".join(base))
    texts += ["one", "ONE ", "a b c d e", "a b c d f"]
    rows = [(1000 - i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    sets = [plain_shingles(t) for t in texts]
    comp = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    least = {c: min(r[0] for r, k in zip(rows, comp, strict=True) if k == c) for c in comp}
    twice = [(5, "a text that is unlike all of the others here", "en", "s", 1), (5, "and one more of the very same id but other words", "en", "s", 1)]
    nameless = [(None, "one", "en", "s", 3)] * 2
    got = [tuple(r)[:2] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([*rows, *rows[:3], *twice, twice[0], *nameless], DOCS), "").collect()]
    expected = [r[:2] for r in rows if r[0] in set(least.values())]
    assert sorted(got, key=repr) == sorted([*expected, *(r[:2] for r in twice), *(r[:2] for r in nameless)], key=repr)


def test_language_stage_at_the_least_share(spark, monkeypatch):
    from pyspark.sql import functions as F

    from voxelweave.llm import language_id

    shares = {1: 0.5, 2: 0.4999, 3: 1.0, 4: 0.9}
    monkeypatch.setattr(language_id, "fit", lambda docs: None)
    monkeypatch.setattr(language_id, "predict", lambda docs, model: docs.withColumns({"lang_pred": F.when(F.col("doc_id") == 4, language_id.UNDETERMINED).otherwise("en"), "score": F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("doc_id").cast("int")]}))
    docs = spark.createDataFrame([(i, "a text", "en", "s", 6) for i in shares], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 3]


def test_join_by_weight_is_a_left_join(spark):
    from voxelweave.llm.common import join_by_weight

    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 5 else None if i % 2 else "absent") for i in range(600)]
    counts = {}
    for _, k in rows:
        if k not in (None, "absent"):
            counts[k] = counts.get(k, 0) + 1
    names = spark.createDataFrame([(k, n, f"name of {k}") for k, n in counts.items()], "tag string, n long, name string")
    for most in (2, 10, 4096):
        got = join_by_weight(spark.createDataFrame(rows, "id long, tag string"), names, "tag", "n", "id", most)
        assert got.columns == ["id", "tag", "name"]
        assert sorted(map(tuple, got.collect())) == sorted(((i, k, f"name of {k}" if k in counts else None) for i, k in rows), key=lambda r: r[0])
