"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fraction_sketch, html_text, language_id, packing, piece_bpe, secret_scan, simhash, sstable, trie_counts
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_FILE, PIECE_FILE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_FILE))


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_FILE))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_FILE))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_file(WORD_FILE))


def op2_fraction_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraction_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_id.held_out().alias("held_out"), "text")
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


OPERATORS = (op1_simhash_dedup, op2_fraction_sketch, op3_token_counts, op4_piece_bpe, op5_html_text, op6_embedding_dedup, op7_packing, op8_secret_scan, op9_language_id, op10_token_shards)


#: op6 as SQL: all pairs of a label, and a walk along links for the components.
LINKED_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  r(a, c) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, least(vec_id, coalesce(c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op6_embedding_dedup": LINKED_VECTORS, "op8_secret_scan": secret_scan.oracle_sql()}
