"""A corpus pipeline of the training-data operators. Each stage's result is written and read again as the next one's documents.

Cases, for all stages: an empty table gives an empty one; columns besides those of documents are ignored, whatever their names. Null and empty texts, and
texts without a letter, go in the first stage, and so does a text whose best language has a share of less than LEAST_SHARE; one of just that share stays.
A document without a doc_id stays in every stage; of repeated rows one stays; of documents that are alike the one of the least doc_id; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import language_id, near_copies, secret_scan
from voxelweave.llm.common import materialise, table
from voxelweave.llm.packing import pack
from voxelweave.llm.queries import WORD_FILE, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the best language below which a document is taken for no language's.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no clear winner."""
    scored = language_id.predict(docs, language_id.fit(docs))
    return scored.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near-copies: SimHash and Golay keys of five-word shingles, Jaccard similarity of at least 0.8."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; every document stays."""
    return secret_scan.redact(docs).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left into windows."""
    return pack(docs, tokenizer_file(WORD_FILE))


STAGES = [("language id", identify_language), ("near-dedup", drop_near_copies), ("secret scan", redact_secrets), ("packing", pack_windows)]

#: Language models, minimum hashes and tokenizers are not SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
