"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes what a stage returns as Parquet
in the shared folder and reads it again for the next one, so a lost executor costs
no more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindscape.functions.session import broadcast_if_small, settle
from bindscape.llm import language_id, secret_crf
from bindscape.llm.bpe import token_digests
from bindscape.llm.mixing import mix_documents
from bindscape.llm.ngram_join import one_of_each_group
from bindscape.llm.words import bounded_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANGUAGE_SCORE = 0.5  # share of a text's words, times the model's confidence
#: Several stages cannot be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def _with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is known: texts without letters go, and texts in which the
    model gives no language ``MIN_LANGUAGE_SCORE`` of the words.  A null ``lang`` becomes the
    language found.  Where no label teaches a language, all documents with letters stay.

    What a text is is decided by its words alone, so only a hash of it comes back from the
    model, and equal texts are judged alike.
    """
    bounded_batches(spark)
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = language_id.fit(labelled)
    docs = docs.select(*COLUMNS)
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs.select(F.xxhash64("text").alias("key"), "text"), model, id_col="key")
    found = settle(found.groupBy(F.col("doc_id").alias("key")).agg(F.first("lang_pred").alias("lang_pred"), F.first("score").alias("score")))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    kept = broadcast_if_small(kept.select("key", "lang_pred"), 1 << 20)  # rows of some 80 bytes
    rows = docs.where("text IS NOT NULL").withColumn("key", F.xxhash64("text")).join(kept, "key")
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least id, of each group that five-word shingles link at 0.8; no
    other row goes, also where ids are null or repeat."""
    return one_of_each_group(docs, n=5, similarity=(80, 100), one_per_id=False).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret of their texts masked."""
    bounded_batches(spark)
    return _with_lengths(secret_crf.redact(docs.select(*COLUMNS), secret_crf.fit(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of; their texts are these words."""
    return _with_lengths(mix_documents(docs.select(*COLUMNS)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    bounded_batches(spark)
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_to_weights", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
