"""Corpus pipeline: toxic documents go, one of each group of near-duplicates stays, documents with benchmark
passages go, secrets are masked, and what is left becomes token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowspark.llm import decontaminate, secret_scan, sentencepiece_codec, simhash, toxicity
from flowspark.llm.common import table
from flowspark.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    lexicon = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints of three-word shingles at three bits or fewer, the smallest id."""
    return simhash.representatives(docs, words=3, distance=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text where it changes."""
    masked = secret_scan.redact(docs.withColumn("__before", F.xxhash64("text")))
    changed = F.xxhash64("text") != F.col("__before")
    return masked.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .select(*docs.columns)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether decoding them gives the text again."""
    made = sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", to_token_ids),
]

# the Viterbi search and the fingerprints are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
