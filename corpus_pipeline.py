"""Clean a corpus: language, quality, near copies, test items, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept. Models are learned from the tables of ``sf_dir``. Nulls, empty texts
and repeated rows are treated as the operators say; no documents give none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import bpe, decontaminate, language_id, minhash, quality_crf
from rankforge.llm.common import stored, table
from rankforge.llm.queries import GOOD, RANKS, line_model, profiles

# A text less like every known language than this is rejected.
LEAST_COSINE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; what has no letter goes."""
    return language_id.keep_identified(docs, profiles(spark, sf_dir), LEAST_COSINE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good."""
    return quality_crf.keep_good(docs, line_model(spark, sf_dir), GOOD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return minhash.keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    tokens = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_test_items),
    ("byte_bpe", encode_tokens),
]

# SQL has no n-gram vectors, no marginals, no tiles and no merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
