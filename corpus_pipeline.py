"""From raw documents to a mixed, encoded corpus, stage by stage.

Each stage takes all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bytenet, exact, jaccard, mixing, pieces
from tidemark.llm.common import prepare, table
from tidemark.session import configure, staged

# Its steps hash sets many times as large as their texts, next to what earlier stages have left.
NEAR_BATCH = 1 << 20
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on labels, does not reject."""
    return bytenet.good(docs, table(prepare(configure(spark)), sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(configure(spark))
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar word shingles."""
    prepare(configure(spark), NEAR_BATCH)
    return jaccard.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(configure(spark))
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document, as counts and checksums, and the digest of what they spell."""
    prepare(configure(spark))
    return pieces.digests(docs, PIECES)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]
ORACLE_SQL = None  # learned scores and encodings are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
