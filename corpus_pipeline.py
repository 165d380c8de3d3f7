"""A corpus pipeline of five stages, each one operator of ``marlstone.llm`` over all that the stage before kept.

Every stage is written as Parquet and read again as the next one's documents, so a lost executor costs one stage at most.
What the stages write on the way is deleted at the end of a ``marlstone.plans.storage.scope()`` around ``run``.

Null or empty texts, ties, repeated rows, empty tables and clashing columns are handled as each stage's operator states;
all columns of the documents, also those that no stage knows, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, cotraining, jaccard, mixing, secrets
from marlstone.plans.storage import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotraining.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id, or any one if none has a doc_id."""
    return jaccard.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by marks."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in the order of its schedule."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, as digests, with what they decode to."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", bpe_encoding),
]
ORACLE_SQL = None  #: SQL cannot express the classifier; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
