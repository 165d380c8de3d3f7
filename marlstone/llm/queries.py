"""The opN_<name> queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, cotraining, jaccard, licenses, mixing, neighbours, packing, quality_rules, secrets
from marlstone.plans.storage import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents, sources weighing 5, 2, 1, repeating, and the slots of its schedule."""
    return mixing.taken(_table(spark, sf_dir, "documents")).drop("source")


def op2_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of the multilingual rank file, packed into rows of 8192."""
    import public_tokenizers

    vocabulary = packing.BpeIds(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary)


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by the multilingual rank file, then decode its ids."""
    import public_tokenizers

    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of every document."""
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found, by inner product, of every vector whose id is divisible by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations, parsed by the line model and rendered canonically."""
    written = cut(chat.transcripts(_table(spark, sf_dir, "conversations")), "transcripts")
    return chat.format_transcripts(written, chat.fit(written))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set sizes and near-duplicate components of all documents."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document, judged by the full policy."""
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    rows = quality_rules.apply_policy(rows, quality_rules.FULL)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE)).cast("long")) != 0).alias("base_failed"), "kept",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained scores of all documents."""
    return cotraining.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_packed_rows": op2_packed_rows,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_secret_scan": op4_secret_scan,
    "op5_license_scan": op5_license_scan,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_chat_format": op7_chat_format,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
}
