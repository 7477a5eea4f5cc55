"""From raw documents to tokens: toxicity, near duplicates, benchmark passages, secrets, byte-level BPE.

Every stage works on all rows that its predecessor kept. The first four drop rows and leave the
columns of ``documents`` as they are; the last returns ids and digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from pairloom.llm.batches import crc32_remainder
from pairloom.session import ship, stored

# JVM and worker each hold a batch or two per task, beside what earlier stages made the JVM keep
BATCH_BYTES = 4 << 20
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# No SQL: the classifier, the signatures and the tokenizer have none.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.3; labels of rows with a crc32 remainder of 2 (of 4) teach nothing."""
    ship(spark, BATCH_BYTES)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, learn=lambda c: crc32_remainder(c, 4) != 2)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at a similarity of 0.8: that of the least id."""
    ship(spark, BATCH_BYTES)
    return neardup.one_of_each(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of ``benchmark``."""
    ship(spark, BATCH_BYTES)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a reported secret."""
    ship(spark, BATCH_BYTES)
    return secrets.without_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids."""
    ship(spark, BATCH_BYTES)
    return bpe.encode_decode(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True,
        piece_bytes=1 << 19, held=150_000,
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", drop_secrets),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
