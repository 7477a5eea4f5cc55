"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import (
    bpe, decontaminate, groupjoin, katz, kmeans, licenses, neardup, negatives, quality, secrets, tokenbin, toxicity, urls,
)
from pairloom.llm.batches import crc32_remainder
from pairloom.llm.oracle import ORACLE
from pairloom.session import ship

QUERIES = {}

# The rules of the URL query.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark, folder):
    return decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query
def op2_quality_divergence(spark, folder):
    rows = quality.judge_quality(_table(spark, folder, "documents"))
    return rows.drop("class_distance", "word_distance", "profile_distance")


@query
def op3_url_rules(spark, folder):
    listed = [F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action")) for r, a in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*listed)))
    return urls.judge_urls(_table(spark, folder, "pages"), rules)


@query
def op4_near_duplicates(spark, folder):
    return neardup.near_duplicates(_table(spark, folder, "documents"))


@query
def op5_toxicity(spark, folder):
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(
        docs, _table(spark, folder, "labels"), learn=lambda c: crc32_remainder(c, 4) != 2
    )
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc32_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op6_byte_bpe(spark, folder):
    return bpe.encode_decode(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    ).drop("decoded_equal")


@query
def op7_token_files(spark, folder):
    return tokenbin.write_and_read(
        _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, added=True
    )


@query
def op8_secrets(spark, folder):
    return secrets.scan_secrets(_table(spark, folder, "documents"))


@query
def op9_license_rules(spark, folder):
    return licenses.scan_licenses(_table(spark, folder, "documents")).drop("detections")


@query
def op10_katz_backoff(spark, folder):
    ship(spark, katz.PIECE)
    docs = _table(spark, folder, "documents")
    scored = katz.score_texts(docs, learn=lambda c: crc32_remainder(c, 7) != 2)
    return scored.select("doc_id", (crc32_remainder("doc_id", 7) == 2).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_ns_kmeans(spark, folder):
    return kmeans.cluster_vectors(_table(spark, folder, "embeddings"))


@query
def op12_hard_negatives(spark, folder):
    """Every seventh row gets the next label, so that it is a negative of its like."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, folder, "embeddings").withColumn("label", moved)
    return negatives.mine_negatives(rows, lambda vec_id: vec_id % 100 == 0)


@query
def op13_group_join(spark, folder):
    return groupjoin.similar_groups(_table(spark, folder, "documents"))


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
