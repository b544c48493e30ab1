"""The corpus pipeline: from raw documents to token ids.

Each stage takes what its predecessor kept and calls one operator of :mod:`gridweave.llm` with production parameters:

1. language: naive Bayes learned from labelled documents; goes what has no letters, or no language more likely than not;
2. quality: votes of rules weighed by expectation-maximisation; goes what fails beforehand or is more likely bad;
3. near_copies: five-word shingles, Jaccard similarity of 0.8 or more; of each component the smallest doc_id stays;
4. decontaminate: goes what holds a 10-word window of a benchmark item;
5. encode: byte-level BPE ids, decoded again.

All but the last return the columns of documents. NULL and empty texts go at the first stage, so an empty table
passes through as an empty one; repeated rows are one component, of which one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, decontaminate, language, near, quality
from gridweave.session import settle

#: Documents whose likeliest language has less than this posterior probability go.
LEAST_CHANCE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    langs, matrix = language.train(language.training_rows(docs))
    told = language.annotate(docs, langs, matrix, pred="_lang_pred", chance="_lang_chance")
    return told.where((F.col("_lang_pred") != "und") & (F.col("_lang_chance") >= LEAST_CHANCE)).drop("_lang_pred", "_lang_chance")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicate(docs, k=5, num=80, den=100)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers), and digests of ids and decoded text."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.round_trip_documents(docs, path)
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage), ("quality", quality_stage), ("near_copies", near_copies_stage),
    ("decontaminate", decontaminate_stage), ("encode", encode_stage),
]

#: No stage but the fourth can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
