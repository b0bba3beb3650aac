"""The corpus pipeline: quality classifier, line de-duplication, near-duplicates, mixing and packing, each stage on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.llm import linededup, minhash, mixing, packing, quality
from feedops.llm.registry import Tables, prepared
from feedops.session import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = Tables(prepared(spark), sf_dir).labels
    model = quality.train(docs, quality.training_labels(labels))
    return quality.score(docs, model).where("_score >= 0.5").drop("_score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; those of which no word is left go."""
    prepared(spark)
    left = linededup.drop_repeated_lines(docs)
    return left.where(F.col("_repeated").isNull() | F.col("text").rlike(mixing.WORD)).drop("_repeated")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates on shingles of five words."""
    prepared(spark)
    return minhash.drop_near_duplicates(docs, size=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or thinned to their targets."""
    prepared(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids. The workers serve all stages, so a task remembers fewer words."""
    prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=120_000)


STAGES: list[tuple[str, Stage]] = [("quality", good_documents), ("lines", without_repeated_lines), ("near_duplicates", without_near_duplicates), ("mix", mixed), ("pack", packed)]
# Tokens, hash orders and a fitted model have no counterpart in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = scratch_folder(spark)
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{spark._jvm.java.util.UUID.randomUUID()}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
