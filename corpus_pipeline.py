"""A corpus made ready for training: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lucerna.llm import language_id, minhash_dedup, mixing, pieces, quality_rules
from lucerna.llm.common import checkpoint_dir, scratch, small_batches, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that was learned, or without one that holds half of their letters."""
    small_batches(spark)
    return language_id.keep_known(docs, language_id.train(language_id.training_rows(docs)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression bands, fitted to the labelled ones, or the base rules reject."""
    small_batches(spark)
    return quality_rules.keep_good(docs, limits=quality_rules.fit(quality_rules.training_rows(docs, table(spark, sf_dir, "labels"))))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    small_batches(spark)
    return minhash_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources asks: none, once or several rows."""
    return mixing.apply_mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids, their number and whether they decode to the text."""
    small_batches(spark)
    return pieces.add_tokens(docs)


STAGES = [("language", language_stage), ("quality", quality_stage), ("dedup", dedup_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]

#: None of the stages but the mixing can be said in SQL; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again; what a stage wrote on its way is removed behind it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/lucerna/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
