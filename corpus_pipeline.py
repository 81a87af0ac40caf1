"""Corpus pipeline: the training-data operators as stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and gives
the columns of documents, the last one the mix.  run() writes each stage's result as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlens.llm import common as C, op2_mixing, op3_pii, op4_quality, op8_neardup, op9_decontam


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without those rows (doc_id, digest), digest being the xxhash64 of the text."""
    gone = C.materialize(rows.select(F.col("doc_id").alias("__graphlens_id"), F.col("digest").alias("__graphlens_digest")).distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("__graphlens_id")) & (F.xxhash64("text") == F.col("__graphlens_digest"))
    return docs.join(C.small(gone), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling keeps."""
    drawn = op4_quality.resample(docs, C.read(spark, sf_dir, "labels"))
    return _without(docs, drawn.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept")).filter("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: the one with the class's id."""
    return op8_neardup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs."""
    return _without(docs, op9_decontam.hits(docs, C.read(spark, sf_dir, "benchmark")).filter("size(spans) > 0"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and words that disclose it, by their kind."""
    clean = op3_pii.sanitize(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: (doc_id, size, source_size, target, taken) of every document left."""
    return op2_mixing.mixed(docs).drop("first_finish")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("private", private), ("mixture", mixture)]

#: No SQL for the learned, sampled and near-duplicate stages: tests hold each against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
