"""Documents to packed training sequences: quality, language, near copies, repeated passages, packing.

Each stage takes all that the one before kept, as (spark, docs, sf_dir), and all but the
last return the columns of documents. A stage has the session send small batches to Python,
now and later.
"""

from __future__ import annotations

import public_tokenizers
from lodestone.llm import langid, minhash, packing, quality, suffix_dedup
from lodestone.llm.common import checkpointed, in_small_batches
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Below this score a text is like no language that was learned.
LEAST_SCORE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    in_small_batches(spark)
    return quality.quality(docs, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; lang is filled in where it is null."""
    in_small_batches(spark)
    out = langid.identify(docs, train=F.lit(True), carry=list(COLUMNS[1:]))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return out.where(known).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    in_small_batches(spark)
    gone = minhash.near_duplicates(spark, docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; a character cut in two goes too."""
    in_small_batches(spark)
    out = suffix_dedup.dedup(spark, docs, length=50, carry=("lang", "source"), characters=True)
    return out.select("doc_id", F.col("kept").cast("string").alias("text"), "carried.lang", "carried.source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 4096 tokens."""
    in_small_batches(spark)
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: zstandard ratios, learned profiles and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents; each stage's result is read from files by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
