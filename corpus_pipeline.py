"""The corpus pipeline: quality rules, quality classifier, near-duplicates, packing.

``run(spark, sf_dir)`` applies the stages to the table ``documents`` of
``sf_dir``. Each stage's result is written as Parquet in the shared folder of
``spark.checkpoint.dir`` and read again as the next one's documents, so a lost
executor costs at most a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import best_fit, near_dedup, quality_classifier, quality_rules
from rollcall.llm.common import read, stage_table
from rollcall.llm.queries import RANKS


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return quality_rules.keep_clean(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample."""
    return quality_classifier.resample_documents(docs, read(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, by tokens, and their places in the bins."""
    counted = best_fit.count_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return best_fit.best_fit_packing(counted, F.col("n_tokens"))


STAGES = [("quality_rules", clean), ("quality_classifier", classify), ("near_dedup", dedup), ("best_fit_packing", pack)]

#: Alignment, Gumbel sampling and best-fit placement have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
