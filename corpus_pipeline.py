"""A corpus pipeline: each stage calls one operator and its decisions take effect on the documents.

Stages are functions (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
documents; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece_codec
from tracelode.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest original, then the least id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, similarity 0.8) stays: the least id."""
    return jaccard_join.drop_near_duplicates(docs, n=5, threshold=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth or more lies in 13-word windows of benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and round_trip."""
    return sentencepiece_codec.encode_column(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", tokens_stage),
]

#: The first stage learns a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
