"""The corpus pipeline: documents in, sharded training mix out. Each stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import decontaminate, mixing, ngram_join, quality, sharding
from sitegauge.llm.common import read, stage
from sitegauge.llm.queries import SHARDS, TABLE_SIZE
from sitegauge.llm.sql import pipeline_sql

ORACLE_SQL: str | None = pipeline_sql(SHARDS, TABLE_SIZE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge(docs, only_kept=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that consist of them for more than half."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; sources with few tokens are repeated up to the limit."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its slot and shard."""
    return sharding.place(docs, "doc_id", SHARDS, TABLE_SIZE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
