"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, line_dedup, mixing, ngram_join, period_runs, pii, prefix_trie, quality, sharding, substring_dedup, warc
from .common import read
from .sql import ORACLES, shard_sql

__all__ = ["ORACLES", "QUERIES"]

SHARDS = [f"shard-{i:02d}" for i in range(32)]
TABLE_SIZE = 3209  # a prime of more than a hundred slots per shard


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat_format.conversations(read(spark, sf_dir, "conversations"))
    out = chat_format.formatted(chat_format.next_answers(convs))
    return out.withColumns({c: chat_format.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, "doc_id", SHARDS, TABLE_SIZE)


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(read(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_of(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_marks(read(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.digest(period_runs.find(period_runs.with_turns(read(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_preference_pairs, op3_pii_weak_supervision, op4_decontaminate, op5_quality_divergence, op6_signature_join, op7_shard_table, op8_temperature_mix, op9_warc_revisits, op10_main_text,
    op11_substring_dedup, op12_prefix_trie, op13_period_runs,
)}

ORACLES["op7_shard_table"] = shard_sql(SHARDS, TABLE_SIZE)
