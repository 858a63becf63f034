"""Queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evigrid.llm import bytedup, decontaminate, divergence, html, ordinal, quality, repair, shards, simhash, sql, substrings, threads, tokens
from evigrid.session import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return found.select("row.doc_id", *quality.COUNTS, "base_failed", "kept")


def op3_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fitted(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.scored(docs, model)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trips(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :says), (-1L, 1L, 'assistant', :says) AS t(conv_id, turn, role, text)", {"says": says})
    return threads.digests(threads.conversations(given.unionByName(more)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.digests(repair.damaged(rows), rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {
        f.__name__: f for f in (
            op1_sharding, op2_quality_rules, op3_byte_dedup, op4_token_counts, op5_simhash, op6_html_text,
            op7_decontamination, op8_ordinal_quality, op9_bpe, op10_substring_dedup, op11_reply_trees, op12_source_divergence, op13_conversation_repair,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
