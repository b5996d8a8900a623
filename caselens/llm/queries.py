"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, decontaminate, lines, mixing, oracle, phrases, quality, sharding, simhash, tokens, trie, urls, warc
from ._common import table
from .oracle import CONTROL_TEXT


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    path = tokens.write_store(documents.select("doc_id", "text"))
    return tokens.read_store(documents.select(F.col("doc_id").cast("long").alias("key")), path)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_runs, kept_chars and sha256 of what is left of each text."""
    cleaned = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    removed = F.aggregate("removed_runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return cleaned.select(
        "doc_id", "n_lines", removed.alias("n_removed"), F.to_json("removed_runs").alias("removed_runs"), F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256")
    )


def op4_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.read_chats(spark, chat.write_chats(given.union(added)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.dedup_groups(table(spark, sf_dir, "documents"), threshold=2, width=3, seed=42)
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.with_slots(sharding.assign(table(spark, sf_dir, "documents"), sharding.layout(16)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


def op10_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, top=2000, share=50)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), limit=1024)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store, op2_url_filter, op3_line_dedup, op4_chat_examples, op5_decontaminate,
        op6_simhash_dedup, op7_hash_tree, op8_quality_rules, op9_warc_segments, op10_budget_mix,
        op11_collocations, op12_token_counts, op13_prefix_trie,
    )
}
ORACLE_SQL: dict[str, str] = oracle.SQL
