"""From raw documents to token ids: each stage works on all that the one before kept.

Null and empty texts have no words, so the first stage rejects them; a later stage that is
run by itself treats them alike (one of them stays in near-dedup, none is contaminated, the
mix takes none, the token store holds the end id alone). A row with a null ``doc_id`` stays
in near-dedup only if no member of its group has an id. Repeated rows are judged alike;
near-dedup keeps one. An empty table passes through every stage. Columns beyond those of
``documents`` pass all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import decontaminate, mixing, quality, simhash, tokens
from caselens.llm._common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's adaptive thresholds."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too many words inside benchmark windows."""
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the token store."""
    path = tokens.write_store(docs.select("doc_id", "text"))
    return tokens.read_store(docs.select(F.col("doc_id").cast("long").alias("key")), path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: SQL has no fingerprint, subset-sum choice or tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
