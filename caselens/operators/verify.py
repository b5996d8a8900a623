"""Structural checks of a loaded case graph, one row each.

``semantics``: case_id, node_label, node_id, rule_id. ``relations``: relation_type,
source_id, source_label, target_id, target_label. ``metrics``: node_id, key.
``participants``: edge_id, edge_type, node_id. ``contains``: case_id, node_label, node_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.operators.rules import dealt


def annotated(semantics: DataFrame, rows: int | None = None) -> DataFrame:
    """rule_id, node_label, n: distinct annotated nodes of each label."""
    keys = "rule_id", "node_label", "node_id"
    return dealt(semantics.select(*keys), *keys, rows=rows).distinct().groupBy("rule_id", "node_label").agg(F.count("node_id").alias("n"))


def verify(semantics: DataFrame, relations: DataFrame, metrics: DataFrame, participants: DataFrame, contains: DataFrame, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """check, ok, a, b: the two counters that each check compares.

    ``rows``: about how many rows ``semantics`` and ``edges`` have at most, counted if not given.
    """
    n_edges = edges.count() if rows is None else rows
    notes = annotated(semantics, rows)
    of = lambda rule, *labels: F.coalesce(F.sum(F.when((F.col("rule_id") == rule) & (F.col("node_label").isin(*labels) if labels else F.lit(True)), F.col("n"))), F.lit(0))
    by_label = notes.agg(
        of("H1", "Concept").alias("v1a"), of("H1", "Artifact").alias("v1b"), of("H2").alias("v2b"), of("H3").alias("v3b"), of("H5", "Metric").alias("v5b"), of("H6").alias("v6a"), of("H7", "Mistake").alias("v7b"),
        of("H11", "Method", "Task").alias("v11a"), of("H12", "Project").alias("v12a"), of("H13", "Evidence").alias("v13a"), of("H14", "Project").alias("v14a"), of("H14", "Artifact", "Evidence", "Metric").alias("v14b"),
    )
    r, s, t = F.col("relation_type"), F.col("source_label"), F.col("target_label")
    pair = ((s == "Concept") & (t == "Task")) | ((s == "Task") & (t == "Concept"))
    by_relation = relations.agg(F.count_if((r == "PREREQ") & pair).alias("v2a"), F.count_if((r == "PRODUCES") & (s == "Task") & (t == "Artifact")).alias("v3a"), F.count_if((r == "MEASURED_BY") & (s == "Artifact") & (t == "Metric")).alias("v5a"))
    by_metric = metrics.agg(F.count_distinct(F.when(F.upper("key").isin("TAM", "SAM", "SOM"), F.col("node_id"))).alias("v4a"), F.count_distinct(F.when(F.upper("key").isin("CAC", "LTV"), F.col("node_id"))).alias("v8a"))
    edges = dealt(edges, "edge_id", rows=n_edges)
    sizes = edges.join(participants.groupBy("edge_id").agg(F.count_distinct("node_id").alias("size")), "edge_id", "left")
    loop = F.col("edge_type") == "Value_Loop_Edge"
    most = lambda c: F.coalesce(F.max(F.when(c, F.coalesce("size", F.lit(0)))), F.lit(0))
    by_edge = sizes.agg(F.count_if(loop).alias("v9a"), most(loop).alias("v9b"), F.count_if(~loop).alias("v10a"), most(~loop).alias("v10b"))
    worked = contains.where(F.col("node_label").isin("Task", "Method", "Artifact")).select("case_id").distinct()
    risky = dealt(edges.where(~loop).select("edge_id", "case_id"), "case_id", rows=n_edges).join(worked, "case_id", "left_semi")
    by_case = dealt(risky.select("edge_id"), "edge_id", rows=n_edges).distinct().agg(F.count("edge_id").alias("v15a"))
    mistakes = contains.agg(F.count_if(F.col("node_label") == "Mistake").alias("v7a"))
    row = reduce(lambda a, b: a.crossJoin(b), (by_label, by_relation, by_metric, by_edge, by_case, mistakes))  # one row each
    c = F.col
    zero = F.lit(0).cast("long")

    def check(n: int, a: Column, b: Column | None, ok: Column) -> Column:
        return F.struct(F.lit(f"V{n}").alias("check"), ok.alias("ok"), a.cast("long").alias("a"), (zero if b is None else b.cast("long")).alias("b"))

    both = lambda n, more=0: check(n, c(f"v{n}a"), c(f"v{n}b"), (c(f"v{n}a") > 0) & (c(f"v{n}b") > more))
    some = lambda n: check(n, c(f"v{n}a"), None, c(f"v{n}a") > 0)
    checks = [
        both(1), both(2, 1), both(3, 1), check(4, c("v4a"), None, c("v4a") == 3), both(5), some(6), both(7), check(8, c("v8a"), None, c("v8a") == 2),
        check(9, c("v9a"), c("v9b"), (c("v9a") > 0) & (c("v9b") >= 3)), check(10, c("v10a"), c("v10b"), (c("v10a") > 0) & (c("v10b") >= 3)), some(11), some(12), some(13), both(14), some(15),
    ]
    return row.select(F.inline(F.array(*checks)))
