"""Tables that grow are dealt out into more parts, not into larger ones, with the same results."""

import pytest
from pyspark.sql import functions as F

from caselens.operators import hypergraph, incidence, rules, verify


@pytest.fixture
def members(spark):
    return spark.range(4000).select((F.col("id") % 1000).alias("edge_id"), F.lit("r").alias("role"), (F.col("id") * 7 % 640).alias("node_id"))


def more_parts(monkeypatch, module, query):
    """The result of ``query`` with small parts, after that with large ones, and the numbers of parts dealt."""
    numbers, real = [], rules.dealt

    def dealt(df, *keys, rows=None):
        out = real(df, *keys, rows=rows)
        numbers.append(out.rdd.getNumPartitions())
        return out

    rows = lambda: sorted(map(tuple, query().collect()))
    before = rows()
    monkeypatch.setattr(module, "dealt", dealt)
    monkeypatch.setattr(rules, "PART_ROWS", 200)
    return before, rows(), numbers


def test_pairs(spark, members, monkeypatch):
    before, after, numbers = more_parts(monkeypatch, hypergraph, lambda: hypergraph.weighted_neighbours(members))
    assert after == before and numbers == [20, 20, 60]


def test_nearest(spark, members, monkeypatch):
    before, after, numbers = more_parts(monkeypatch, hypergraph, lambda: hypergraph.nearest(members, 3))
    all_ = hypergraph.top_neighbours(hypergraph.weighted_neighbours(members), 3)
    assert after == before == sorted(map(tuple, all_.collect())) and numbers[:4] == [20, 20, 60, 60]


def test_matrix(spark, members, monkeypatch):
    nodes = spark.range(600).select(F.col("id").alias("node_id"))
    before, after, numbers = more_parts(monkeypatch, incidence, lambda: incidence.verify(incidence.build(members, nodes), members))
    assert after == before and numbers == [20, 20, 20, 20, 20, 40]


def test_skeleton(spark, members, monkeypatch):
    rows = members.withColumn("case_id", F.col("edge_id") % 30)
    nodes = spark.range(60).select((F.col("id") % 30).alias("case_id"), F.col("id").alias("node_id"))
    before, after, numbers = more_parts(monkeypatch, hypergraph, lambda: hypergraph.skeleton(rows, nodes))
    assert after == before and numbers == [20]


def test_checks(spark, members, monkeypatch):
    label = F.when(F.col("node_id") % 2 == 0, "Task").otherwise("Concept")
    p = members.select("edge_id", "node_id", (F.col("edge_id") % 30).alias("case_id"), label.alias("node_label"), F.lit("H1").alias("rule_id"), F.when(F.col("edge_id") % 2 == 0, "Value_Loop_Edge").otherwise("x").alias("edge_type"))
    rel = members.select(F.lit("PREREQ").alias("relation_type"), F.lit("Task").alias("source_label"), F.lit("Concept").alias("target_label"))
    metrics = members.select("node_id", F.lit("TAM").alias("key"))
    edges = p.select("edge_id", "case_id", "edge_type").distinct()
    before, after, numbers = more_parts(monkeypatch, verify, lambda: verify.verify(p, rel, metrics, p, p, edges))
    assert after == before and numbers == [20, 5, 5, 5]
