"""Connected parts of long chains, and features of a case of many nodes."""

from pyspark.sql import functions as F

from caselens import schemas
from caselens.operators import rules


def test_long_chain(spark):
    n = 10_000
    chain = spark.range(n).select(F.lit("c").alias("case_id"), F.concat(F.lit("n"), "id").alias("source_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("target_id"))
    apart = spark.createDataFrame([("c", "x", "y"), ("d", "n1", "z")], "case_id string, source_id string, target_id string")
    members = spark.createDataFrame([("c", "e", "n5"), ("c", "e", "w"), ("c", "f", "x")], "case_id string, edge_id string, node_id string")
    starts = spark.createDataFrame([("c", "n77"), ("d", "alone")], "case_id string, id string")
    got = {tuple(r) for r in rules.components(None, chain.union(apart), members, starts).collect()}
    assert got == {("c", f"n{k}") for k in range(n + 1)} | {("c", "w"), ("d", "alone")}


def test_case_of_many_nodes(spark):
    """Lists keep their first ids by position, and all weak evidence is named."""
    n = 100_000
    have = {"id": F.concat(F.lit("e"), "id"), "case_id": F.lit("c"), "pos": F.col("id").cast("int"), "node_type": F.lit("Evidence"), "name": F.lit("interview"), "confidence": F.when(F.col("id") % 50 == 0, 0.1).otherwise(0.9)}
    types = [f.split(" ") for f in schemas.NODES.split(", ")]
    nodes = spark.range(n).select(*(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in types))
    empty = lambda s: spark.createDataFrame([], s)
    cases = spark.createDataFrame([("c", "t", "d")], "case_id string, title string, description string")
    f = rules.features(cases, nodes, empty(schemas.RELATIONS), empty(schemas.HYPEREDGES), empty("case_id string, edge_id string, node_id string")).first()
    assert f.ids_Evidence == f.ids_demand == ["e0", "e1", "e2"] and f.ids_weak == [f"e{k}" for k in range(0, n, 50)]
