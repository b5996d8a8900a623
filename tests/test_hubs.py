"""Hyperedges of many members: pairs are made block by block."""

import random
from statistics import median

from pyspark.sql import functions as F

from caselens.operators import hypergraph


def brute(rows):
    members = {}
    for e, n in rows:
        members.setdefault(e, set()).add(n)
    out = {}
    for ns in members.values():
        for a in ns:
            for b in ns:
                if a != b:
                    sim, shared = out.get((a, b), (0, 0))
                    out[a, b] = (sim + round(1 / len(ns), 6), shared + 1)
    return {k: (round(s, 6), n) for k, (s, n) in out.items()}


def test_pairs_of_many_blocks(spark):
    r = random.Random(2)
    rows = [(e, r.randrange(60)) for e in range(30) for _ in range(r.choice([1, 2, 5, 40]))]
    df = spark.createDataFrame([(e, "r", n) for e, n in rows], "edge_id long, role string, node_id long")
    inc = hypergraph.weighted_incidence(df)
    want = {(e, a, b) for e in {x for x, _ in rows} for a in {n for x, n in rows if x == e} for b in {n for x, n in rows if x == e} if a != b}
    for size in (1, 3, 1000):
        got = [(x.edge_id, x.a, x.b) for x in hypergraph.member_pairs(inc, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        seeds = inc.where("node_id % 7 = 0")
        near = {(x.edge_id, x.a, x.b) for x in hypergraph.seed_pairs(seeds, inc, size).collect()}
        assert near == {x for x in want if x[1] % 7 == 0}
    pairs = brute(rows)
    assert {(x.node_id, x.neighbour_id): (float(x.similarity), x.shared) for x in hypergraph.weighted_neighbours(df).collect()} == pairs
    some = spark.createDataFrame([(7,), (7,), (14,)], "node_id long")
    assert {(x.node_id, x.neighbour_id): (float(x.similarity), x.shared) for x in hypergraph.weighted_neighbours(df, some).collect()} == {k: v for k, v in pairs.items() if k[0] in (7, 14)}
    counts = {x.node_id: x.neighbours for x in hypergraph.neighbour_counts(df).collect()}
    assert counts == {n: len({b for a, b in pairs if a == n}) for n in {n for _, n in rows}}


def test_a_hub_is_spread_over_all_tasks(spark):
    """One edge of 20,000 members: no task makes twice the pairs of the median task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 20_000  # 6,241 pairs of blocks
        hub = spark.range(n).select(F.lit(1).alias("edge_id"), F.col("id").alias("node_id"), F.lit(n).cast("long").alias("rank"))
        tasks = [r["count"] for r in hypergraph.member_pairs(hub).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == n * (n - 1) and len(tasks) == 32 and max(tasks) < 2 * median(tasks)
