"""Hubs in the k-hop search: the same neighbours as by brute force, without a row for each pair."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from caselens.operators import hypergraph, rules

LIMITS = {"k_hop": 2, "top_k": 4, "frontier_width": 3, "hop_top_n": 6}


def brute(rows, seeds, k_hop, top_k, frontier_width, hop_top_n, decay=0.85):
    members = defaultdict(list)
    for e, n in rows:
        members[e].append(n)
    members = {e: ns for e, ns in members.items() if len(set(ns)) > 1}
    out = set()
    for seed in seeds:
        frontier, total = [(seed, 1.0)], Counter()
        for hop in range(k_hop):
            scores = Counter()
            for at, score in frontier:
                for ns in members.values():
                    for n in ns:
                        if n != at:
                            scores[n] += score * round(1 / len(set(ns)), 6) * ns.count(at)
            placed = sorted(((-round(v, 9), n) for n, v in scores.items()))[:hop_top_n]
            kept = [(n, -v) for v, n in placed if n != seed and v < 0]
            for n, v in kept:
                total[n] += v * decay**hop
            frontier = kept[:frontier_width]
        best = sorted((-round(v, 6), n) for n, v in total.items())[:top_k]
        out |= {(seed, n, k + 1) for k, (_, n) in enumerate(best)}
    return out


def test_hubs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hypergraph, "BLOCK", 5)
    for seed in range(3):
        r = random.Random(seed)
        # hubs of nodes with one membership, of shared nodes and roles given twice, and small edges
        rows = [(e, 100 * e + k) for e in (1, 2, 3) for k in range(30)]
        rows += [(e, r.randrange(1, 12)) for e in (2, 3, 4, 5, 6) for _ in range(6)] + [(e, 100 * e + r.randrange(30)) for e in (2, 3, 1) for _ in range(2)] + [(7, 105), (7, 3), (8, 9)]
        nodes = sorted({n for _, n in rows})
        made = spark.createDataFrame([(e, "r", n) for e, n in rows], "edge_id long, role string, node_id long")
        seeds = spark.createDataFrame([(n,) for n in nodes], "node_id long")
        got = {(x.node_id, x.neighbour_id, x.place) for x in hypergraph.khop_neighbours(made, seeds, **LIMITS).collect()}
        assert got == brute(rows, nodes, **LIMITS)


def test_like_members_of_a_hub_are_searched_once(spark, monkeypatch):
    counts, real = [], hypergraph.checkpointed

    def counted(df):
        out = real(df)
        if "place" in out.columns:
            counts.append(out.count())
        return out

    monkeypatch.setattr(hypergraph, "checkpointed", counted)
    members = spark.range(3000).select(F.lit(1).alias("edge_id"), F.lit("r").alias("role"), F.col("id").alias("node_id"))
    found = hypergraph.khop_neighbours(members, members.select("node_id"), 2, 2, frontier_width=5, hop_top_n=20).groupBy("node_id").agg(F.sort_array(F.collect_list("neighbour_id")).alias("x")).collect()
    assert len(found) == 3000 and {tuple(x.x) for x in found if x.node_id > 25} == {(0, 1)}
    assert sum(counts) < 1000, counts


def test_a_task_has_few_seeds_and_lists(spark, monkeypatch):
    """With small parts the search has more of them, and the same result."""
    dealt_out, real = [], hypergraph.dealt
    monkeypatch.setattr(hypergraph, "dealt", lambda df, *keys, rows=None: dealt_out.append(real(df, *keys, rows=rows)) or dealt_out[-1])
    members = spark.range(4000).select((F.col("id") % 1000).alias("edge_id"), F.lit("r").alias("role"), (F.col("id") * 7 % 640).alias("node_id"))
    seeds = members.select("node_id").distinct()
    rows = lambda df: sorted(map(tuple, df.collect()))
    before = rows(hypergraph.khop_neighbours(members, seeds))
    monkeypatch.setattr(rules, "PART_ROWS", 200)
    monkeypatch.setattr(hypergraph, "SEEDS", 10)
    found = hypergraph.khop_neighbours(members, seeds)
    assert rows(found) == before
    assert {df.rdd.getNumPartitions() for df in dealt_out[-2:]} == {20} and found.rdd.getNumPartitions() == 64
