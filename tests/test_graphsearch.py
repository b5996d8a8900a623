"""Keyword-seeded paths and subgraphs against brute force."""

import random

from pyspark.sql import functions as F

from caselens.operators import graphsearch, hypergraph

NODES = "id string, label string, name string, description string, tags_text string"
EDGES = "src string, dst string, type string, id long"


def graph(seed, n=40, m=60):
    r = random.Random(seed)
    words = ["market", "size", "渠道", "user", "Mark"]
    nodes = [(f"n{k}", r.choice(["A", "B"]), r.choice([" ".join(r.sample(words, 2)), None, "x"]), r.choice(["about " + r.choice(words), None]), None) for k in range(n)]
    edges = [(f"n{min(r.randrange(n), r.randrange(n))}", f"n{r.randrange(n)}", r.choice("TU"), k) for k in range(m)]
    return nodes, edges


def brute_paths(nodes, edges, keywords, limit):
    ends = {(a, b, i, t) for a, b, t, i in edges} | {(b, a, i, t) for a, b, t, i in edges}
    seeds = [n[0] for n in nodes if any(k.lower() in (n[c] or "").lower() for k in keywords for c in (2, 3, 4))]
    out = []
    for s in seeds:
        for a, b, i, t in ends:
            if a == s:
                out.append((1, s, [i], [s, b], [t]))
                out += [(2, s, [i, j], [s, b, c], [t, u]) for x, c, j, u in ends if x == b and j != i]
    return [(p[3], p[4]) for p in sorted(out)[:limit]]


def test_search(spark):
    for seed in (1, 2):
        nodes, edges = graph(seed)
        asked = {"q1": ["market"], "q2": ["渠道", "nothing"], "q3": ["about mark"], "q4": ["zzz"], "q5": ["user", "size"]}
        questions = spark.createDataFrame([(q, k) for q, ks in asked.items() for k in ks], "question string, keyword string")
        v, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
        for limit in (2, 30):
            got = {}
            paths = graphsearch.search(v, e, questions, limit)
            for x in paths.orderBy("question", "place").collect():
                got.setdefault(x.question, []).append((x.ids, x.types))
                assert [(y.source, y.target, y.type) for y in x.edges] == list(zip(x.ids, x.ids[1:], x.types))
            assert got == {q: p for q, ks in asked.items() if (p := brute_paths(nodes, edges, ks, limit))}


def test_a_hub_brings_few_rows(spark):
    hub = spark.range(200_000).select(F.lit("h").alias("src"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("dst"), F.lit("T").alias("type"), "id")
    nodes = spark.createDataFrame([("h", "A", "the hub", None, None), ("n1", "A", "one leaf", None, None)], NODES)
    asked = spark.createDataFrame([("q", "one leaf")], "question string, keyword string")
    got = [r.ids for r in graphsearch.search(nodes, hub, asked, 4).orderBy("place").collect()]
    assert got == [["n1", "h"], ["n1", "h", "n0"], ["n1", "h", "n2"], ["n1", "h", "n3"]]


def test_subgraph(spark):
    nodes, edges = graph(3)
    v, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    r = random.Random(9)
    members = spark.createDataFrame([(k, "r", f"n{r.randrange(40)}") for k in range(20) for _ in range(3)], "edge_id long, role string, node_id string")
    asked = spark.createDataFrame([("q1", "market"), ("q2", "渠道")], "question string, keyword string")
    paths = graphsearch.search(v, e, asked, 4)
    got = {tuple(x) for x in graphsearch.subgraph(v, paths, members, 3, 2).collect()}
    near = {}
    for x in hypergraph.khop_neighbours(members, v.select(F.col("id").alias("node_id")), 2, 2).collect():
        near.setdefault(x.node_id, []).append(x.neighbour_id)
    labels, want = {n[0]: n[1] for n in nodes}, set()
    held = {}
    for x in paths.orderBy("question", "place").collect():
        held.setdefault(x.question, []).extend(x.ids)
        want |= {(x.question, "edge", y.source, y.target, y.type) for y in x.edges}
        if not any(w[0] == x.question and w[1] == "path" and w[4] == x.path for w in want):
            want.add((x.question, "path", None, str(x.place), x.path))
    for q, ids in held.items():
        new = {(i, n) for i in ids[:3] for n in near.get(i, []) if n not in ids}
        want |= {(q, "edge", i, n, "RELATED_TO") for i, n in new} | {(q, "node", i, None, labels[i]) for i in {*ids, *(n for _, n in new)}}
    assert got == want
