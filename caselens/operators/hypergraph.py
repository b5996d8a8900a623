"""Hypergraph operators over an incidence table (edge_id, role, node_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import norm, quoted
from caselens.operators.rules import PART_ROWS, checkpointed, dealt

#: Similarities are decimals, so that sums agree whatever the order of addition.
WEIGHT = "decimal(18,6)"
#: Members of an edge that are joined together.
BLOCK = 256
#: Slices that the neighbours of a node are dealt to.
SLICES = 4
#: Seeds of a part of the k-hop search.
SEEDS = 64


def edge_ranks(participants: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """edge_id, rank, inv_rank: distinct members of each edge; 0 for an edge of
    ``edges`` without members."""
    ranks = participants.groupBy("edge_id").agg(F.count_distinct("node_id").alias("rank"))
    if edges is not None:
        ranks = edges.select("edge_id").distinct().join(ranks, "edge_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    return ranks.withColumn("inv_rank", F.when(F.col("rank") > 0, (1 / F.col("rank"))).otherwise(0.0).cast(WEIGHT))


def weighted_incidence(participants: DataFrame, beta: float = 1.0, max_edge_rank: int | None = None) -> DataFrame:
    """edge_id, node_id, rank, weight over distinct memberships in edges of more than
    one member, and of at most ``max_edge_rank`` if that is given."""
    members = participants.select("edge_id", "node_id").distinct()
    ranks = members.groupBy("edge_id").agg(F.count("*").alias("rank")).where("rank > 1")
    if max_edge_rank is not None:
        ranks = ranks.where(F.col("rank") <= max_edge_rank)
    return members.join(ranks.select("edge_id", "rank", _weight(beta).alias("weight")), "edge_id")


def _weight(beta: float) -> Column:
    """The weight of an edge by its rank."""
    return (1 / F.pow(F.col("rank").cast("double"), F.lit(beta))).cast(WEIGHT)


def member_pairs(members: DataFrame, size: int = BLOCK) -> DataFrame:
    """edge_id, a, b: every two members of an edge, from both sides, with the other columns
    of ``members`` (edge_id, node_id, rank; distinct memberships) of a's row.

    An edge of up to ``size`` members is joined with itself. Those of a larger one, a hub
    of rank r, fall into about r / ``size`` blocks by hash, and each pair of blocks is a
    join key of its own: the pairs of a hub are made by as many tasks as there are, and no
    task holds more than some pairs of blocks.
    """
    more = [c for c in members.columns if c not in ("edge_id", "node_id", "rank")]

    def sides(rows: DataFrame, left: tuple = (), right: tuple = ()) -> DataFrame:
        one = rows.select("edge_id", F.col("node_id").alias("a"), *more, *left)
        other = rows.select("edge_id", F.col("node_id").alias("b"), *right)
        return one.join(other, ["edge_id", "__i", "__j"] if left else "edge_id").where("a <> b").select("edge_id", "a", "b", *more)

    k = F.ceil(F.col("rank") / size).cast("int")
    hubs = members.where(F.col("rank") > size).withColumn("__k", k).withColumn("__b", F.pmod(F.xxhash64("node_id"), F.col("__k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__k") - 1))
    own = F.col("__b")
    return sides(members.where(F.col("rank") <= size)).union(sides(hubs, (own.alias("__i"), every.alias("__j")), (every.alias("__i"), own.alias("__j"))))


def seed_pairs(seeds: DataFrame, members: DataFrame, size: int = BLOCK) -> DataFrame:
    """edge_id, a, b: every member b of an edge beside each of its members a in ``seeds``
    (like ``members``), which go to all blocks of the edge."""
    k = F.ceil(F.col("rank") / size).cast("int")
    more = [c for c in members.columns if c not in ("edge_id", "node_id", "rank")]
    left = seeds.select("edge_id", F.col("node_id").alias("a"), *more, F.explode(F.sequence(F.lit(0), k - 1)).alias("__j"))
    right = members.select("edge_id", F.col("node_id").alias("b"), F.pmod(F.xxhash64("node_id"), k).cast("int").alias("__j"))
    return left.join(right, ["edge_id", "__j"]).where("a <> b").select("edge_id", "a", "b", *more)


def weighted_neighbours(participants: DataFrame, seeds: DataFrame | None = None, beta: float = 1.0, max_edge_rank: int | None = None) -> DataFrame:
    """node_id, neighbour_id, similarity, shared: for every pair of nodes with a
    common edge, each edge once; only for the nodes of ``seeds`` (node_id) if given."""
    if seeds is None:
        return _weighted_pairs(participants, beta, max_edge_rank)[0].drop("slice")
    inc = weighted_incidence(participants, beta, max_edge_rank)
    pairs = seed_pairs(inc.join(seeds.select("node_id").distinct(), "node_id", "left_semi").select(*inc.columns), inc)
    pairs = pairs.withColumnsRenamed({"a": "node_id", "b": "neighbour_id"})
    return pairs.groupBy("node_id", "neighbour_id").agg(F.sum("weight").cast(WEIGHT).alias("similarity"), F.count("*").alias("shared"))


def _weighted_pairs(participants: DataFrame, beta: float = 1.0, max_edge_rank: int | None = None) -> tuple[DataFrame, int]:
    """node_id, slice, neighbour_id, similarity, shared of every pair, in parts of a bounded number of pairs by node
    and ``slice`` (a node's neighbours lie in SLICES of them), and at most how many pairs there are."""
    rows = participants.count()
    members = dealt(participants.select("edge_id", "node_id"), "edge_id", rows=rows)
    inc = checkpointed(weighted_incidence(members, beta, max_edge_rank))
    n = inc.agg(F.sum(F.col("rank") - 1)).first()[0] or 0
    pairs = member_pairs(dealt(inc, "edge_id", rows=rows)).select(F.col("a").alias("node_id"), F.pmod(F.xxhash64("b"), F.lit(SLICES)).alias("slice"), F.col("b").alias("neighbour_id"), "weight")
    # hardly any pairs are equal before all of a node meet, so none are added up before
    sums = dealt(pairs, "node_id", "slice", rows=n).groupBy("node_id", "slice", "neighbour_id")
    return sums.agg(F.sum("weight").cast(WEIGHT).alias("similarity"), F.count("*").alias("shared")), n


def top_neighbours(pairs: DataFrame, k: int = 10) -> DataFrame:
    """K1. The ``k`` most similar neighbours of every node; ties by shared edges, then id."""
    return _first(pairs, k, "node_id")


def nearest(participants: DataFrame, k: int = 10) -> DataFrame:
    """K1. As ``top_neighbours`` of all ``weighted_neighbours``: the first ones are taken from the slices of a node before those meet."""
    pairs, n = _weighted_pairs(participants)
    best = _first(pairs, k, "node_id", "slice").drop("slice", "place")
    return _first(dealt(best, "node_id", rows=n), k, "node_id")


def _first(pairs: DataFrame, k: int, *keys: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("similarity"), F.desc("shared"), "neighbour_id")
    return pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def degrees(participants: DataFrame) -> DataFrame:
    """A2. node_id, degree: distinct edges of each node."""
    return participants.groupBy("node_id").agg(F.count_distinct("edge_id").alias("degree"))


def neighbour_counts(participants: DataFrame) -> DataFrame:
    """G15. node_id, neighbours: distinct other nodes that share an edge."""
    m = participants.select("edge_id", "node_id").distinct()
    ranked = m.join(m.groupBy("edge_id").agg(F.count("*").alias("rank")).where("rank > 1"), "edge_id")
    counted = member_pairs(ranked).select(F.col("a").alias("node_id"), "b").distinct().groupBy("node_id").agg(F.count("*").alias("neighbours"))
    return m.select("node_id").distinct().join(counted, "node_id", "left").select("node_id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def khop_neighbours(
    participants: DataFrame, seeds: DataFrame, k_hop: int = 2, top_k: int = 20, beta: float = 1.0, decay: float = 0.85, max_edge_rank: int | None = None, frontier_width: int = 200, hop_top_n: int = 2000
) -> DataFrame:
    """G14, G19, K2. node_id (a seed), neighbour_id, similarity, place: all seeds at once.

    Each hop joins the frontier of every seed with the incidence, weights by edge
    rank, truncates and decays. A pair that meets in several roles of an edge counts
    as often, visited nodes may return and the seed itself may not. Hops are
    written to shared storage, so the plan does not grow with them.

    The rows of an edge of up to ``BLOCK`` of them go as one list to the seed. In a larger
    edge, a hub, the frontier of a seed is added up before its members are joined, and each
    member of the frontier gets its own part taken off again. Nodes of one membership
    in all are alike in their hub, so beyond the first ``hop_top_n`` + ``frontier_width`` by id
    none can be kept (``_far``), and seeds among those have the same neighbours: one stands for all.

    The memberships are shuffled once for all lists, and a task has a bounded number of them or of
    seeds, whatever the size of the table.
    """
    rows = participants.select("edge_id", "node_id").where("edge_id IS NOT NULL")
    n_rows = rows.count()
    # of a hub only so many rows as show that it is one
    nth = F.row_number().over(Window.partitionBy("edge_id").orderBy("node_id"))
    some = dealt(rows, "edge_id", rows=n_rows).withColumn("n", nth).where(F.col("n") <= BLOCK + 1)
    # a null member counts as one, but is nobody's neighbour
    some = some.groupBy("edge_id").agg(F.collect_list("node_id").alias("members"), F.max("n").alias("n"), F.bool_or(F.col("node_id").isNull()).cast("int").alias("none"))
    some = some.withColumn("rank", F.size(F.array_distinct("members")) + F.col("none")).where((F.col("rank") > 1) | (F.col("n") > BLOCK))
    lists = checkpointed(some.select("edge_id", _weight(beta).cast("double").alias("weight"), "members", "rank", "n"))
    large = lists.where(F.col("n") > BLOCK).select("edge_id")
    near = None if large.isEmpty() else participants.join(large, "edge_id", "left_semi")
    small = (F.col("n") <= BLOCK) & (F.col("rank") > 1) & (F.lit(True) if max_edge_rank is None else F.col("rank") <= max_edge_rank)
    lists = lists.where(small).select("edge_id", "weight", "members")
    around = lists.select(F.explode("members").alias("at"), "weight", "members")
    asked = seeds.select("node_id").distinct().withColumn("stand", F.col("node_id"))
    if near is not None:
        weights = weighted_incidence(near, beta, max_edge_rank).select("edge_id", F.col("weight").cast("double").alias("weight")).distinct()
        hubs = checkpointed(near.join(weights, "edge_id").where("node_id IS NOT NULL").groupBy("edge_id", "node_id").agg(F.first("weight").alias("weight"), F.count("*").alias("times")))
        far = checkpointed(_far(hubs, lists, hop_top_n + max(frontier_width, 1)))
        near = checkpointed(hubs.join(far.select("node_id"), "node_id", "left_anti"))
        placed = asked.select("node_id").join(far, "node_id", "left")
        least = placed.where("edge_id IS NOT NULL").groupBy("edge_id").agg(F.min("node_id").alias("least"))
        asked = placed.join(least, "edge_id", "left").select("node_id", F.coalesce("least", "node_id").alias("stand"))
    asked = checkpointed(asked)
    n_seeds = asked.select("stand").distinct().count()
    parts = max(-(-n_seeds // SEEDS), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frontier = asked.select(F.col("stand").alias("node_id")).distinct().select("node_id", F.col("node_id").alias("at"), F.lit(1).cast("double").alias("score"))
    found = None
    by = Window.partitionBy("node_id").orderBy(F.desc("hop_score"), "next")
    for hop in range(1, k_hop + 1):
        if hop == 2 or (hop == 1 and n_seeds > PART_ROWS):  # few seeds are sent to the lists
            around = dealt(around, "at", rows=n_rows)
        # one shuffle by seed for sums and places
        listed = frontier.join(around, "at").select("node_id", "at", (F.col("score") * F.col("weight")).alias("part"), "members").repartition(parts, "node_id")
        step = listed.select("node_id", "at", "part", F.explode("members").alias("next")).where("at <> next").select("node_id", "next", "part")
        if near is not None:
            met = frontier.join(hubs.select("edge_id", F.col("node_id").alias("at"), "weight", "times"), "at").select("node_id", "at", "edge_id", (F.col("score") * F.col("weight") * F.col("times")).alias("part"))
            whole = met.groupBy("node_id", "edge_id").agg(F.sum("part").alias("part")).join(near.select("edge_id", F.col("node_id").alias("next"), "times"), "edge_id")
            own = met.join(near.select("edge_id", F.col("node_id").alias("at"), "times"), ["edge_id", "at"]).select("node_id", F.col("at").alias("next"), (-F.col("part") * F.col("times")).alias("part"))
            step = step.union(whole.select("node_id", "next", (F.col("part") * F.col("times")).alias("part"))).union(own).repartition(parts, "node_id")
        scored = step.groupBy("node_id", "next").agg(F.round(F.sum("part"), 9).alias("hop_score"))
        scored = scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= hop_top_n).where("next <> node_id AND hop_score > 0")
        if hop < k_hop:
            scored = checkpointed(scored.withColumn("place", F.row_number().over(by)))
            frontier = scored.where(F.col("place") <= frontier_width).select("node_id", F.col("next").alias("at"), F.col("hop_score").alias("score"))
        part = scored.select("node_id", F.col("next").alias("neighbour_id"), (F.col("hop_score") * decay ** (hop - 1)).alias("score"))
        found = part if found is None else found.union(part)
    total = found.repartition(parts, "node_id").groupBy("node_id", "neighbour_id").agg(F.round(F.sum("score"), 6).alias("similarity"))
    ranked = Window.partitionBy("node_id").orderBy(F.desc("similarity"), "neighbour_id")
    best = total.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= top_k)
    if near is None:
        return best
    return asked.join(best.withColumnRenamed("node_id", "stand"), "stand").select("node_id", "neighbour_id", "similarity", "place")


def _far(hubs: DataFrame, lists: DataFrame, first: int) -> DataFrame:
    """node_id, edge_id: the nodes of one membership in all that come after the ``first`` such nodes of their hub.

    The first ones are taken from slices by hash before those of an edge meet.
    """
    once = hubs.groupBy("node_id").agg(F.sum("times").alias("n"), F.min("edge_id").alias("edge_id")).where("n = 1")
    once = checkpointed(once.join(lists.select(F.explode("members").alias("node_id")), "node_id", "left_anti").select("edge_id", "node_id"))
    slices = once.withColumn("slice", F.pmod(F.xxhash64("node_id"), F.lit(64)))
    for keys in (["edge_id", "slice"], ["edge_id"]):
        slices = slices.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("node_id"))).where(F.col("n") <= first)
    last = slices.where(F.col("n") == first).select("edge_id", F.col("node_id").alias("last"))
    return once.join(last, "edge_id").where("node_id > last").select("node_id", "edge_id")


def risk_patterns(nodes: DataFrame, participants: DataFrame, edges: DataFrame, contains: DataFrame, keywords: list[str], limit: int = 5) -> DataFrame:
    """G16, J6, A20. edge_id, case_id, matched, members, strategies of the risk
    edges with a node whose name, description or tags contain a keyword.

    nodes: node_id, node_type, name, text; edges: edge_id, case_id; contains: case_id, node_id.
    """
    words = [w.lower().strip() for w in keywords if w.strip()]
    if not words:
        return edges.select("edge_id", "case_id", *(F.lit(None).cast("array<string>").alias(c) for c in ("matched", "members", "strategies"))).where("false")
    kinds = ["Concept", "Metric", "Mistake", "Artifact", "Project", "Task", "Method"]
    hit = nodes.where(F.col("node_type").isin(kinds) & F.lower("text").rlike(quoted(words))).select("node_id", "name")
    sets = lambda c: F.array_sort(F.collect_set(c))
    matched = participants.join(hit, "node_id").groupBy("edge_id").agg(sets("name").alias("matched"))
    found = edges.join(matched, "edge_id").orderBy("edge_id", "case_id").limit(limit)
    named = nodes.select("node_id", "name", "node_type")
    members = participants.join(found.select("edge_id"), "edge_id", "left_semi").join(named, "node_id").groupBy("edge_id").agg(sets(F.concat_ws(":", "role", "name")).alias("members"))
    fixes = contains.join(found.select("case_id").distinct(), "case_id", "left_semi").join(named.where(F.col("node_type").isin("Task", "Method", "Artifact")), "node_id").groupBy("case_id").agg(F.slice(sets("name"), 1, 5).alias("strategies"))
    return found.join(members, "edge_id", "left").join(fixes, "case_id", "left").select("edge_id", "case_id", "matched", "members", "strategies")


def skeleton(participants: DataFrame, nodes: DataFrame, min_average: float = 2.0, min_share: float = 0.3, high_rank: int = 3, rows: int | None = None) -> DataFrame:
    """A18, G22. case_id, edges, average_rank, high_share, isolated, degenerate of
    each case; participants and nodes have case_id. ``rows``: of participants, counted if not given."""
    ranks = participants.groupBy("case_id", "edge_id").agg(F.count_distinct("node_id").alias("rank"))
    d = lambda c: c.cast("decimal(18,6)")
    stats = ranks.groupBy("case_id").agg(F.count("*").alias("edges"), F.round(F.avg(d(F.col("rank"))), 4).alias("average_rank"), F.round(F.avg(d((F.col("rank") >= high_rank).cast("int"))), 4).alias("high_share"))
    held = dealt(participants.select("case_id", "node_id"), "case_id", "node_id", rows=rows)
    lonely = nodes.join(held, ["case_id", "node_id"], "left_anti").groupBy("case_id").agg(F.count("*").alias("isolated"))
    joined = nodes.select("case_id").distinct().join(stats, "case_id", "left").join(lonely, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = joined.select("case_id", zero("edges").alias("edges"), zero("average_rank").cast("double").alias("average_rank"), zero("high_share").cast("double").alias("high_share"), zero("isolated").alias("isolated"))
    return out.withColumn("degenerate", (F.col("edges") == 0) | ((F.col("average_rank") <= min_average) & (F.col("high_share") < min_share)))


def rank_histogram(participants: DataFrame) -> DataFrame:
    """A18. rank, edges."""
    return edge_ranks(participants).groupBy("rank").agg(F.count("*").alias("edges"))


def incidence_faults(participants: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G21, U7, J10. fault, n: repeated rows, empty ids, edges without members,
    members that are no node, nodes without an edge."""
    p = participants
    key = p.groupBy("edge_id", "role", "node_id").agg(F.count("*").alias("n"))
    one = lambda name, df, n=None: df.agg(F.lit(name).alias("fault"), (F.count("*") if n is None else F.coalesce(F.sum(n), F.lit(0))).alias("n")).select("fault", "n")
    parts = [
        one("duplicate_members", key.where("n > 1"), F.col("n") - 1),
        one("empty_ids", p.where("edge_id IS NULL OR node_id IS NULL")),
        one("empty_edges", edges.select("edge_id").distinct().join(p, "edge_id", "left_anti")),
        one("unknown_nodes", p.select("node_id").where("node_id IS NOT NULL").distinct().join(nodes, "node_id", "left_anti")),
        one("isolated_nodes", nodes.select("node_id").distinct().join(p, "node_id", "left_anti")),
    ]
    return reduce(DataFrame.union, parts)


def replace_edges(participants: DataFrame, changes: DataFrame) -> DataFrame:
    """U5. ``changes`` (edge_id, role, node_id) replace all members of their edges;
    a row with a null node removes its edge."""
    kept = participants.join(changes.select("edge_id").distinct(), "edge_id", "left_anti")
    return kept.select("edge_id", "role", "node_id").union(changes.where("node_id IS NOT NULL").select("edge_id", "role", "node_id").distinct())


def role_check(participants: DataFrame, expected: DataFrame) -> DataFrame:
    """G23. edge_id, missing, unexpected roles against expected (edge_type, roles)."""
    have = participants.groupBy("edge_id", "edge_type").agg(F.array_sort(F.collect_set("role")).alias("have"))
    e = have.join(expected, "edge_type", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    return e.select("edge_id", "edge_type", F.array_join(F.array_sort(F.array_except("roles", "have")), ",").alias("missing"), F.array_join(F.array_sort(F.array_except("have", "roles")), ",").alias("unexpected"))


def topic_check(text: Column, topics: dict[str, list[str]], required: list[str], forbidden: list[str]) -> tuple[Column, Column, Column]:
    """G23. (missing required topics, forbidden ones found, share of required found) of a text."""
    found = F.array_compact(F.array(*(F.when(F.lower(text).rlike(quoted(w)), F.lit(t)) for t, w in topics.items())))
    need, bad = F.array(*map(F.lit, required)), F.array(*map(F.lit, forbidden))
    return F.array_except(need, found), F.array_intersect(found, bad), F.size(F.array_intersect(found, need)) / F.lit(max(1, len(required)))


def paths(edges: DataFrame, seeds: DataFrame, limit: int = 5) -> DataFrame:
    """G18. seed, src, dst, hops, types: the one- and two-step paths from each
    seed (node), over edges (src, type, dst, id) in their direction, no edge twice;
    at most ``limit`` of each seed, by length, then ids."""
    one = edges.join(seeds.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("seed"), "src", "dst", "type", "id")
    short = one.select("seed", F.col("dst"), F.lit(1).alias("hops"), F.col("type").alias("types"), F.array("id").alias("ids"))
    e2 = edges.select(F.col("src").alias("dst"), F.col("dst").alias("dst2"), F.col("type").alias("type2"), F.col("id").alias("id2"))
    long = one.join(e2, "dst").where("id <> id2").select("seed", F.col("dst2").alias("dst"), F.lit(2).alias("hops"), F.concat_ws(">", "type", "type2").alias("types"), F.array("id", "id2").alias("ids"))
    by = Window.partitionBy("seed").orderBy("hops", "ids")
    return short.union(long).withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def matrix(edges: DataFrame) -> DataFrame:
    """A5. type, src_label, dst_label, n."""
    return edges.groupBy("type", "src_label", "dst_label").agg(F.count("*").alias("n"))


def label_counts(nodes: DataFrame) -> DataFrame:
    """A4. label, n: how many nodes (labels, an array) have each label."""
    return nodes.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A4. nodes, relations: one row of the two counts."""
    both = nodes.select(F.lit(1).alias("node"), F.lit(0).alias("edge")).union(edges.select(F.lit(0), F.lit(1)))
    return both.agg(F.count_if(F.col("node") == 1).alias("nodes"), F.count_if(F.col("edge") == 1).alias("relations"))


def distinct_ends(edges: DataFrame) -> DataFrame:
    """A7. n, m, n_or_m: distinct nodes at the first, the second and either end of ``edges`` (a, b).

    The ends become distinct (node, side) flags first, so one shuffle of distinct nodes serves all three.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("side")).union(edges.select("b", F.lit(2))).where("node IS NOT NULL")
    sides = ends.groupBy("node").agg(F.bit_or("side").alias("sides"))
    return sides.agg(F.count_if(F.col("sides").bitwiseAND(1) > 0).alias("n"), F.count_if(F.col("sides").bitwiseAND(2) > 0).alias("m"), F.count("*").alias("n_or_m"))


def entity_names(*tables: DataFrame) -> DataFrame:
    """U4. name: the distinct names of all ``tables`` (name), without blank ones."""
    every = reduce(DataFrame.union, (t.select(F.trim("name").alias("name")) for t in tables))
    return every.where("name <> ''").distinct()


def connectivity(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """A6. total nodes, isolated ones and those without an edge of type ``kind``."""
    ends = edges.select("src", "type").union(edges.select("dst", "type")).toDF("node_id", "type")
    per = ends.groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == kind).alias("k"))
    joined = nodes.select("node_id").distinct().join(per, "node_id", "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("n").isNull()).alias("isolated"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("without"))


# Words of each topic; words that tell what an edge is about, with the topics that it should and should not have.
EDGE_TOPICS = {
    "financing": ["融资", "投资", "估值", "股权", "财务", "现金流", "funding", "investment", "valuation", "equity", "finance", "investor"],
    "hardware": ["硬件", "硬件调试", "电路", "传感器", "焊接", "固件", "pcb", "firmware", "debug"],
    "marketing": ["营销", "渠道", "获客", "转化", "广告", "media", "marketing", "acquisition", "channel"],
    "product": ["产品", "需求", "用户", "痛点", "价值主张", "pmf", "product", "user", "persona", "value proposition"],
}
EDGE_INTENTS = {
    "financing_edge": (["融资", "funding", "investment", "equity", "估值"], ["financing"], ["hardware"]),
    "hardware_edge": (["硬件", "调试", "firmware", "pcb"], ["hardware"], ["financing"]),
}


def semantic_check(
    edges: DataFrame, members: DataFrame, nodes: DataFrame,
    topics: dict[str, list[str]] = EDGE_TOPICS, intents: dict[str, tuple[list[str], list[str], list[str]]] = EDGE_INTENTS,
) -> DataFrame:
    """G23. edge_id, intent, coverage, missing, forbidden: a row for each intent that the text of an
    edge (edge_id, text) tells, against the topics of its members (edge_id, node_id).

    Topics of a node (node_id, text) are found once, whatever the number of its edges, and the
    members' flags are combined before anything else; texts are not joined, so a phrase never spans
    two members. An edge without members has no topic; without required topics coverage is 1.
    """
    flags = nodes.select("node_id", *(norm(F.col("text")).rlike(quoted(w)).alias(f"t_{t}") for t, w in topics.items()))
    held = members.select("edge_id", "node_id").distinct().join(flags, "node_id").groupBy("edge_id").agg(*(F.bool_or(f"t_{t}").alias(f"t_{t}") for t in topics))
    told = lambda name, need, bad: F.struct(F.lit(name).alias("intent"), F.array(*map(F.lit, need)).cast("array<string>").alias("need"), F.array(*map(F.lit, bad)).cast("array<string>").alias("bad"))
    text = norm(F.col("text"))
    asked = edges.select("edge_id", F.inline(F.array_compact(F.array(*(F.when(text.rlike(quoted(w)), told(name, need, bad)) for name, (w, need, bad) in intents.items())))))
    found = F.array_compact(F.array(*(F.when(F.col(f"t_{t}"), F.lit(t)) for t in topics)))
    rows = asked.join(held, "edge_id", "left").withColumn("found", found)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    share = F.size(F.array_intersect("need", "found")) / F.size("need")
    return rows.select(
        "edge_id", "intent", F.when(F.size("need") == 0, 1.0).otherwise(share).alias("coverage"),
        joined(F.array_except("need", "found")).alias("missing"), joined(F.array_intersect("found", "bad")).alias("forbidden"),
    )
