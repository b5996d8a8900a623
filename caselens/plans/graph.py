"""Hypergraph, rule and merge queries over orders, parts and suppliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens import bindings
from caselens.bindings import scratch
from caselens.functions import text as X
from caselens.sources import drafts as sources_drafts
from caselens.operators import casegraph, graphsearch, hypergraph, incidence, retrieval, rules, verify


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.participants(spark, sf_dir)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "Value_Loop_Edge").otherwise("Risk_Pattern_Edge").alias("edge_type"))


def _of_orders(spark: SparkSession, sf_dir: str) -> tuple[int, DataFrame]:
    """The number of participants, and all of them with their orders, in parts of a bounded number."""
    p = _p(spark, sf_dir)
    n = p.count()
    return n, rules.dealt(p, "edge_id", rows=n).join(_orders(spark, sf_dir), "edge_id")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_name", "p_brand", "p_type")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src (order), type (return flag), dst (part), labels of both."""
    li = bindings.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), "l_linenumber")
    o = bindings.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_orderstatus").alias("src_label"))
    p = _parts(spark, sf_dir).select(F.col("node_id").alias("dst"), F.col("p_brand").alias("dst_label"))
    return li.join(o, "src").join(p, "dst")


def a1_edge_ranks(spark, sf_dir):
    return hypergraph.edge_ranks(_p(spark, sf_dir), _orders(spark, sf_dir))


def a2_degrees(spark, sf_dir):
    return hypergraph.degrees(_p(spark, sf_dir))


def a4_label_counts(spark, sf_dir):
    labels = F.array(F.lit("Node"), X.label(F.col("p_type")), X.label(F.col("p_brand")))
    return hypergraph.label_counts(_parts(spark, sf_dir).select(labels.alias("labels")))


def a4_totals(spark, sf_dir):
    """A4: nodes of parts, suppliers and orders, and the lines between them."""
    named = (("part", "p_partkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"))
    nodes = reduce(DataFrame.union, (bindings.read(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in named))
    return hypergraph.totals(nodes, bindings.read(spark, sf_dir, "lineitem"))


def a5_edge_matrix(spark, sf_dir):
    return hypergraph.matrix(_edges(spark, sf_dir))


def a6_connectivity(spark, sf_dir):
    edges = _edges(spark, sf_dir).select(F.concat(F.lit("o"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"), "type")
    nodes = _parts(spark, sf_dir).select(F.concat(F.lit("p"), "node_id").alias("node_id"))
    return hypergraph.connectivity(nodes, edges, "R")


def a7_distinct_nodes(spark, sf_dir):
    return hypergraph.distinct_ends(bindings.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


def a14_overall(spark, sf_dir):
    return rules.overall(rules.metric_rules(_metrics(spark, sf_dir)))


def a18_rank_histogram(spark, sf_dir):
    return hypergraph.rank_histogram(_p(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a case: market sizes from its sales, unit economics from taxes and averages."""
    d = lambda c: F.sum(c).cast("decimal(24,4)")
    price, sold = F.col("l_extendedprice").cast("decimal(18,4)"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return bindings.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("case_id")).agg(
        d(F.when(F.col("l_linenumber") > 1, price)).alias("tam"), d(sold).alias("sam"), d(F.when(F.col("l_returnflag") == "R", sold)).alias("som"), d(F.when(F.col("l_linenumber") == 7, price)).alias("cac"), d(sold).alias("ltv")
    )


def h4_h8_metric_rules(spark, sf_dir):
    return rules.metric_rules(_metrics(spark, sf_dir))


def k1_top_neighbours(spark, sf_dir):
    return hypergraph.nearest(_p(spark, sf_dir), 5).select("node_id", "neighbour_id", "similarity", "place")


def g15_neighbour_counts(spark, sf_dir):
    return hypergraph.neighbour_counts(_p(spark, sf_dir))


def g14_khop(spark, sf_dir):
    seeds = bindings.read(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("bigint").alias("node_id"))  # the requests: each fiftieth part
    return hypergraph.khop_neighbours(_p(spark, sf_dir), seeds)


def g21_incidence_faults(spark, sf_dir):
    return hypergraph.incidence_faults(_p(spark, sf_dir), _parts(spark, sf_dir).select("node_id"), _orders(spark, sf_dir))


def g21_matrix(spark, sf_dir):
    """Orders as columns over the parts of up to size 44, so that the others are unknown."""
    members = _p(spark, sf_dir)
    matrix = incidence.build(members, bindings.read(spark, sf_dir, "part").where("p_size < 45").select(F.col("p_partkey").alias("node_id")))
    return incidence.verify(matrix, members)


def g22_skeleton(spark, sf_dir):
    n, p = _of_orders(spark, sf_dir)
    p = p.select("case_id", "edge_id", "node_id")
    customers = bindings.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") * 7 % 2000).alias("node_id"))
    return hypergraph.skeleton(p, customers, rows=n)


def g23_role_check(spark, sf_dir):
    p = _p(spark, sf_dir).join(_orders(spark, sf_dir), "edge_id")
    expected = spark.createDataFrame([("Value_Loop_Edge", ["N"]), ("Risk_Pattern_Edge", ["A", "R"])], "edge_type string, roles array<string>")
    return hypergraph.role_check(p, expected)


def g18_paths(spark, sf_dir):
    li = bindings.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    seeds = bindings.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return hypergraph.paths(li, seeds, 5).select("seed", "dst", "hops", "types", "place")


def _places(spark, sf_dir):
    """Regions, nations, suppliers and customers as nodes, where each lies as edges, and the
    names of all nations and suppliers as questions."""
    read = lambda t: bindings.read(spark, sf_dir, t)
    node = lambda t, letter, key, name: read(t).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(t).alias("label"), F.col(name).alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("tags_text"))
    edge = lambda t, letter, key, to, far, k, kind: read(t).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("src"), F.concat(F.lit(to), F.col(far).cast("string")).alias("dst"), F.lit(kind).alias("type"), (F.col(key) * 4 + k).cast("long").alias("id"))
    nodes = node("region", "r", "r_regionkey", "r_name").union(node("nation", "n", "n_nationkey", "n_name")).union(node("supplier", "s", "s_suppkey", "s_name")).union(node("customer", "c", "c_custkey", "c_name"))
    edges = edge("supplier", "s", "s_suppkey", "n", "s_nationkey", 0, "SELLS_IN").union(edge("customer", "c", "c_custkey", "n", "c_nationkey", 1, "BUYS_IN")).union(edge("nation", "n", "n_nationkey", "r", "n_regionkey", 2, "PART_OF"))
    asked = nodes.where("label IN ('nation', 'supplier')").select(F.col("id").alias("question"), F.col("name").alias("keyword"))
    return nodes, edges, asked


def g18_search(spark, sf_dir):
    found = graphsearch.search(*_places(spark, sf_dir), 5)
    return found.select("question", "place", "hops", F.array_join("ids", ",").alias("ids"), "path", F.array_join(F.transform("edges", lambda e: F.concat_ws("|", e["source"], e["type"], e["target"])), ",").alias("edges"))


def g19_subgraph(spark, sf_dir):
    """Customers and suppliers of a nation are the members of its hyperedge."""
    nodes, edges, asked = _places(spark, sf_dir)
    members = edges.where("type <> 'PART_OF'").select(F.col("dst").alias("edge_id"), F.col("type").alias("role"), F.col("src").alias("node_id"))
    return graphsearch.subgraph(nodes, graphsearch.search(nodes, edges, asked, 5), members)


def j10_isolated(spark, sf_dir):
    return _parts(spark, sf_dir).select("node_id").join(_p(spark, sf_dir).where("role = 'R'"), "node_id", "left_anti")


def u2_first_wins(spark, sf_dir):
    li = bindings.read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return casegraph.first_wins(li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


def u3_upsert(spark, sf_dir):
    old = bindings.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("old").alias("origin"))
    new = bindings.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3 % 200).alias("k"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("n"), "l_partkey")).alias("name"), F.col("l_linenumber").cast("bigint").alias("nation"), F.lit("new").alias("origin"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return casegraph.upsert(old.withColumn("nation", F.col("nation").cast("bigint")), new, ["k"], "seq", keep=("name",), create_only=("origin",))


def s17_graph_merge(spark, sf_dir):
    """Two batches of nodes and edges merged into one graph: suppliers and small parts, then
    every second part again, which keeps a description and sets a case only where it is new;
    the first lines of orders as edges, then the others."""
    read = lambda t: bindings.read(spark, sf_dir, t)
    text = lambda c: F.col(c).cast("string")
    node = lambda df, label, key, name, description, case: df.select(F.lit(label).alias("node_label"), text(key).alias("id"), F.col(name).alias("name"), description.alias("description"), case.alias("case_id"), F.col(key).cast("long").alias("seq"))
    none, part = F.lit(None).cast("string"), read("part")
    first = node(read("supplier"), "Supplier", "s_suppkey", "s_name", none, text("s_nationkey")).union(node(part.where("p_size < 25"), "Part", "p_partkey", "p_name", F.col("p_brand"), none))
    second = node(part.where("p_partkey % 2 = 0"), "Part", "p_partkey", "p_type", none, F.lit("late"))
    lines = read("lineitem").select(
        F.lit("SUPPLIES").alias("type"), F.lit("Supplier").alias("src_label"), text("l_suppkey").alias("src"), F.lit("Part").alias("dst_label"), text("l_partkey").alias("dst"),
        F.col("l_quantity").cast("double").alias("weight"), "l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"),
    )
    path, keep = scratch(spark, "graph"), {"keep": ("description",), "create_only": ("case_id",)}
    casegraph.merge_graph(spark, path, first, lines.where("l_linenumber = 1"), 1, **keep)
    store = casegraph.merge_graph(spark, path, second, lines.where("l_linenumber > 1"), 2, **keep)
    nodes = store.read("kg_nodes").select(F.lit("node").alias("kind"), "node_label", "id", "name", "description", "case_id", F.lit(None).cast("double").alias("weight"))
    edges = store.read("kg_edges").select(F.lit("edge"), "src", "dst", "type", none, none, "weight")
    return nodes.union(edges)


def u4_entity_names(spark, sf_dir):
    return hypergraph.entity_names(bindings.read(spark, sf_dir, "part").select(F.col("p_brand").alias("name")), bindings.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


def u5_replace_edges(spark, sf_dir):
    changes = bindings.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("edge_id"), F.lit("N").alias("role"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("node_id"))
    return hypergraph.replace_edges(_p(spark, sf_dir), changes).groupBy("edge_id").agg(F.count("*").alias("members"), F.sum("node_id").alias("node_sum"))


def _aligned(spark, sf_dir):
    """Every part's name as it stands, cut short, with a wrong letter or with a word more, against all parts' and nations' names."""
    part = bindings.read(spark, sf_dir, "part").select("p_name", "p_partkey")
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    written = F.when(k == 0, name).when(k == 1, F.substring(name, F.lit(1), F.length(name) - 3)).when(k == 2, F.concat(F.substring(name, 1, 4), F.lit("#"), F.substring(name, F.lit(6), F.length(name)))).otherwise(F.concat(name, F.lit(" kit")))
    nations = bindings.read(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), (-F.col("n_nationkey")).cast("long").alias("pos"))
    return retrieval.align(part.select(written.alias("name")), nations.union(part.select("p_name", F.col("p_partkey").cast("long"))))


def r7_align(spark, sf_dir):
    return _aligned(spark, sf_dir)


def r7_contained(spark, sf_dir):
    """What is equal or contained, which SQL can say, too."""
    return _aligned(spark, sf_dir).where("how IN ('exact', 'contained')")


def j16_linked_titles(spark, sf_dir):
    """Cards titled by the parts' names, nodes named by the words of the brands, types and names."""
    part = bindings.read(spark, sf_dir, "part")
    words = part.select(F.explode(F.array_union(F.split("p_type", " "), F.array(F.split("p_name", " ")[0], F.substring("p_name", 3, 6)))).alias("name")).distinct()
    return sources_drafts.linked_titles(part.select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("title")), words.select(F.col("name").alias("node_id"), "name"))


def v1_v15_checks(spark, sf_dir):
    o, (n, p) = _orders(spark, sf_dir), _of_orders(spark, sf_dir)
    kinds = [(0, "Concept"), (1, "Task"), (2, "Artifact"), (3, "Metric"), (4, "Mistake"), (5, "Evidence"), (6, "Project"), (7, "Method")]
    label = lambda c: F.element_at(F.array(*(F.lit(k) for _, k in kinds)), (c % 8 + 1).cast("int"))
    notes = p.select("case_id", label(F.col("node_id")).alias("node_label"), "node_id", F.concat(F.lit("H"), (F.col("edge_id") % 15 + 1).cast("string")).alias("rule_id"))
    li = bindings.read(spark, sf_dir, "lineitem")
    rel = li.select(F.element_at(F.array(*(F.lit(x) for x in ("PREREQ", "PRODUCES", "MEASURED_BY"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("relation_type"), F.col("l_partkey").alias("source_id"), label(F.col("l_partkey")).alias("source_label"), F.col("l_suppkey").alias("target_id"), label(F.col("l_suppkey")).alias("target_label"))
    metrics = _parts(spark, sf_dir).select("node_id", F.element_at(F.array(*(F.lit(x) for x in ("TAM", "SAM", "SOM", "CAC", "LTV", "x"))), (F.col("node_id") % 6 + 1).cast("int")).alias("key"))
    contains = p.select("case_id", label(F.col("node_id")).alias("node_label"), "node_id")
    return verify.verify(notes, rel, metrics, p.select("edge_id", "edge_type", "node_id"), contains, o, rows=n)


QUERIES = {f.__name__: f for f in (
    a1_edge_ranks, a2_degrees, a4_label_counts, a4_totals, a5_edge_matrix, a6_connectivity, a7_distinct_nodes, a14_overall, a18_rank_histogram, h4_h8_metric_rules, k1_top_neighbours, g14_khop, g15_neighbour_counts, g18_paths, g18_search, g19_subgraph,
    g21_incidence_faults, g21_matrix, g22_skeleton, g23_role_check, j10_isolated, u2_first_wins, u3_upsert, s17_graph_merge, u4_entity_names, u5_replace_edges, r7_align, r7_contained, j16_linked_titles, v1_v15_checks,
)}

_E = "e AS (SELECT o_orderkey AS edge_id, o_custkey AS case_id, CASE WHEN o_orderstatus = 'O' THEN 'Value_Loop_Edge' ELSE 'Risk_Pattern_Edge' END AS edge_type FROM orders)"
_LABEL = lambda c: f"regexp_replace({c}, '[^0-9A-Za-z_]', '', 'g')"
_W = "m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS n FROM lineitem), r AS (SELECT e, CAST(1.0 / count(*) AS DECIMAL(18,6)) AS w FROM m GROUP BY e HAVING count(*) > 1)"
_METRICS = """x AS (SELECT l_suppkey AS case_id, sum(CAST(l_extendedprice AS DECIMAL(18,4))) FILTER (l_linenumber > 1) AS tam, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS sam,
sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) FILTER (l_returnflag = 'R') AS som, sum(CAST(l_extendedprice AS DECIMAL(18,4))) FILTER (l_linenumber = 7) AS cac, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS ltv FROM lineitem GROUP BY 1),
h AS (SELECT case_id, 'H4' AS rule_id, CASE WHEN tam IS NULL OR sam IS NULL OR som IS NULL THEN 'WARNING' WHEN tam >= sam AND sam >= som THEN 'PASSED' ELSE 'FAILED' END AS status FROM x
UNION ALL SELECT case_id, 'H8', CASE WHEN cac IS NULL OR ltv IS NULL OR cac <= 0 THEN 'WARNING' WHEN ltv >= 3 * cac THEN 'PASSED' ELSE 'WARNING' END FROM x)"""
_KIND = lambda c: f"(['Concept','Task','Artifact','Metric','Mistake','Evidence','Project','Method'])[CAST({c} % 8 + 1 AS INT)]"


def _check(n: int, a: str, b: str | None, ok: str) -> str:
    return f"SELECT 'V{n}' AS \"check\", ({ok}) AS ok, CAST({a} AS BIGINT) AS a, CAST({b or '0'} AS BIGINT) AS b"


def _both(n: int, a: str, b: str, more: int = 0) -> str:
    return _check(n, a, b, f"{a} > 0 AND {b} > {more}")


def _notes(rule: str, *labels: str) -> str:
    extra = f" AND node_label IN ({', '.join(repr(x) for x in labels)})" if labels else ""
    return f"(SELECT count(*) FROM (SELECT DISTINCT node_label, node_id FROM notes WHERE rule_id = '{rule}'{extra}))"


_REL = lambda kind, cond: f"(SELECT count(*) FROM rel WHERE relation_type = '{kind}' AND ({cond}))"
_MET = lambda keys: f"(SELECT count(DISTINCT node_id) FROM met WHERE key IN ({keys}))"
_SIZE = lambda op: (f"(SELECT count(*) FROM e WHERE edge_type {op} 'Value_Loop_Edge')", f"(SELECT coalesce(max(size), 0) FROM sizes WHERE edge_type {op} 'Value_Loop_Edge')")
_CHECKS = [
    _both(1, _notes("H1", "Concept"), _notes("H1", "Artifact")), _both(2, _REL("PREREQ", "sl = 'Concept' AND tl = 'Task' OR sl = 'Task' AND tl = 'Concept'"), _notes("H2"), 1),
    _both(3, _REL("PRODUCES", "sl = 'Task' AND tl = 'Artifact'"), _notes("H3"), 1), _check(4, _MET("'TAM','SAM','SOM'"), None, _MET("'TAM','SAM','SOM'") + " = 3"),
    _both(5, _REL("MEASURED_BY", "sl = 'Artifact' AND tl = 'Metric'"), _notes("H5", "Metric")), _check(6, _notes("H6"), None, _notes("H6") + " > 0"), _both(7, "(SELECT count(*) FROM pe WHERE node_label = 'Mistake')", _notes("H7", "Mistake")),
    _check(8, _MET("'CAC','LTV'"), None, _MET("'CAC','LTV'") + " = 2"), _check(9, *_SIZE("="), f"{_SIZE('=')[0]} > 0 AND {_SIZE('=')[1]} >= 3"), _check(10, *_SIZE("<>"), f"{_SIZE('<>')[0]} > 0 AND {_SIZE('<>')[1]} >= 3"),
    *(_check(n, _notes(f"H{n}", *ls), None, _notes(f"H{n}", *ls) + " > 0") for n, ls in ((11, ("Method", "Task")), (12, ("Project",)), (13, ("Evidence",)))), _both(14, _notes("H14", "Project"), _notes("H14", "Artifact", "Evidence", "Metric")),
    _check(15, "(SELECT count(DISTINCT edge_id) FROM e WHERE edge_type <> 'Value_Loop_Edge' AND case_id IN (SELECT case_id FROM pe WHERE node_label IN ('Task','Method','Artifact')))", None,
           "(SELECT count(*) FROM e WHERE edge_type <> 'Value_Loop_Edge' AND case_id IN (SELECT case_id FROM pe WHERE node_label IN ('Task','Method','Artifact'))) > 0"),
]

ORACLE_SQL = {
    "a1_edge_ranks": "WITH r AS (SELECT o_orderkey AS edge_id, count(DISTINCT l_partkey) AS rank FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT edge_id, rank, CAST(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END AS DECIMAL(18,6)) AS inv_rank FROM r",
    "a2_degrees": "SELECT l_partkey AS node_id, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1",
    "a4_label_counts": f"SELECT label, count(*) AS n FROM (SELECT unnest(['Node', {_LABEL('p_type')}, {_LABEL('p_brand')}]) AS label FROM part) GROUP BY label",
    "a4_totals": "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM lineitem) AS relations",
    "a5_edge_matrix": "SELECT l_returnflag AS type, o_orderstatus AS src_label, p_brand AS dst_label, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "a6_connectivity": "WITH k AS (SELECT l_partkey AS n, count(*) AS c, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (c IS NULL) AS isolated, count(*) FILTER (coalesce(r, 0) = 0) AS without FROM part LEFT JOIN k ON n = p_partkey",
    "a7_distinct_nodes": "SELECT count(DISTINCT l_partkey) AS n, count(DISTINCT l_suppkey) AS m, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem)) AS n_or_m FROM lineitem",
    "a14_overall": f"WITH {_METRICS}, c AS (SELECT case_id, {', '.join(f'count(*) FILTER (status = {s!r}) AS {s.lower()}' for s in ('FAILED', 'WARNING', 'PASSED', 'SKIPPED'))} FROM h GROUP BY case_id) SELECT *, CASE WHEN failed > 0 THEN 'FAILED' WHEN warning > 0 THEN 'WARNING' ELSE 'PASSED' END AS overall_status FROM c",
    "a18_rank_histogram": "SELECT rank, count(*) AS edges FROM (SELECT count(DISTINCT l_partkey) AS rank FROM lineitem GROUP BY l_orderkey) GROUP BY rank",
    "h4_h8_metric_rules": f"WITH {_METRICS} SELECT *, status <> 'PASSED' AS is_triggered FROM h",
    "k1_top_neighbours": f"""WITH {_W}, s AS (SELECT a.n AS node_id, b.n AS neighbour_id, sum(w) AS similarity, count(*) AS shared FROM m a JOIN r USING (e) JOIN m b USING (e) WHERE a.n <> b.n GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, shared DESC, neighbour_id) AS p FROM s) SELECT node_id, neighbour_id, CAST(similarity AS DECIMAL(18,6)) AS similarity, CAST(p AS INT) AS place FROM k WHERE p <= 5""",
    "g15_neighbour_counts": "WITH m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS n FROM lineitem), c AS (SELECT a.n, count(DISTINCT b.n) AS k FROM m a JOIN m b USING (e) WHERE a.n <> b.n GROUP BY a.n) SELECT n AS node_id, coalesce(k, 0) AS neighbours FROM (SELECT DISTINCT n FROM m) LEFT JOIN c USING (n)",
    "g18_search": """WITH v AS (SELECT 'r' || r_regionkey AS id, 'region' AS label, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer),
ed AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b, 'SELLS_IN' AS type, s_suppkey * 4 AS id FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'BUYS_IN', c_custkey * 4 + 1 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF', n_nationkey * 4 + 2 FROM nation),
u AS (SELECT a, b, type, id FROM ed UNION ALL SELECT b, a, type, id FROM ed), q AS (SELECT id AS question, lower(name) AS k FROM v WHERE label IN ('nation', 'supplier')), s AS (SELECT question, v.id AS seed FROM q JOIN v ON contains(lower(v.name), k)),
p AS (SELECT question, seed, 1 AS hops, [id] AS via, [a, b] AS ids, [type] AS types FROM s JOIN u ON a = seed UNION ALL SELECT question, seed, 2, [x.id, y.id], [x.a, x.b, y.b], [x.type, y.type] FROM s JOIN u x ON x.a = seed JOIN u y ON y.a = x.b AND y.id <> x.id),
t AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY hops, seed, via, ids) AS place FROM p QUALIFY place <= 5)
SELECT question, CAST(place AS INT) AS place, CAST(hops AS INT) AS hops, array_to_string(ids, ',') AS ids, n1.label || ':' || n1.name || ' -[' || types[1] || ']-> ' || n2.label || ':' || n2.name || coalesce(' -[' || types[2] || ']-> ' || n3.label || ':' || n3.name, '') AS path,
ids[1] || '|' || types[1] || '|' || ids[2] || coalesce(',' || ids[2] || '|' || types[2] || '|' || ids[3], '') AS edges FROM t JOIN v n1 ON n1.id = ids[1] JOIN v n2 ON n2.id = ids[2] LEFT JOIN v n3 ON n3.id = ids[3]""",
    "g18_paths": """WITH ed AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS id FROM lineitem), one AS (SELECT * FROM ed WHERE src IN (SELECT s_suppkey FROM supplier)),
p AS (SELECT src AS seed, dst, 1 AS hops, type AS types, id AS i1, NULL AS i2 FROM one UNION ALL SELECT one.src, ed.dst, 2, one.type || '>' || ed.type, one.id, ed.id FROM one JOIN ed ON ed.src = one.dst WHERE one.id <> ed.id),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, i1, i2 NULLS FIRST) AS r FROM p) SELECT seed, dst, CAST(hops AS INT) AS hops, types, CAST(r AS INT) AS place FROM k WHERE r <= 5""",
    "g21_matrix": """WITH m AS (SELECT DISTINCT l_orderkey AS edge_id, l_partkey FROM lineitem)
SELECT edge_id, count(*) AS listed, count(p_partkey) AS held, count(*) - count(p_partkey) AS missing, CAST(0 AS BIGINT) AS surplus FROM m LEFT JOIN part ON p_partkey = l_partkey AND p_size < 45 GROUP BY edge_id""",
    "g21_incidence_faults": """SELECT 'duplicate_members' AS fault, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag, l_partkey)
UNION ALL SELECT 'empty_ids', count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_partkey IS NULL UNION ALL SELECT 'empty_edges', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'unknown_nodes', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'isolated_nodes', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
    "g22_skeleton": """WITH k AS (SELECT o_custkey AS case_id, o_orderkey, count(DISTINCT l_partkey) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
s AS (SELECT case_id, count(*) AS edges, CAST(round(avg(rank), 4) AS DOUBLE) AS average_rank, CAST(round(avg(CAST(rank >= 3 AS INT)), 4) AS DOUBLE) AS high_share FROM k GROUP BY case_id),
c AS (SELECT c_custkey AS case_id, CAST(NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey AND l_partkey = c_custkey * 7 % 2000) AS BIGINT) AS isolated FROM customer)
SELECT case_id, coalesce(edges, 0) AS edges, coalesce(average_rank, 0.0) AS average_rank, coalesce(high_share, 0.0) AS high_share, isolated, coalesce(edges, 0) = 0 OR (coalesce(average_rank, 0) <= 2 AND coalesce(high_share, 0) < 0.3) AS degenerate FROM c LEFT JOIN s USING (case_id)""",
    "g23_role_check": f"""WITH {_E}, h AS (SELECT edge_id, edge_type, list_sort(list(DISTINCT l_returnflag)) AS have, CASE WHEN edge_type = 'Value_Loop_Edge' THEN ['N'] ELSE ['A', 'R'] END AS roles FROM lineitem JOIN e ON edge_id = l_orderkey GROUP BY ALL)
SELECT edge_id, edge_type, array_to_string(list_filter(roles, lambda x: NOT list_contains(have, x)), ',') AS missing, array_to_string(list_filter(have, lambda x: NOT list_contains(roles, x)), ',') AS unexpected FROM h""",
    "j10_isolated": "SELECT p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "u2_first_wins": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1",
    "r7_contained": """WITH p AS (SELECT p_name, CAST(p_partkey AS BIGINT) AS pos FROM part), w AS (SELECT DISTINCT CASE pos % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, length(p_name) - 3) WHEN 2 THEN substr(p_name, 1, 4) || '#' || substr(p_name, 6) ELSE p_name || ' kit' END AS name FROM p),
k AS (SELECT known, min(pos) AS pos FROM (SELECT lower(n_name) AS known, -n_nationkey AS pos FROM nation UNION ALL SELECT p_name, pos FROM p) GROUP BY known)
SELECT name, name AS aligned, 'exact' AS how FROM w WHERE name IN (SELECT known FROM k)
UNION ALL SELECT name, arg_min(known, pos), 'contained' FROM w JOIN k ON length(name) >= 2 AND length(known) >= 2 AND (contains(name, known) OR contains(known, name)) WHERE name NOT IN (SELECT known FROM k) GROUP BY name""",
    "j16_linked_titles": """WITH n AS (SELECT DISTINCT unnest(list_concat(string_split(p_type, ' '), [string_split(p_name, ' ')[1], substr(p_name, 3, 6)])) AS name FROM part)
SELECT p_partkey AS card_id, name AS node_id FROM part JOIN n ON length(p_name) >= 2 AND length(name) >= 2 AND (contains(lower(p_name), lower(name)) OR contains(lower(name), lower(p_name)))""",
    "s17_graph_merge": """WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS id, p_size < 25 AS a, p_partkey % 2 = 0 AS b FROM part)
SELECT 'node' AS kind, 'Supplier' AS node_label, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, NULL AS description, CAST(s_nationkey AS VARCHAR) AS case_id, NULL AS weight FROM supplier
UNION ALL SELECT 'node', 'Part', id, CASE WHEN b THEN p_type ELSE p_name END, CASE WHEN a THEN p_brand END, CASE WHEN b AND NOT a THEN 'late' END, NULL FROM p WHERE a OR b
UNION ALL SELECT 'edge', CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR), 'SUPPLIES', NULL, NULL, CAST(arg_max(l_quantity, (l_linenumber > 1, l_orderkey, l_linenumber, l_quantity)) AS DOUBLE) FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "u3_upsert": """WITH n AS (SELECT l_suppkey * 3 % 200 AS k, CASE WHEN l_returnflag = 'R' THEN 'n' || l_partkey END AS name, CAST(l_linenumber AS BIGINT) AS nation, row_number() OVER (PARTITION BY l_suppkey * 3 % 200 ORDER BY l_orderkey * 10 + l_linenumber DESC) AS p FROM lineitem),
l AS (SELECT * FROM n WHERE p = 1) SELECT coalesce(l.k, s_suppkey) AS k, coalesce(l.name, s_name) AS name, coalesce(l.nation, s_nationkey) AS nation, CASE WHEN s_suppkey IS NULL THEN 'new' ELSE 'old' END AS origin FROM supplier FULL JOIN l ON l.k = s_suppkey""",
    "u4_entity_names": "SELECT p_brand AS name FROM part UNION SELECT n_name FROM nation",
    "u5_replace_edges": """WITH p AS (SELECT l_orderkey AS edge_id, l_partkey AS node_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0)
SELECT edge_id, count(*) AS members, CAST(sum(node_id) AS BIGINT) AS node_sum FROM p GROUP BY edge_id""",
    "v1_v15_checks": f"""WITH {_E}, pe AS (SELECT e.*, l_partkey AS node_id, {_KIND('l_partkey')} AS node_label FROM lineitem JOIN e ON edge_id = l_orderkey), notes AS (SELECT *, 'H' || CAST(edge_id % 15 + 1 AS VARCHAR) AS rule_id FROM pe),
rel AS (SELECT (['PREREQ','PRODUCES','MEASURED_BY'])[CAST(l_linenumber % 3 + 1 AS INT)] AS relation_type, {_KIND('l_partkey')} AS sl, {_KIND('l_suppkey')} AS tl FROM lineitem),
met AS (SELECT p_partkey AS node_id, (['TAM','SAM','SOM','CAC','LTV','x'])[CAST(p_partkey % 6 + 1 AS INT)] AS key FROM part), sizes AS (SELECT edge_id, any_value(edge_type) AS edge_type, count(DISTINCT node_id) AS size FROM pe GROUP BY edge_id) {' UNION ALL '.join(_CHECKS)}""",
}
