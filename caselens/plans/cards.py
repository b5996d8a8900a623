"""Card-graph, ingestion and case-graph queries: documents are cards, customers are projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens import bindings
from caselens.functions import json as J
from caselens.functions import text as X
from caselens.operators import cards, ingest, retrieval, rules
from caselens.sources import cases


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``related_concepts``: the distinct words of over four letters in the whole text."""
    words = F.split("text", r"[\s,.]+")
    concepts = F.array_distinct(F.filter(words, lambda w: F.length(w) > 4))
    return bindings.spread(bindings.read(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("card_id"), F.concat(F.lit("card"), "doc_id").alias("name"), F.col("source").alias("industry"), F.array("lang", "source").alias("tags"), F.array("lang").alias("labels"),
        concepts.alias("related_concepts"), F.array(F.concat(F.lit("h"), (F.col("doc_id") % 18).cast("string"))).alias("rule_ids"), "text",
    )


def f12_triggered_rules(spark, sf_dir):
    e = bindings.read(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"rule_id": "h'), (F.col("event_id") % 15).cast("string"), F.lit('"}'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('["h1", "h'), F.col("user_id").cast("string"), F.lit('"]'))).when(F.col("event_id") % 4 == 2, F.col("props"))
    return e.select("event_id", F.array_join(J.triggered_rules(raw), ",").alias("rule_ids"))


def f6_json_leaves(spark, sf_dir):
    return bindings.read(spark, sf_dir, "events").select("event_id", F.array_join(J.leaves(F.col("props")), ",").alias("leaves"), J.field(F.col("props"), "k").alias("k"))


def g1_derived_cases(spark, sf_dir):
    docs = bindings.spread(bindings.read(spark, sf_dir, "documents")).select(
        F.concat("source", F.lit("_"), F.lpad(F.hex("doc_id"), 8, "0"), F.lit(".pdf")).alias("source_file"), F.lit("").alias("source_path"),
        F.struct(F.concat(F.lit("p"), "doc_id").alias("project_name"), F.slice(F.split("lang", ""), 1, 2).alias("technical_barriers"), F.array("source", "lang").alias("innovation_points"), F.lit("").alias("core_technology"), F.col("lang").alias("application_scene")).alias("extraction"),
    )
    c = cases.derive(docs)
    count = lambda df, kind: df.groupBy("case_id").agg(F.count("*").alias("n")).select("case_id", F.lit(kind).alias("kind"), "n")
    return count(c.nodes, "nodes").union(count(c.relations, "relations")).union(count(c.hyperedges, "hyperedges")).union(count(c.participants, "participants"))


def g7_card_edges(spark, sf_dir):
    return cards.attach(_cards(spark, sf_dir)).groupBy("type", "dst_label").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("targets"))


def g9_triples(spark, sf_dir):
    return cards.heuristic_triples(_cards(spark, sf_dir)).select("card_id", "place", "predicate", "object")


def g10_triple_edges(spark, sf_dir):
    c = _cards(spark, sf_dir)
    t = rules.checkpointed(cards.heuristic_triples(c))  # read for the alignment and for the edges
    known = bindings.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    return cards.attach_triples(t, c, retrieval.align(t.select(F.col("object").alias("name")), known)).groupBy("type", "src_label").agg(F.count("*").alias("edges"))


def g11_backfill(spark, sf_dir):
    c = _cards(spark, sf_dir)
    parts = cards.backfill(c, cards.attach(c))
    out = None
    for kind, df in sorted(parts.items()):
        one = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")).select("kind", "n")
        out = one if out is None else out.union(one)
    return out


def g24_view_edges(spark, sf_dir):
    li = bindings.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.col("l_returnflag").alias("type"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    nodes = bindings.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.array(F.when(F.col("o_orderstatus") == "O", "Value_Loop_Edge").otherwise("Other")).alias("labels")).union(
        bindings.read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey"), F.array(F.when(F.col("p_size") < 40, "Concept").otherwise("Project"))))
    shown, _ = cards.view_edges(nodes, li, ["Concept", "Project"])
    return shown.groupBy("src_kind", "dst_kind", "type").agg(F.count("*").alias("edges"))


def r4_benchmarks(spark, sf_dir):
    """Each document's sentences with numbers in front, as benchmark records of two test metrics."""
    docs = bindings.spread(bindings.read(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("benchmark cac >= "), F.col("n_chars").cast("string"), F.lit("元; ltv "), (F.col("doc_id") + 3).cast("string"), F.lit("-"), (F.col("doc_id") + 9).cast("string"), F.lit("%\n"), "text").alias("text"))
    return ingest.first_benchmarks(ingest.benchmarks(docs)).select("doc_id", "metric", "comparator", "value", "lower", "upper", "unit")


def r5_channel_fit(spark, sf_dir):
    docs = bindings.spread(bindings.read(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("目标客户: "), "source", F.lit("\n适合"), F.when(F.col("doc_id") % 2 == 0, "直销").otherwise("展会"), F.lit("，不适合微博\n"), "text").alias("text"), F.array("lang").alias("scenarios"))
    return ingest.channel_fit(docs).select("doc_id", "channel", "fit_score", F.array_join("segments", ",").alias("segments"), F.array_join("scenarios", ",").alias("scenarios"), "reason")


def r14_quotes(spark, sf_dir):
    m = bindings.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), "turn", "role", "text")
    d = bindings.spread(bindings.read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("owner"), "text")
    return retrieval.quotes(m, d).select("owner", "place", F.md5("quote").alias("quote_md5"))


def a19_formulas(spark, sf_dir):
    t = bindings.spread(bindings.read(spark, sf_dir, "documents")).select(F.col("doc_id").alias("owner"), F.concat(F.lit("$ltv / cac = "), (F.col("doc_id") % 7).cast("string"), F.lit("$ and $tam > sam$ "), "source").alias("text"))
    return cards.formulas(t, {"LTV": ["ltv"], "CAC": ["cac"], "TAM": ["tam"]}).select("name", F.size("formulas").alias("n"), F.array_join("formulas", " | ").alias("formulas"))


def w7_page_ranges(spark, sf_dir):
    return bindings.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(X.page_ranges(F.collect_set("l_linenumber")).alias("pages"))


def f9_predicates(spark, sf_dir):
    return bindings.read(spark, sf_dir, "part").select("p_partkey", X.predicate(F.when(F.col("p_size") < 20, F.lit(" fix-strategy ")).otherwise(F.col("p_type"))).alias("predicate"), cards.entity(F.when(F.col("p_size") < 10, "Lifetime  Value").otherwise(F.col("p_name"))).alias("entity"))


QUERIES = {f.__name__: f for f in (
    f6_json_leaves, f9_predicates, f12_triggered_rules, g1_derived_cases, g7_card_edges, g9_triples, g10_triple_edges, g11_backfill, g24_view_edges, r4_benchmarks, r5_channel_fit, r14_quotes, a19_formulas, w7_page_ranges,
)}

ORACLE_SQL = {
    "f6_json_leaves": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS leaves, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events",
    "f12_triggered_rules": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'H' || CAST(event_id % 15 AS VARCHAR) WHEN 1 THEN 'H1,H' || CAST(user_id AS VARCHAR) ELSE '' END AS rule_ids FROM events",
    "f9_predicates": "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'FIX_STRATEGY' ELSE 'ASSOCIATED_WITH' END AS predicate, CASE WHEN p_size < 10 THEN '生命周期价值' ELSE trim(p_name) END AS entity FROM part",
    "g1_derived_cases": """WITH d AS (SELECT 'P_' || lpad(printf('%X', doc_id), 8, '0') AS c FROM documents), k AS (SELECT * FROM (VALUES ('nodes', 8), ('relations', 6), ('hyperedges', 2), ('participants', 9)) v(kind, n)) SELECT c AS case_id, kind, CAST(n AS BIGINT) AS n FROM d, k""",
    "g7_card_edges": """WITH c AS (SELECT doc_id, 'card' || doc_id AS name, lang, source, doc_id % 18 AS r, list_filter(regexp_split_to_array(text, '[\\s,.]+'), lambda x: length(x) > 4) AS w FROM documents),
e AS (SELECT name, 'EVALUATED_BY' AS type, 'Rule' AS dst_label, 'H' || CAST(r AS VARCHAR) AS dst FROM c WHERE r BETWEEN 1 AND 15 UNION SELECT name, 'ASSOCIATED_WITH', 'Tag', unnest([lang, source]) FROM c UNION SELECT name, 'ASSOCIATED_WITH', 'Concept', unnest(w) FROM c)
SELECT type, dst_label, count(*) AS edges, count(DISTINCT dst) AS targets FROM e WHERE dst <> '' GROUP BY ALL""",
    "g24_view_edges": """WITH n AS (SELECT 'o' || o_orderkey AS id, 'Hyperedge' AS kind, o_orderstatus = 'O' AS ok FROM orders UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size < 40 THEN 'Concept' ELSE 'Project' END, true FROM part),
e AS (SELECT DISTINCT 'o' || l_orderkey AS src, l_returnflag AS type, 'p' || l_partkey AS dst FROM lineitem) SELECT a.kind AS src_kind, b.kind AS dst_kind, type, count(*) AS edges FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.ok AND b.ok GROUP BY ALL""",
    "r4_benchmarks": """SELECT doc_id, 'CAC' AS metric, '>=' AS comparator, CAST(n_chars AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, '元' AS unit FROM documents
UNION ALL SELECT doc_id, 'LTV', NULL, NULL, CAST(doc_id + 3 AS DOUBLE), CAST(doc_id + 9 AS DOUBLE), '%' FROM documents""",
    "r5_channel_fit": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '直销' ELSE '行业展会' END AS channel, 0.9::DOUBLE AS fit_score, source AS segments, lang AS scenarios, '适合' || CASE WHEN doc_id % 2 = 0 THEN '直销' ELSE '展会' END AS reason FROM documents
UNION ALL SELECT doc_id, '社交媒体', 0.1::DOUBLE, source, lang, '不适合微博' FROM documents""",
    "a19_formulas": """WITH f AS (SELECT 'ltv / cac = ' || CAST(k AS VARCHAR) AS x, k FROM (SELECT DISTINCT doc_id % 7 AS k FROM documents)), g AS (SELECT count(*) AS n, string_agg(x, ' | ' ORDER BY k) AS formulas FROM f)
SELECT name, CAST(n AS INT) AS n, formulas FROM g, (VALUES ('LTV'), ('CAC')) v(name) UNION ALL SELECT 'TAM', 1, 'tam > sam'""",
    "w7_page_ranges": """WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber AS p FROM lineitem), g AS (SELECT l_orderkey, p, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS k FROM n),
r AS (SELECT l_orderkey, min(p) AS a, max(p) AS b FROM g GROUP BY l_orderkey, k) SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY l_orderkey""",
}
