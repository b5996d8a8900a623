"""Queries over rules, cards, drafts and classes that link tables of the domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens import bindings
from caselens.functions import json as J
from caselens.operators import cards, classroom, ingest, retrieval
from caselens.sources import drafts

PROMPT = "notes on Customer#000000042, please"


def _text(c):
    return F.col(c).cast("string")


def g20_rule_edges(spark, sf_dir):
    """Orders as hyperedges that some rule annotates, with their parts by return flag."""
    o = bindings.read(spark, sf_dir, "orders")
    notes = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("node_id"), F.concat(F.lit("H"), (F.col("o_orderkey") % 15).cast("string")).alias("rule_id"))
    members = bindings.participants(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("case_id")), "edge_id")
    return drafts.rule_edges(notes, members, ["H4", "H8"])


def u8_missing_labels(spark, sf_dir):
    return drafts.missing_labels(bindings.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label")), ["F", "O", "P", "X", "Y"])


def f28_fallacies(spark, sf_dir):
    """A fallacy of each event from a rule, an impact and an evaluation."""
    e = bindings.read(spark, sf_dir, "events")
    rule = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("H"), (F.col("event_id") % 17).cast("string")))
    impact = F.when(F.col("value") > 60, "渠道 mix").when(F.col("value") > 40, "大数")
    evaluation = F.when(F.col("event_type") == "view", "用户").otherwise(F.col("event_type"))
    return e.select("event_id", drafts.fallacy(rule, impact, evaluation).alias("fallacy"))


def f27_edge_types(spark, sf_dir):
    """The edge type of each part by what its brand, type and size say."""
    says = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Risk of "), F.col("p_type"))).when(F.col("p_size") % 4 == 1, F.concat(F.col("p_brand"), F.lit(" VALUE"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("loop and risk "), F.col("p_brand"))).otherwise(F.col("p_type"))
    return bindings.read(spark, sf_dir, "part").select("p_partkey", drafts.edge_type(says).alias("edge_type"))


def f16_lenient(spark, sf_dir):
    """The events' JSON as a model might answer it: alone, fenced, inside words, broken."""
    e = bindings.read(spark, sf_dir, "events").where("props IS NOT NULL")
    k, p = F.col("event_id") % 4, F.col("props")
    said = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n``` bye"))).when(k == 2, F.concat(F.lit("It is "), p, F.lit(" as asked"))).otherwise(F.substring(p, F.lit(1), F.length(p) - 1))
    return e.select("event_id", J.lenient(said).alias("json"))


def g8_declared(spark, sf_dir):
    """Parts as cards that declare a relation, a hyperedge of two members and a project."""
    part = bindings.read(spark, sf_dir, "part")
    as_json = lambda c: F.to_json(F.array(c))
    relation = F.struct(F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.when(F.col("p_size") < 20, "FIX_STRATEGY").otherwise("near").alias("type"))
    hyper = F.struct(F.concat(F.lit("he_"), _text("p_size")).alias("name"), F.array("p_brand", "p_type").alias("members"))
    rows = part.select(F.col("p_name").alias("name"), as_json(relation).alias("relations"), as_json(hyper).alias("hyperedges"), F.to_json(F.array(F.concat(F.lit("project "), _text("p_size")))).alias("projects"))
    return cards.declared(rows).select("type", "src_label", "src", "dst_label", "dst")


def g25_channel_risk(spark, sf_dir):
    """Events as projects with customer, channel and text, given or not."""
    e = bindings.read(spark, sf_dir, "events")
    channel = F.when(F.col("event_type") == "click", "TikTok shop").when(F.col("event_type") == "view", "village shop").when(F.col("event_type") == "error", " ")
    rows = e.select("event_id", F.when(F.col("value") > 50, "Farmers").when(F.col("value") > 25, "").when(F.col("value") > 10, "clerks").alias("customer"), channel.alias("channel"), F.when(F.col("user_id") % 2 == 0, "A FARMER on wechat").otherwise("nobody").alias("text"))
    return cards.channel_risk(rows).select("event_id", "mismatch")


def r15_student(spark, sf_dir):
    c = bindings.read(spark, sf_dir, "customer")
    profiles = c.select(F.col("c_custkey").alias("student_key"), F.col("c_name").alias("label"), F.lit("").alias("name"), F.lit(None).cast("string").alias("project"), F.concat(F.lit("P-"), _text("c_custkey"), F.lit("-")).alias("project_id"), F.col("c_custkey").alias("seq"))
    return retrieval.resolve_student(PROMPT, profiles, "7").select("student_key", "label")


def c13_teacher_rubric(spark, sf_dir):
    """Finished orders as primary scores, all orders as legacy ones."""
    o = bindings.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("student"), F.col("o_orderkey").alias("criterion"), F.col("o_totalprice").cast("double").alias("score"), "o_orderstatus")
    return classroom.teacher_rubric(o.where("o_orderstatus = 'F'"), o)


def c14_drilldown(spark, sf_dir):
    e = bindings.read(spark, sf_dir, "events").select(F.col("user_id").alias("student"), "event_type", "event_id", "value")
    state = e.groupBy("student").agg(F.count_distinct("event_type").alias("n_rules"), F.max_by("event_type", "event_id").alias("latest_stage"))
    return classroom.drilldown(state, e.where("event_type = 'purchase'").select("student", F.col("value").alias("score")))


def a15_merged(spark, sf_dir):
    """Turns as chunks of a conversation, each with an extraction of its first letters."""
    turns = bindings.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    cut = lambda at, n: F.substring("text", at, n)
    said = F.struct(
        F.when(F.col("turn") > 0, cut(1, 6)).otherwise("").alias("project_name"), cut(30, 5).alias("core_technology"), F.lit("").alias("application_scene"),
        F.array(cut(1, 1), cut(2, 1)).alias("technical_barriers"), F.array(cut(4, 2)).alias("innovation_points"),
    )
    rows = ingest.merge_chunks(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), said.alias("extraction")))
    return rows.select("doc_id", "project_name", "core_technology", "application_scene", F.array_join("technical_barriers", "|").alias("barriers"), F.array_join("innovation_points", "|").alias("points"))


QUERIES = {f.__name__: f for f in (
    g20_rule_edges, u8_missing_labels, f28_fallacies, f27_edge_types, f16_lenient, g8_declared, g25_channel_risk, r15_student, c13_teacher_rubric, c14_drilldown, a15_merged,
)}

_DISTINCT = lambda l: f"array_to_string(list_filter({l}, lambda x, i: list_position({l}, x) = i), '|')"  # noqa: E731, E741
ORACLE_SQL = {
    "g20_rule_edges": """SELECT DISTINCT o_custkey AS case_id, o_orderkey AS edge_id, 'H' || (o_orderkey % 15) AS rule_id, l_returnflag AS role, l_partkey AS node_id
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 15 IN (4, 8)""",
    "u8_missing_labels": "SELECT label FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) v(label) WHERE label NOT IN (SELECT o_orderstatus FROM orders)",
    "f28_fallacies": """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'H' || (event_id % 17) ELSE '' END AS r, concat_ws(' ', CASE WHEN value > 60 THEN '渠道 mix' WHEN value > 40 THEN '大数' END, CASE WHEN event_type = 'view' THEN '用户' ELSE event_type END) AS t FROM events)
SELECT event_id, CASE WHEN contains(r, 'H1') THEN '商业模式一致性问题' WHEN r = 'H4' THEN '市场规模估算错误' WHEN r = 'H6' THEN '竞品分析不足' WHEN r = 'H8' THEN '财务假设风险'
WHEN contains(t, '大数') THEN '大数幻觉' WHEN contains(t, '渠道') THEN '渠道错位' WHEN contains(t, '用户') THEN '用户需求误判' ELSE '业务逻辑风险' END AS fallacy FROM e""",
    "f27_edge_types": "SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN 'Value_Loop_Edge' ELSE 'Risk_Pattern_Edge' END AS edge_type FROM part",
    "f16_lenient": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN props END AS json FROM events WHERE props IS NOT NULL",
    "g8_declared": """SELECT CASE WHEN p_size < 20 THEN 'FIX_STRATEGY' ELSE 'ASSOCIATED_WITH' END AS type, 'Concept' AS src_label, p_brand AS src, 'Concept' AS dst_label, p_type AS dst FROM part
UNION SELECT 'TRIGGERS', 'KnowledgeCard', p_name, 'Hyperedge', 'he_' || p_size FROM part UNION SELECT 'INVOLVES', 'Hyperedge', 'he_' || p_size, 'Concept', unnest([p_brand, p_type]) FROM part
UNION SELECT 'INVOLVES', 'KnowledgeCard', p_name, 'Project', 'project ' || p_size FROM part""",
    "g25_channel_risk": """WITH e AS (SELECT event_id, CASE WHEN value > 50 THEN 'farmers' WHEN value > 25 THEN NULL WHEN value > 10 THEN 'clerks' END AS cu, CASE event_type WHEN 'click' THEN 'tiktok shop' WHEN 'view' THEN 'village shop' END AS ch, user_id % 2 = 0 AS says FROM events)
SELECT event_id, coalesce(contains(coalesce(cu, CASE WHEN says THEN 'farmer' END), 'farmer') AND contains(coalesce(ch, CASE WHEN says THEN 'social media' END), 'tiktok'), false) AS mismatch FROM e""",
    "r15_student": f"SELECT c_custkey AS student_key, c_name AS label FROM customer ORDER BY CASE WHEN contains('{PROMPT}', c_name) OR contains('{PROMPT}', 'P-' || c_custkey || '-') THEN 0 WHEN c_custkey = 7 THEN 1 ELSE 2 END, c_custkey LIMIT 1",
    "c13_teacher_rubric": """SELECT o_custkey AS student, o_orderkey AS criterion, CAST(o_totalprice AS DOUBLE) AS score FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
    "c14_drilldown": """SELECT user_id AS student, count(DISTINCT event_type) AS n_rules, arg_max(event_type, event_id) AS latest_stage,
CAST(round(CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (event_type = 'purchase') / count(value) FILTER (event_type = 'purchase') AS DECIMAL(22,10)), 2) AS DOUBLE) AS mean_score FROM events GROUP BY user_id""",
    "a15_merged": f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
g AS (SELECT conv_id AS doc_id, arg_min(substr(t, 1, 6), turn) FILTER (turn > 0 AND substr(t, 1, 6) <> '') AS project_name, arg_min(substr(t, 30, 5), turn) FILTER (substr(t, 30, 5) <> '') AS core_technology,
flatten(list([substr(t, 1, 1), substr(t, 2, 1)] ORDER BY turn)) AS b, list(substr(t, 4, 2) ORDER BY turn) AS p FROM c GROUP BY conv_id)
SELECT doc_id, project_name, core_technology, CAST(NULL AS VARCHAR) AS application_scene, {_DISTINCT('b')} AS barriers, {_DISTINCT('p')} AS points FROM g""",
}
