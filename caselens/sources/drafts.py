"""Drafts: one JSON object for each project becomes a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.operators import similarity
from caselens import schemas
from caselens.functions import json as J
from caselens.functions import text as X
from caselens.sources.cases import Cases, explode_cases

# Members of a draft that go into the project's metadata, and the metrics.
PASSED_ON = [
    "customer_profiles", "target_customers", "customer_segments", "primary_customers", "served_segments", "customer_needs", "pain_points", "target_scenarios", "applicable_scenarios", "use_cases", "value_propositions",
    "core_values", "solution_benefits", "benefits", "channels", "primary_channels", "go_to_market_channels", "distribution_channels", "sales_channels", "marketing_channels", "competitor_comparisons", "competitor_analysis",
    "benchmark_comparisons", "competitor_analysis_required", "customer_node_ids", "problem_node_ids", "value_node_ids", "evidence_node_ids", "metric_node_ids", "narrative", "target_customer", "problem_statement", "value_proposition",
]
METRICS = ["TAM", "SAM", "SOM", "CAC", "LTV"]


def read_drafts(drafts: DataFrame) -> Cases:
    """The cases of ``drafts`` (value: JSON text); a draft with the lists of a case keeps them."""
    v = F.col("value")
    get = lambda k: F.nullif(F.get_json_object(v, f"$.{k}"), F.lit(""))
    own = F.coalesce(F.nullif(J.field(v, "metadata"), F.lit("null")), F.lit("{}"))
    given = F.from_json(own, "map<string,string>")
    entries = F.array_compact(F.array(*(F.when(J.has_key(v, k) & ~J.has_key(own, k), F.concat(F.lit(f'"{k}":'), J.field(v, k))) for k in PASSED_ON)))
    inner = F.regexp_replace(F.trim(own), r"(?s)^\{|\}$", "")
    metadata = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(F.trim(inner), F.lit("")), F.nullif(F.array_join(entries, ","), F.lit(""))), F.lit("}"))
    fields = [f.split(" ") for f in schemas.NODE.split(", ")]

    def node(**own: Column) -> Column:
        return F.struct(*(own.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))

    tags = F.coalesce(F.from_json(J.field(v, "tags"), "array<string>"), F.array().cast("array<string>"))
    project = node(id=F.coalesce(get("project_id"), F.lit("project_draft")), node_type=F.lit("Project"), name=F.coalesce(get("project_name"), get("name"), get("title"), F.lit("项目草案")), description=get("description"), stage=get("stage"), team_name=get("team_name"), tags=tags, metadata=metadata)

    def metric(k: str) -> Column:
        value = F.coalesce(*(J.number(F.get_json_object(v, p)) for p in (f"$.metrics.{k}.value", f"$.metrics.{k}", f"$.{k.lower()}", f"$.{k}")))
        return F.when(value.isNotNull(), node(id=F.lit(f"metric_{k.lower()}"), node_type=F.lit("Metric"), name=F.lit(k), metric_key=F.lit(k), value=value, unit=F.get_json_object(v, f"$.metrics.{k}.unit")))

    nodes_type = f"array<struct<{schemas.NODE}>>"
    listed = lambda k, t: F.coalesce(F.from_json(J.field(v, k), t), F.array().cast(t))
    card = lambda n, i: F.coalesce(n["id"], n["card_id"], F.concat(F.lit("knowledge_card_"), (i + 1).cast("string")))
    as_card = lambda n, i: node(**{f: n[f] for f, _ in fields} | {"id": card(n, i), "node_type": F.lit("KnowledgeCard"), "name": F.coalesce(n["name"], card(n, i)), "type": F.coalesce(n["type"], F.lit("行业基准")), "evidence_source": F.coalesce(n["evidence_source"], F.lit("manual_input"))})
    raw = F.transform(listed("nodes", nodes_type), lambda n, i: F.when(n["node_type"] == "KnowledgeCard", as_card(n, i)).otherwise(n))
    nodes = F.concat(F.array(project), F.array_compact(F.array(*map(metric, METRICS))), F.transform(listed("knowledge_cards", nodes_type), as_card), raw)
    whole = J.has_key(v, "case_id") & J.has_key(v, "nodes") & J.has_key(v, "relations") & J.has_key(v, "hyperedges") & J.has_key(v, "title")
    return explode_cases(drafts.where(given.isNotNull()).select(
        F.coalesce(get("case_id"), F.lit("DRAFT")).alias("case_id"), F.coalesce(get("title"), get("name"), F.lit("项目草案诊断")).alias("title"), X.lit_empty(get("description")).alias("description"),
        F.when(whole, listed("nodes", nodes_type)).otherwise(nodes).alias("nodes"), listed("relations", f"array<struct<{schemas.RELATION}>>").alias("relations"), listed("hyperedges", f"array<struct<{schemas.HYPEREDGE}>>").alias("hyperedges"),
    ))


# Roles of hyperedge records, and fallacies by rule or word in this order.
ROLES = {
    "customer": "customer", "market": "customer", "persona": "customer", "segment": "customer", "user": "customer", "value_proposition": "value_proposition", "value": "value_proposition", "technology": "value_proposition",
    "solution": "value_proposition", "mistake": "value_proposition", "channel": "channel", "distribution": "channel", "acquisition": "channel", "go_to_market": "channel", "gtm": "channel", "outcome": "channel",
}
RULE_FALLACIES = {"H1": "商业模式一致性问题", "H4": "市场规模估算错误", "H6": "竞品分析不足", "H8": "财务假设风险"}
WORD_FALLACIES = {"大数": "大数幻觉", "渠道": "渠道错位", "用户": "用户需求误判"}


def edge_type(c: Column) -> Column:
    """F27. One of the two types; what says neither is a risk."""
    low = F.lower(X.lit_empty(c))
    return F.when(low.contains("risk"), "Risk_Pattern_Edge").when(low.contains("value") | low.contains("loop"), "Value_Loop_Edge").otherwise("Risk_Pattern_Edge")


def hyperedge_records(records: DataFrame) -> DataFrame:
    """F27. Normalised records of (edge_id, name, edge_type, rule_triggered,
    logical_evaluation, impact, participants map<string,string> of names)."""
    kind = edge_type(F.col("edge_type"))
    rule = F.trim(X.lit_empty(F.col("rule_triggered")))
    alias = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    named = F.filter(F.transform(F.map_entries("participants"), lambda e: F.struct(alias[F.regexp_replace(F.lower(F.trim(e["key"])), "[- ]", "_")].alias("role"), F.trim(e["value"]).alias("name"))), lambda e: e["role"].isNotNull() & (e["name"] != ""))
    who = lambda r: F.coalesce(F.get(F.filter("__named", lambda e: e["role"] == r), 0)["name"], F.lit("unknown")).alias(r)
    or_ = lambda c, d: F.coalesce(F.nullif(F.trim(X.lit_empty(c)), F.lit("")), F.lit(d) if isinstance(d, str) else d)
    return records.withColumn("__named", F.coalesce(named, F.array().cast("array<struct<role:string,name:string>>"))).select(
        or_(F.col("edge_id"), F.concat(F.lit("he_"), X.slug(or_(F.col("name"), kind)))).alias("hyperedge_id"), kind.alias("edge_type"),
        F.when(F.upper(rule).startswith("H1"), "H1_BusinessModelConsistency").when(rule != "", rule).when(kind == "Risk_Pattern_Edge", "H1_BusinessModelConsistency").otherwise("H9_ValueLoopFit").alias("rule_triggered"),
        who("customer"), who("value_proposition"), who("channel"), or_(F.col("logical_evaluation"), "channel.cannot_reach(customer)").alias("logical_evaluation"), or_(F.col("impact"), "unknown").alias("impact"),
    )


def fallacy(rule: Column, impact: Column, evaluation: Column) -> Column:
    """F28. The first that fits; ``H1`` also fits H10 to H15."""
    out = F.lit("业务逻辑风险")
    text = F.concat_ws(" ", impact, evaluation)
    for word, name in reversed(WORD_FALLACIES.items()):
        out = F.when(text.contains(word), name).otherwise(out)
    for r, name in reversed(RULE_FALLACIES.items()):
        out = F.when(X.lit_empty(rule).contains(r), name).otherwise(out)
    return out


def rule_edges(semantics: DataFrame, participants: DataFrame, rule_ids: list[str]) -> DataFrame:
    """G20, U6. Hyperedges annotated with one of the rules, with their members, each row once."""
    edges = semantics.where(F.col("rule_id").isin(rule_ids)).select("case_id", F.col("node_id").alias("edge_id"), "rule_id").distinct()
    return edges.join(participants.select("case_id", "edge_id", "role", "node_id"), ["case_id", "edge_id"]).dropDuplicates()


def missing_labels(nodes: DataFrame, required: list[str]) -> DataFrame:
    """U8. Labels that no node has."""
    spark = nodes.sparkSession
    return spark.createDataFrame([(r,) for r in required], "label string").exceptAll(nodes.select("label").distinct())


def linked_titles(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """J16. card_id, node_id where one's title contains the other's name, either way; both
    of two characters or more. They meet on the rarest bigram of the shorter one."""
    t = cards.select("card_id", F.lower("title").alias("a"))
    n = nodes.select("node_id", F.lower("name").alias("b"))
    pairs = similarity.contained(*similarity.ordered_bigrams(t.select(F.col("a").alias("s")), n.select(F.col("b").alias("s"))))
    return pairs.join(t, "a").join(n, "b").select("card_id", "node_id").distinct()
