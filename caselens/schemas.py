"""Tables of a case, and the checks that split rows into accepted and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = (
    "id string, node_type string, name string, description string, tags array<string>, metadata string, aliases array<string>, steps array<string>, "
    "expected_output string, artifact_type string, metric_key string, value double, unit string, symptom string, source string, confidence double, "
    "card_id string, type string, labels array<string>, applicable_scenarios array<string>, industry string, evidence_source string, "
    "industry_benchmarks string, stage string, team_name string"
)
RELATION = "id string, source_id string, target_id string, relation_type string, description string, weight double, evidence_ids array<string>, metadata string"
HYPEREDGE = (
    "id string, edge_type string, name string, description string, participants map<string,string>, fit_score double, risk_score double, "
    "rule_triggered string, logical_evaluation string, impact string, metadata string"
)
CASE = f"case_id string, title string, description string, nodes array<struct<{NODE}>>, relations array<struct<{RELATION}>>, hyperedges array<struct<{HYPEREDGE}>>"
NODES, RELATIONS, HYPEREDGES = (f"case_id string, pos int, {x}" for x in (NODE, RELATION, HYPEREDGE))

# Domains of types and roles.
NODE_TYPES = ["Concept", "Method", "Task", "Artifact", "Metric", "Mistake", "Evidence", "KnowledgeCard", "Project"]
RELATION_TYPES = ["PREREQ", "PRODUCES", "MEASURED_BY", "COMMON_MISTAKE", "EVIDENCED_BY"]
EDGE_ROLES = {
    "Value_Loop_Edge": [["market", "technology", "project"], ["customer", "value", "channel"], ["customer", "value_proposition", "channel"]],
    "Risk_Pattern_Edge": [["project", "mistake", "outcome"]],
}


def _between(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(low, high)


def _errors(checks: dict[str, Column]) -> Column:
    """The names of all checks that do not hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def _given(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def check_nodes(nodes: DataFrame) -> DataFrame:
    """P3. ``errors``: empty for a node that is accepted."""
    return nodes.withColumn("errors", _errors({"id": _given("id"), "name": _given("name"), "node_type": F.col("node_type").isin(NODE_TYPES), "confidence": _between("confidence", 0, 1)}))


def check_relations(relations: DataFrame) -> DataFrame:
    """P3."""
    return relations.withColumn(
        "errors", _errors({"id": _given("id"), "ends": _given("source_id") & _given("target_id"), "relation_type": F.col("relation_type").isin(RELATION_TYPES), "weight": _between("weight", 0, 1)})
    )


def check_hyperedges(edges: DataFrame, roles: dict[str, list[list[str]]] = EDGE_ROLES) -> DataFrame:
    """P3. The roles of an edge are exactly one of its type's sets."""
    have = F.array_sort(F.map_keys("participants"))
    fits = [(F.col("edge_type") == t) & (have == F.array(*map(F.lit, sorted(r)))) for t, sets in roles.items() for r in sets]
    ok = fits[0]
    for f in fits[1:]:
        ok = ok | f
    scored = (F.col("edge_type") != "Value_Loop_Edge") | F.col("fit_score").isNotNull()
    return edges.withColumn("errors", _errors({"id": _given("id"), "edge_type": F.col("edge_type").isin(list(roles)), "roles": ok, "fit_score": scored & _between("fit_score", 0, 1), "risk_score": _between("risk_score", 0, 1)}))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted without ``errors``, rejected with them)."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def members(c: Column) -> Column:
    """The node ids of a role, given as one id or a JSON list of them."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
