"""The card graph: rules, tags, concepts, declared relations, triples, backfill.

``cards``: card_id, name, type, industry, tags, labels, related_concepts, rule_ids,
text (all arrays of strings but the scalars); optional JSON lists as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import text as X
from caselens.operators.rules import checkpointed

# Aliases of entities and hints of relations.
ENTITY_ALIASES = {
    "cac": "获客成本", "customer acquisition cost": "获客成本", "获客成本": "获客成本", "ltv": "生命周期价值", "life time value": "生命周期价值", "lifetime value": "生命周期价值", "生命周期价值": "生命周期价值",
    "tam": "总可服务市场", "总可服务市场": "总可服务市场", "sam": "可服务可触达市场", "可服务可触达市场": "可服务可触达市场", "som": "可获取市场", "可获取市场": "可获取市场",
    "mvp": "最小可行产品", "最小可行产品": "最小可行产品", "usp": "独特价值主张", "独特价值主张": "独特价值主张",
}
PREREQ_HINTS = ["前置", "前提", "依赖", "基础是", "需要先", "先完成", "之前先"]
FIX_HINTS = ["修复", "改进", "优化", "建议", "应当", "需要", "整改", "补齐", "解决方案"]


def entity(c: Column) -> Column:
    """F10 with the default aliases."""
    return X.canonical(c, ENTITY_ALIASES)


def _edges(rows: DataFrame, kind: str, dst_label: str, items: Column) -> DataFrame:
    """An edge for each item that is not empty; no inner explode computes the items again to filter on their number."""
    kept = F.explode_outer(F.filter(items, lambda x: x != ""))
    return rows.select(F.lit(kind).alias("type"), F.lit("KnowledgeCard").alias("src_label"), F.col("name").alias("src"), F.lit(dst_label).alias("dst_label"), kept.alias("dst")).where("dst IS NOT NULL")


def attach(cards: DataFrame) -> DataFrame:
    """G7. EVALUATED_BY to rules, ASSOCIATED_WITH to tags and related concepts."""
    empty = F.array().cast("array<string>")
    c = cards.select("name", *(F.coalesce(n, empty).alias(n) for n in ("rule_ids", "tags", "related_concepts")))
    rules = _edges(c, "EVALUATED_BY", "Rule", F.filter(F.transform("rule_ids", lambda x: F.upper(F.trim(x))), lambda x: x.rlike(r"^H(1[0-5]|[1-9])$")))
    tags = _edges(c, "ASSOCIATED_WITH", "Tag", F.col("tags"))
    concepts = _edges(c, "ASSOCIATED_WITH", "Concept", F.transform("related_concepts", entity))
    return rules.union(tags).union(concepts).distinct()


def declared(cards: DataFrame) -> DataFrame:
    """G8. PREREQ, TRIGGERS and INVOLVES edges from the cards' own JSON lists
    ``relations`` [{source,target,type}], ``hyperedges`` [{name,members}] and ``projects``."""
    rel = F.from_json("relations", "array<struct<source:string,target:string,type:string>>")
    r = cards.select("name", F.explode(rel).alias("r")).select(X.predicate(F.col("r.type")).alias("type"), F.lit("Concept").alias("src_label"), entity(F.coalesce("r.source", "name")).alias("src"), F.lit("Concept").alias("dst_label"), entity(F.col("r.target")).alias("dst"))
    hyper = F.from_json("hyperedges", "array<struct<name:string,members:array<string>>>")
    h = cards.select("name", F.explode(hyper).alias("h"))
    triggers = h.select(F.lit("TRIGGERS").alias("type"), F.lit("KnowledgeCard").alias("src_label"), F.col("name").alias("src"), F.lit("Hyperedge").alias("dst_label"), F.col("h.name").alias("dst"))
    members = h.select(F.lit("INVOLVES").alias("type"), F.lit("Hyperedge").alias("src_label"), F.col("h.name").alias("src"), F.lit("Concept").alias("dst_label"), F.explode("h.members").alias("dst")).withColumn("dst", entity(F.col("dst")))
    projects = cards.select(F.lit("INVOLVES").alias("type"), F.lit("KnowledgeCard").alias("src_label"), F.col("name").alias("src"), F.lit("Project").alias("dst_label"), F.explode(F.from_json("projects", "array<string>")).alias("dst"))
    return r.union(triggers).union(members).union(projects).where("src <> '' AND dst <> ''").distinct()


def heuristic_triples(cards: DataFrame, most: int = 16) -> DataFrame:
    """G9. card_id, place, subject, predicate, object, evidence: up to 8 related
    concepts, then sentences of at least 8 characters with a hint; distinct, ``most`` at last."""
    empty = F.array().cast("array<string>")
    related = cards.select("card_id", "name", F.posexplode(F.slice(F.coalesce("related_concepts", empty), 1, 8)).alias("pos", "o"))
    a = related.select("card_id", F.lit(0).alias("kind"), "pos", F.col("name").alias("subject"), F.lit("ASSOCIATED_WITH").alias("predicate"), F.col("o").alias("object"), F.lit("metadata.related_concepts").alias("evidence"))
    s = cards.select("card_id", "name", F.posexplode(X.sentences(F.col("text"))).alias("pos", "s")).where(F.length("s") >= 8)
    hints = F.array_compact(F.array(F.when(F.col("s").rlike(X.quoted(PREREQ_HINTS)), F.lit("PREREQ")), F.when(F.col("s").rlike(X.quoted(FIX_HINTS)), F.lit("FIX_STRATEGY"))))
    b = s.withColumn("p", F.explode(hints)).select("card_id", F.lit(1).alias("kind"), "pos", F.col("name").alias("subject"), F.col("p").alias("predicate"), F.substring("s", 1, 120).alias("object"), F.substring("s", 1, 220).alias("evidence"))
    keys = ["card_id", "subject", "predicate", "object"]
    rows = a.union(b).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("kind", "pos"))).where("n = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("card_id").orderBy("kind", "pos", F.desc("predicate")))).where(F.col("place") <= most).select("card_id", "place", "subject", "predicate", "object", "evidence")


def attach_triples(triples: DataFrame, cards: DataFrame, aligned: DataFrame) -> DataFrame:
    """G10. Triples as edges: a subject that is the card keeps its label, others are
    aligned concepts (name, aligned from ``retrieval.align``)."""
    names = cards.select("card_id", F.col("name").alias("card_name"))
    al = lambda c: aligned.select(F.col("name").alias(c), F.col("aligned").alias(f"{c}_aligned"))
    t = triples.join(names, "card_id").join(al("subject"), "subject", "left").join(al("object"), "object", "left")
    own = F.col("subject") == F.col("card_name")
    return t.select(
        X.predicate(F.col("predicate")).alias("type"), F.when(own, "KnowledgeCard").otherwise("Concept").alias("src_label"), F.when(own, F.col("subject")).otherwise(F.coalesce("subject_aligned", "subject")).alias("src"),
        F.lit("Concept").alias("dst_label"), F.coalesce("object_aligned", "object").alias("dst"), F.substring("evidence", 1, 500).alias("evidence"),
    ).distinct()


def formulas(texts: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """F25, A19. name, formulas: the distinct formulas that mention each name, by
    (owner, position) of the first mention. ``texts``: owner, text."""
    rows = texts.select("owner", F.posexplode(X.formulae(F.col("text"))).alias("pos", "formula"))
    hit = F.array_compact(F.array(*(F.when(F.lower("formula").rlike(X.quoted(w)), F.lit(n)) for n, w in names.items())))
    first = rows.select("owner", "pos", "formula", F.explode(hit).alias("name")).groupBy("name", "formula").agg(F.min(F.struct("owner", "pos")).alias("at"))
    return first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "formula"))), lambda x: x["formula"]).alias("formulas"))


def backfill(cards: DataFrame, associations: DataFrame) -> dict[str, DataFrame]:
    """G11, J9, K9. What is added to a card graph, prefixes and names being fixed
    values: a project for each industry, a risk hyperedge for each card with the card
    and the concepts it is associated with, triggered by the industry's project; one
    value loop of the concepts in none; PREREQ for all associations between concepts."""
    associations = checkpointed(associations)  # read for each table
    industry = F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit("Unknown"))
    project = F.concat(F.lit("全校示例项目-"), industry)
    projects = cards.select(F.concat(F.lit("PRJ_"), F.translate(industry, " /", "__")).alias("id"), project.alias("name")).distinct()
    edge = lambda c: F.concat(F.lit("HE_RISK_"), c)
    triggers = cards.select(project.alias("project"), edge(F.col("name")).alias("edge_id")).distinct()
    linked = associations.where("type = 'ASSOCIATED_WITH' AND src_label = 'KnowledgeCard' AND dst_label IN ('Concept', 'Method')").select(edge(F.col("src")).alias("edge_id"), F.col("dst").alias("node"))
    risk = cards.select(edge(F.col("name")).alias("edge_id"), F.col("name").alias("node")).union(linked).distinct()
    concepts = associations.where("dst_label IN ('Concept', 'Method')").select(F.col("dst").alias("node")).distinct()
    loop = concepts.join(risk, "node", "left_anti").select(F.lit("HE_VALUE_CORE_BACKFILL").alias("edge_id"), "node")
    prereq = associations.where("type = 'ASSOCIATED_WITH' AND src_label = 'Concept' AND dst_label = 'Concept'").select("src", "dst").distinct()
    return {"projects": projects, "triggers": triggers, "involves": risk.union(loop), "prereq": prereq}


def view_edges(nodes: DataFrame, edges: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """G24, P8, P12. (edges for a drawing, counts): edges of allowed labels with the
    kind of each end, once for each pair and type; filtered and dirty ones counted."""
    ok = F.exists("labels", lambda x: x.isin(allowed) | x.endswith("_Edge"))
    kind = F.when(F.exists("labels", lambda x: x.endswith("_Edge") | (x == "Hyperedge")), "Hyperedge").when(F.array_contains("labels", "Project"), "Project").otherwise("Concept")
    n = nodes.select("id", ok.alias("ok"), kind.alias("kind"))
    end = lambda s: n.select(F.col("id").alias(s), F.col("ok").alias(f"{s}_ok"), F.col("kind").alias(f"{s}_kind"))
    joined = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    dirty = F.col("src_ok").isNull() | F.col("dst_ok").isNull()
    shown = F.coalesce(F.col("src_ok") & F.col("dst_ok"), F.lit(False))
    counts = joined.agg(F.count("*").alias("edges"), F.count_if(dirty).alias("dirty"), F.count_if(~dirty & ~shown).alias("filtered"))
    return joined.where(shown).select("src", "src_kind", "type", "dst", "dst_kind").distinct(), counts


# Social channels of the mismatch detector.
SOCIAL = ["xiaohongshu", "douyin", "tiktok", "wechat"]


def channel_risk(projects: DataFrame) -> DataFrame:
    """G25. ``mismatch``: farmers who are to be reached through social media. A
    missing customer or channel is read from the text, where a channel found so is
    called "social media", which is none of the names."""
    text = F.lower(X.lit_empty(F.col("text")))
    given = lambda c: F.nullif(F.trim(X.lit_empty(F.col(c))), F.lit(""))
    customer = F.coalesce(given("customer"), F.when(text.contains("farmer"), "farmer"))
    channel = F.coalesce(given("channel"), F.when(text.rlike(X.quoted(SOCIAL)), "social media"))
    return projects.withColumn("mismatch", F.coalesce(F.lower(customer).contains("farmer") & F.lower(channel).rlike(X.quoted(SOCIAL)), F.lit(False)))


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """G12. The counters of ``hypergraph.connectivity`` before and after a backfill, side by side."""
    names = before.columns
    return before.select(*(F.col(c).alias(f"{c}_before") for c in names)).crossJoin(after.select(*(F.col(c).alias(f"{c}_after") for c in names)))  # one row each
