"""Case graphs: inferred nodes and hyperedges, semantic annotation, link tables, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.functions import json as J
from caselens.functions import text as X
from caselens.operators.rules import checkpointed
from caselens.sources.buckets import BucketStore, Keyed
from caselens.sources.cases import Cases

# Cues of the roles.
CUES = {
    "customer": ["customer", "persona", "segment", "user", "target customer", "customer profile", "customer segment", "client", "student"],
    "value": ["value", "benefit", "solution", "value proposition", "usp", "pmf", "pain point", "problem solution"],
    "channel": ["channel", "distribution", "acquisition", "go to market", "gtm", "media", "community", "sales"],
    "competitor": ["competitor", "benchmark", "comparison", "vs", "alternative"],
    "report": ["report", "interview", "research", "insight", "survey"],
}
ROLE_TYPES = {"customer": ["Concept"], "value": ["Concept", "Artifact", "Project"], "channel": ["Concept", "Artifact", "KnowledgeCard"]}
RELATION_RULES = {"PREREQ": "H2", "PRODUCES": "H3", "MEASURED_BY": "H5", "COMMON_MISTAKE": "H7"}
MAX_LOOPS = 12


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """U2. The first row of each key in the stated order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str, keep: tuple[str, ...] = (), create_only: tuple[str, ...] = ()) -> DataFrame:
    """U3. Last-wins merge of ``incoming`` (ordered by ``seq``) into ``existing``.

    A column of ``keep`` keeps its value where the incoming one is null; one of
    ``create_only`` is set only where the key is new.
    """
    values = [c for c in existing.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("new"))
    joined = existing.select(*keys, F.struct(*values).alias("old")).join(last, keys, "full_outer")
    pick = lambda c: (
        F.coalesce(f"new.{c}", f"old.{c}") if c in keep else F.when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in create_only else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    )
    return joined.select(*keys, *(pick(c).alias(c) for c in values))


def cue_texts() -> list[Column]:
    return [F.col("name"), F.col("description"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")]


def inferred_nodes(cases: Cases) -> DataFrame:
    """G2. case_id, id, name, role, seq: customer, value and channel concepts that
    the project's metadata names, in order, with repetitions of an id kept once."""
    m = F.col("metadata")
    objects = lambda key, *names: F.array_compact(F.transform(
        F.coalesce(F.from_json(F.get_json_object(m, f"$.{key}"), "array<string>"), F.array().cast("array<string>")),
        lambda j: F.when(j.startswith("{"), F.coalesce(*(F.nullif(F.get_json_object(j, f"$.{n}"), F.lit("")) for n in names))),
    ))
    def items(key: str) -> Column:
        raw = F.get_json_object(m, f"$.{key}")
        return F.when(raw.startswith("["), X.trimmed(F.from_json(raw, "array<string>"))).when(raw.isNotNull(), X.split_items(raw, "slash")).otherwise(F.array().cast("array<string>"))

    names = {
        "customer": F.concat(objects("customer_profiles", "segment", "name", "persona"), items("target_customer"), items("customer_segments")),
        "value": F.concat(objects("value_propositions", "name", "text", "value"), items("value_proposition"), items("core_values")),
        "channel": F.concat(items("primary_channels"), items("channels"), items("go_to_market_channels")),
    }
    projects = first_wins(cases.nodes.where("node_type = 'Project'"), ["case_id"], ["pos"])

    def spec(k: int, role: str, found: Column) -> Column:
        return F.transform(found, lambda x, i: F.struct((F.lit(k * 100_000) + i).alias("seq"), F.lit(role).alias("role"), x.alias("name")))

    specs = F.concat(*(spec(k, r, c) for k, (r, c) in enumerate(names.items())))
    rows = projects.select("case_id", F.inline(specs))
    rows = rows.withColumn("id", F.concat(F.lower("case_id"), F.lit("_"), "role", F.lit("_"), X.slug(F.col("name"))))
    return first_wins(rows, ["case_id", "id"], ["seq"])


def all_nodes(cases: Cases) -> DataFrame:
    """Own and inferred nodes: case_id, seq, id, node_label, node_type, name,
    description, tags, metric_key, cues. An id that the case already has is not inferred.

    ``cues``, the names of the CUES in a node's texts, are found before anything is shuffled, so that
    whole texts go no further where only they are asked for.
    """
    own = cases.nodes.select("case_id", F.col("pos").cast("long").alias("seq"), "id", X.label(F.col("node_type")).alias("node_label"), "node_type", "name", "description", "tags", "metric_key", X.cues_found(cue_texts(), CUES).alias("cues"))
    new = inferred_nodes(cases).join(own, ["case_id", "id"], "left_anti")
    tags = {"customer": ["customer", "persona"], "value": ["value", "solution"], "channel": ["channel", "distribution"]}
    tag = F.lit(None).cast("array<string>")
    for role, words in tags.items():
        tag = F.when(F.col("role") == role, F.array(*map(F.lit, words))).otherwise(tag)
    inferred = new.select(
        "case_id", (F.col("seq") + 1_000_000).cast("long").alias("seq"), "id", F.lit("Concept").alias("node_label"), F.lit("Concept").alias("node_type"), "name",
        F.concat(F.lit("Inferred "), F.when(F.col("role") == "value", "value proposition").otherwise(F.col("role")), F.lit(" concept")).alias("description"), tag.alias("tags"), F.lit(None).cast("string").alias("metric_key"),
    )
    inferred = inferred.withColumn("cues", X.cues_found(cue_texts(), CUES))
    return first_wins(own.union(inferred), ["case_id", "node_label", "id"], ["seq"])


def role_nodes(cases: Cases, nodes: DataFrame) -> DataFrame:
    """G3. case_id, role, id, seq: nodes whose type and cues fit a role, then those inferred for it."""
    fits = F.array_compact(F.array(*(F.when(F.col("node_type").isin(ROLE_TYPES[r]) & F.array_contains("cues", r), F.lit(r)) for r in ROLE_TYPES)))
    found = nodes.select("case_id", F.explode(fits).alias("role"), "id", "seq")
    named = inferred_nodes(cases).select("case_id", "role", "id", (F.col("seq") + 10_000_000).cast("long").alias("seq"))
    return first_wins(found.union(named), ["case_id", "role", "id"], ["seq"])


def value_loops(roles: DataFrame) -> DataFrame:
    """J4, G4. case_id, edge_id, customer, value, channel: the first MAX_LOOPS
    combinations of a case in nested order.

    Only the first MAX_LOOPS of each role can take part, so the product of a case
    is bounded before it is made.
    """
    ranked = roles.where("case_id IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("case_id", "role").orderBy("seq", "id"))).where(F.col("n") <= MAX_LOOPS)
    # the roles of a case are read once and meet in its row
    side = lambda r: F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("n", "id")))).alias(r)
    sides = ranked.groupBy("case_id").agg(side("customer"), side("value"), side("channel"))
    ends = lambda c, v: F.transform("channel", lambda h: F.struct(c["id"].alias("customer"), v["id"].alias("value"), h["id"].alias("channel")))
    every = F.flatten(F.transform("customer", lambda c: F.flatten(F.transform("value", lambda v: ends(c, v)))))
    loops = sides.select("case_id", F.posexplode(F.slice(every, 1, MAX_LOOPS)).alias("at", "x")).select("case_id", "x.*", (F.col("at") + 1).alias("k"))
    return loops.select("case_id", F.concat_ws("_", F.lower("case_id"), F.lit("value_loop"), *(X.slug(F.col(r)) for r in ("customer", "value", "channel"))).alias("edge_id"), "customer", "value", "channel", "k")


def valid_relations(cases: Cases, nodes: DataFrame) -> DataFrame:
    """P4, J1. Relations whose both ends the case has, with the labels of the ends."""
    ends = lambda side: nodes.select("case_id", F.col("id").alias(f"{side}_id"), F.col("node_label").alias(f"{side}_label")).dropDuplicates(["case_id", f"{side}_id"])
    joined = cases.relations.join(ends("source"), ["case_id", "source_id"]).join(ends("target"), ["case_id", "target_id"])
    return first_wins(joined, ["case_id", "relation_type", "source_id", "target_id"], ["pos"])


def valid_participants(cases: Cases, nodes: DataFrame) -> DataFrame:
    """P4, J2. Distinct participants that the case has as nodes."""
    known = nodes.select("case_id", F.col("id").alias("node_id"), "node_label").dropDuplicates(["case_id", "node_id"])
    return cases.participants.distinct().join(known, ["case_id", "node_id"])


def semantics(cases: Cases, nodes: DataFrame, relations: DataFrame, loops: DataFrame) -> DataFrame:
    """G5. case_id, node_label, node_id, rule_id, reason; the first reason of each
    (label, node, rule) in the order of the steps below."""
    step = lambda df, k, seq, label, node, rule, reason: df.select("case_id", F.lit(k).alias("step"), seq.cast("long").alias("seq"), label.alias("node_label"), node.alias("node_id"), rule.alias("rule_id"), reason.alias("reason"))
    c, lit = F.col, F.lit
    project = first_wins(nodes.where("node_type = 'Project'"), ["case_id"], ["seq"])
    parts = [step(project, 0, lit(0), lit("Project"), c("id"), lit(r), lit(why)) for r, why in (("H12", "project_node"), ("H14", "project_narrative_anchor"))]
    why = F.concat(F.lower("relation_type"), lit("_relation"))
    mapped = relations.withColumn("rule", F.create_map(*(lit(x) for kv in RELATION_RULES.items() for x in kv))[c("relation_type")])
    for k, side in enumerate(("source", "target")):
        parts.append(step(mapped.where("rule IS NOT NULL"), 1, c("pos") * 4 + k, c(f"{side}_label"), c(f"{side}_id"), c("rule"), why))
        proof = relations.where("relation_type = 'EVIDENCED_BY'")
        parts.append(step(proof, 1, c("pos") * 4 + k, c(f"{side}_label"), c(f"{side}_id"), lit("H13"), why))
        if side == "source":
            parts.append(step(proof, 1, c("pos") * 4 + 2, c("source_label"), c("source_id"), lit("H14"), why))
    cue = lambda name: F.array_contains("cues", name)
    kind = lambda *t: c("node_type").isin(*t)
    key = F.upper(F.coalesce(F.nullif(c("metric_key"), lit("")), c("name")))
    on_nodes = [
        (kind("Concept") & (cue("customer") | cue("value")), ["H1"], "customer_value_concept"), (kind("Artifact") & cue("report"), ["H1", "H14"], "report_artifact"),
        (kind("Metric") & key.isin("TAM", "SAM", "SOM"), ["H4"], "market_size_metric"), (kind("Metric") & key.isin("CAC", "LTV"), ["H8"], "unit_economics_metric"),
        (kind("Metric"), ["H5"], "metric_presence"), (kind("Evidence"), ["H13"], "evidence_node"), (kind("Mistake"), ["H7", "H10"], "mistake_node"),
        (kind("Method", "Task"), ["H11"], "method_or_task"), (cue("competitor"), ["H6"], "competitor_signal"),
    ]
    hits = F.array_compact(F.array(*(F.when(cond, F.struct(lit(r).alias("r"), lit(reason).alias("w"))) for cond, rules, reason in on_nodes for r in rules)))
    tagged = nodes.withColumn("hit", F.explode(hits))
    parts.append(step(tagged, 2, c("seq"), c("node_label"), c("id"), c("hit.r"), c("hit.w")))
    label = X.label(c("edge_type"))
    edges = cases.hyperedges
    parts.append(step(edges, 3, c("pos"), label, c("id"), F.when(c("edge_type") == "Value_Loop_Edge", "H9").otherwise("H10"), lit("explicit_hyperedge")))
    parts.append(step(edges.where("edge_type = 'Risk_Pattern_Edge'"), 3, c("pos"), label, c("id"), lit("H15"), lit("risk_pattern_hyperedge")))
    parts += [step(loops, 4, c("k"), lit("Value_Loop_Edge"), c("edge_id"), lit(r), lit("inferred_customer_value_channel")) for r in ("H1", "H9")]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return first_wins(union, ["case_id", "node_label", "node_id", "rule_id"], ["step", "seq"]).drop("step", "seq")


def payload(cases: Cases) -> dict[str, DataFrame]:
    """G6. The ten tables that are loaded into a graph store; what several of them
    are made of is written once to shared storage, without the nodes' texts."""
    whole = all_nodes(cases)
    nodes = checkpointed(whole.drop("description", "tags"))
    relations, loops = checkpointed(valid_relations(cases, nodes)), checkpointed(value_loops(role_nodes(cases, nodes)))
    notes = checkpointed(semantics(cases, nodes, relations, loops))
    link = lambda kind: nodes.where(F.col("node_type") == kind).select("case_id", "node_label", F.col("id").alias("node_id"))
    own = cases.hyperedges.select("case_id", F.col("id").alias("edge_id"), X.label(F.col("edge_type")).alias("edge_label"), "fit_score", "risk_score", F.lit(False).alias("inferred"))
    new = loops.select("case_id", "edge_id", F.lit("Value_Loop_Edge").alias("edge_label"), F.lit(None).cast("double").alias("fit_score"), F.lit(None).cast("double").alias("risk_score"), F.lit(True).alias("inferred"))
    members = valid_participants(cases, nodes).select("case_id", "edge_id", "role", "node_id", "node_label")
    labels = nodes.select("case_id", F.col("id").alias("node_id"), "node_label").dropDuplicates(["case_id", "node_id"])
    looped = loops.select("case_id", "edge_id", F.inline(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("node_id")) for r in ("customer", "value", "channel"))))).join(labels, ["case_id", "node_id"])
    return {
        "cases": cases.cases, "nodes": whole.drop("cues"), "contains": nodes.select("case_id", "node_label", F.col("id").alias("node_id")), "validates": link("Concept"), "mistakes": link("Mistake"), "relations": relations,
        "hyperedges": first_wins(own.union(new), ["case_id", "edge_label", "edge_id"], ["inferred"]), "participants": members.unionByName(looped.select(*members.columns)).distinct(),
        "semantics": notes, "case_rules": notes.select("case_id", "rule_id").distinct(),
    }


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """A17. kind, rows of each table of a payload."""
    out = None
    for kind, df in sorted(tables.items()):
        part = df.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("rows"))
        out = part if out is None else out.union(part)
    return out


#: S17. What a graph store knows a node and an edge by, and what it holds of them.
GRAPH = {
    "kg_nodes": Keyed("node_label string, id string, case_id string, node_type string, name string, description string, tags array<string>, metric_key string", ("node_label", "id")),
    "kg_edges": Keyed("type string, src_label string, src string, dst_label string, dst string, role string, weight double, description string", ("type", "src_label", "src", "dst_label", "dst", "role")),
}


def merge_graph(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, batch: int | None = None, keep: tuple[str, ...] = (), create_only: tuple[str, ...] = (), buckets: int = 64) -> BucketStore:
    """S17. Upsert nodes and edges by key into the graph at ``path``, both or neither.

    Of the rows of a key the one of the greatest ``seq`` wins; columns of a table that
    are not given are null. ``keep`` and ``create_only`` are U3's, for nodes. A batch
    rewrites only the buckets of keys that it has.
    """
    store = BucketStore(spark, path, GRAPH, buckets)

    def whole(rows: DataFrame, name: str) -> DataFrame:
        of = {f.name: f.dataType for f in spark.createDataFrame([], GRAPH[name].schema).schema}
        empty = lambda c: F.lit("") if c in GRAPH[name].keys else F.lit(None)
        return rows.select(*((F.coalesce(c, empty(c)) if c in rows.columns else empty(c)).cast(t).alias(c) for c, t in of.items()), "seq")

    combine = {
        "kg_nodes": lambda old, new: upsert(old, new, list(GRAPH["kg_nodes"].keys), "seq", keep, create_only),
        "kg_edges": lambda old, new: upsert(old, new, list(GRAPH["kg_edges"].keys), "seq"),
    }
    store.merge({"kg_nodes": whole(nodes, "kg_nodes"), "kg_edges": whole(edges, "kg_edges")}, combine, batch)
    return store


def graph_rows(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a payload (G6), in the order of their cases."""
    order = lambda *c: F.struct(*(F.col(x).cast("string") for x in c)).alias("seq")
    edge = lambda df, kind, src_label, src, dst_label, dst, role=None, weight=None: df.select(
        F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), F.lit(src_label).alias("src_label") if isinstance(src_label, str) else src_label.alias("src_label"), F.col(src).alias("src"),
        F.lit(dst_label).alias("dst_label") if isinstance(dst_label, str) else dst_label.alias("dst_label"), F.col(dst).alias("dst"), (F.lit("") if role is None else F.col(role)).alias("role"),
        (F.lit(None) if weight is None else F.col(weight)).cast("double").alias("weight"), order("case_id"),
    )
    label = F.col("node_label")
    parts = [
        edge(tables["relations"], F.col("relation_type"), F.col("source_label"), "source_id", F.col("target_label"), "target_id", None, "weight" if "weight" in tables["relations"].columns else None),
        edge(tables["participants"], "HAS_PARTICIPANT", "Hyperedge", "edge_id", label, "node_id", "role"),
        edge(tables["case_rules"], "HIT_RULE", "Case", "case_id", "Rule", "rule_id"),
        *(edge(tables[t], kind, "Case", "case_id", label, "node_id") for t, kind in (("contains", "CONTAINS"), ("validates", "VALIDATES"), ("mistakes", "HAS_MISTAKE"))),
        edge(tables["hyperedges"], "HAS_HYPEREDGE", "Case", "case_id", F.col("edge_label"), "edge_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return tables["nodes"].drop("seq").withColumn("seq", F.struct(F.col("case_id").cast("string"))), out


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """S17. kg_nodes by label and kg_edges by type, as an export that replaces what is there."""
    tables["nodes"].write.mode("overwrite").partitionBy("node_label").parquet(f"{path}/kg_nodes")
    edges = [
        tables["relations"].select(F.col("relation_type").alias("type"), F.col("source_label").alias("src_label"), F.col("source_id").alias("src"), F.col("target_label").alias("dst_label"), F.col("target_id").alias("dst")),
        tables["participants"].select(F.lit("HAS_PARTICIPANT").alias("type"), F.lit("Hyperedge").alias("src_label"), F.col("edge_id").alias("src"), F.col("node_label").alias("dst_label"), F.col("node_id").alias("dst")),
        tables["case_rules"].select(F.lit("HIT_RULE").alias("type"), F.lit("Case").alias("src_label"), F.col("case_id").alias("src"), F.lit("Rule").alias("dst_label"), F.col("rule_id").alias("dst")),
        *(tables[t].select(F.lit(name).alias("type"), F.lit("Case").alias("src_label"), F.col("case_id").alias("src"), F.col("node_label").alias("dst_label"), F.col("node_id").alias("dst")) for t, name in (("contains", "CONTAINS"), ("validates", "VALIDATES"), ("mistakes", "HAS_MISTAKE"))),
        tables["hyperedges"].select(F.lit("HAS_HYPEREDGE").alias("type"), F.lit("Case").alias("src_label"), F.col("case_id").alias("src"), F.col("edge_label").alias("dst_label"), F.col("edge_id").alias("dst")),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    out.distinct().write.mode("overwrite").partitionBy("type").parquet(f"{path}/kg_edges")
