"""Case files: the legacy layout with nodes, relations and hyperedges, and
processed extractions, of which a case graph is derived."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens import schemas
from caselens.functions import json as J
from caselens.functions import text as X


@dataclass(frozen=True)
class Cases:
    """The tables of a set of cases."""

    cases: DataFrame
    nodes: DataFrame
    relations: DataFrame
    hyperedges: DataFrame

    @property
    def participants(self) -> DataFrame:
        """case_id, edge_id, edge_type, role, node_id: the flattened incidence (any order)."""
        roles = self.hyperedges.select("case_id", F.col("id").alias("edge_id"), "edge_type", F.explode("participants").alias("role", "ids"))
        return roles.select("case_id", "edge_id", "edge_type", "role", F.explode(schemas.members(F.col("ids"))).alias("node_id"))

    def union(self, other: Cases) -> Cases:
        """U1. All rows of both, equal ones once."""
        both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        # a map is no key: edges are compared by its entries in order
        edges = both(self.hyperedges, other.hyperedges).withColumn("__entries", F.array_sort(F.map_entries("participants")))
        edges = edges.dropDuplicates([c for c in edges.columns if c != "participants"]).withColumn("participants", F.map_from_entries("__entries")).drop("__entries")
        return Cases(both(self.cases, other.cases).dropDuplicates(), both(self.nodes, other.nodes).dropDuplicates(), both(self.relations, other.relations).dropDuplicates(), edges)


def _name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def wanted_file(path: Column) -> Column:
    """S2. Case files, without archive debris and lists of failed runs."""
    return ~_name(path).startswith("._") & ~_name(path).startswith("_failed_runs_")


def read_cases(spark: SparkSession, path: str) -> Cases:
    """S2. The three lists of every case file become tables; positions start at 0."""
    raw = spark.read.schema(schemas.CASE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return explode_cases(raw.where(wanted_file(F.input_file_name())).where(F.col("case_id").isNotNull()))


def explode_cases(raw: DataFrame) -> Cases:
    child = lambda c: raw.select("case_id", F.posexplode(c).alias("pos", "x")).select("case_id", "pos", "x.*")
    return Cases(raw.select("case_id", "title", "description"), child("nodes"), child("relations"), child("hyperedges"))


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """S3. source_file, source_path, extraction (normalised) of files in the second layout."""
    raw = spark.read.schema("source_file string, extraction string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    raw = raw.withColumn("source_path", F.input_file_name()).where(wanted_file(F.col("source_path")) & F.col("extraction").isNotNull())
    return raw.select(F.coalesce("source_file", _name(F.col("source_path"))).alias("source_file"), "source_path", J.extraction(F.col("extraction")).alias("extraction"))


#: Scores of a derived graph.
PREREQ, INNOVATION, EVIDENCED, MISTAKE = 0.6, 0.65, 0.7, 0.7


def derive(extractions: DataFrame) -> Cases:
    """G1. The case graph of each extraction.

    A project, its core technology and scene, one evidence, at most 12 innovations
    and 12 barriers; relations between them, a value loop and a risk pattern.
    """
    e = F.col("extraction")
    or_ = lambda c, d: F.when(c != "", c).otherwise(d if isinstance(d, Column) else F.lit(d))
    stem = F.regexp_replace("source_file", r"(?<=.)\.[^.]*$", "")
    base = extractions.select(
        X.case_id(F.col("source_file"), F.col("source_path")).alias("case_id"), or_(e["project_name"], stem).alias("project"), or_(e["core_technology"], "Core technology pending clarification").alias("tech"),
        or_(e["application_scene"], "Application scenario pending clarification").alias("scene"), e["innovation_points"].alias("points"),
        F.when(F.size(e["technical_barriers"]) > 0, e["technical_barriers"]).otherwise(F.array(F.lit("Key technical risk pending clarification"))).alias("risks"), "source_file", "source_path",
    ).withColumns({"key": F.replace(F.lower("case_id"), F.lit("-"), F.lit("_")), "innovations": F.slice("points", 1, 12), "barriers": F.slice("risks", 1, 12)})
    nid = lambda kind, what="", n=None: F.concat(F.lit(f"{kind}_"), F.col("key"), F.lit(what), *([(n + 1).cast("string")] if n is not None else []))
    project, tech, scene, proof = nid("project"), nid("concept", "_core_technology"), nid("concept", "_application_scene"), nid("evidence", "_source")
    innovation = lambda i: nid("concept", "_innovation_", i)
    barrier = lambda i: nid("mistake", "_barrier_", i)

    def row(schema: str, **given: Column) -> Column:
        return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ") for f in schema.split(", "))))

    def node(id_: Column, kind: str, name: Column, description: str, tags: list[str], **own: Column) -> Column:
        return row(schemas.NODE, id=id_, node_type=F.lit(kind), name=name, description=F.lit(description), tags=F.array(*map(F.lit, tags)), **({"metadata": F.lit("{}")} | own))

    metadata = F.to_json(F.struct("source_file", "source_path", F.slice("points", 1, 8).alias("value_propositions"), F.col("tech").alias("technical_route"), F.array("scene").alias("target_scenarios"), F.slice("risks", 1, 8).alias("risk_points")))
    nodes = F.concat(
        F.array(
            node(project, "Project", F.col("project"), "Auto-generated from processed JSON extraction.", ["auto_generated", "processed_json"], stage=F.lit("idea"), team_name=F.lit(""), metadata=metadata),
            node(tech, "Concept", F.col("tech"), "Core technology extracted from project PDF.", ["core_technology"]),
            node(scene, "Concept", F.col("scene"), "Application scene extracted from project PDF.", ["application_scene"]),
            node(proof, "Evidence", F.lit("Structured extraction evidence"), "Generated by batch_processor from project PDF.", ["llm_extraction"], source=F.col("source_file"), confidence=F.lit(EVIDENCED)),
        ),
        F.transform("innovations", lambda x, i: node(innovation(i), "Concept", x, "Innovation point extracted from project PDF.", ["innovation_point"])),
        F.transform("barriers", lambda x, i: node(barrier(i), "Mistake", x, "Technical barrier extracted from project PDF.", ["technical_barrier"], symptom=x)),
    )

    def relation(id_: Column, kind: str, source: Column, target: Column, weight: float) -> Column:
        return row(schemas.RELATION, id=id_, source_id=source, target_id=target, relation_type=F.lit(kind), weight=F.lit(weight), evidence_ids=F.array(proof), metadata=F.lit("{}"))

    relations = F.concat(
        F.array(relation(nid("relation", "_project_evidence"), "EVIDENCED_BY", project, proof, EVIDENCED), relation(nid("relation", "_tech_scene"), "PREREQ", tech, scene, PREREQ)),
        F.transform(F.slice("innovations", 1, 6), lambda x, i: relation(nid("relation", "_innovation_", i), "PREREQ", innovation(i), tech, INNOVATION)),
        F.transform(F.slice("barriers", 1, 3), lambda x, i: relation(nid("relation", "_risk_", i), "COMMON_MISTAKE", project, barrier(i), MISTAKE)),
    )

    def edge(kind: str, name: str, title: str, roles: dict[str, Column], **own: Column) -> Column:
        participants = F.map_from_arrays(F.array(*map(F.lit, roles)), F.array(*roles.values()))
        return row(schemas.HYPEREDGE, id=nid("hyperedge", name), edge_type=F.lit(kind), name=F.lit(title), participants=participants, metadata=F.to_json(F.struct("source_file")), **own)

    technologies = F.to_json(F.concat(F.array(tech), F.transform("innovations", lambda x, i: innovation(i))))
    value = edge("Value_Loop_Edge", "_value_loop", "Auto value loop", {"market": scene, "technology": technologies, "project": project}, fit_score=F.when(F.size("innovations") > 0, 0.8).otherwise(0.65))
    score = F.round(F.least(F.lit(0.95), F.lit(0.45) + 0.05 * F.least(F.size("barriers"), F.lit(6))), 2)
    risk = edge("Risk_Pattern_Edge", "_risk_pattern", "Auto risk pattern", {"project": project, "mistake": F.to_json(F.transform("barriers", lambda x, i: barrier(i))), "outcome": scene}, risk_score=score)
    raw = base.select("case_id", F.col("project").alias("title"), F.col("scene").alias("description"), nodes.alias("nodes"), relations.alias("relations"), F.array(value, risk).alias("hyperedges"))
    return explode_cases(raw)
