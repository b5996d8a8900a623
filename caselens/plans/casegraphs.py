"""Case graphs over the cases of documents, with roles that the project's first words name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import text as X
from caselens.operators import casegraph
from caselens.plans import caserules, documents
from caselens.sources.cases import Cases

#: A node's tag goes by its length, so that every kind of cue occurs.
TAGS = ["segment", "benefit", "gtm", "benchmark", "survey"]
WORD = "[a-z]{4,}"


def graph_cases(spark: SparkSession, sf_dir: str) -> Cases:
    """The cases of documents; a project's metadata names roles by its language,
    its source and the first longer word of its text."""
    lang = F.split(F.col("lang"), ",")[0]
    word, name = F.regexp_extract("text", WORD, 0), F.col("source").alias("name")
    metadata = F.to_json(F.struct(
        F.array(F.struct(lang.alias("segment"))).alias("customer_profiles"), F.concat_ws("/", word, "source").alias("target_customer"),
        F.array(F.struct(name)).alias("value_propositions"), word.alias("core_values"), F.array("source", lang).alias("primary_channels"),
    ))
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("n_chars") % len(TAGS) + 1).cast("int"))
    return caserules.document_cases(spark, sf_dir, more={"metadata": F.when(F.col("kind") == "Project", metadata), "tags": F.array(tag)})


def g2_inferred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casegraph.inferred_nodes(graph_cases(spark, sf_dir)).select("case_id", "id", "role", "name")


def g3_role_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, G3."""
    c = graph_cases(spark, sf_dir)
    return casegraph.role_nodes(c, casegraph.all_nodes(c)).select("case_id", "role", "id", "seq")


def g4_value_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, G4."""
    c = graph_cases(spark, sf_dir)
    return casegraph.value_loops(casegraph.role_nodes(c, casegraph.all_nodes(c)))


def g5_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casegraph.payload(graph_cases(spark, sf_dir))["semantics"]


def g6_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the ten tables."""
    return casegraph.summary(casegraph.payload(graph_cases(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (g2_inferred_nodes, g3_role_nodes, g4_value_loops, g5_semantics, g6_payload)}

_SLUG = lambda c: f"coalesce(nullif(substr(replace({documents._search(c)}, ' ', '_'), 1, 80), ''), 'node')"
_CUE = lambda name: f"regexp_matches(x, '{X.quoted(casegraph.CUES[name])}')"
_TEXT = lambda *c: documents._search("concat_ws(' ', " + ", ".join(c) + ")")
_SPECS = [("customer", 0, "lang"), ("customer", 1, "w"), ("customer", 2, "source"), ("value", 100_000, "source"), ("value", 100_001, "w"), ("channel", 200_000, "source"), ("channel", 200_001, "lang")]
_ABOUT = "CASE role WHEN 'customer' THEN 'Inferred customer concept customer persona' WHEN 'value' THEN 'Inferred value proposition concept value solution' ELSE 'Inferred channel concept channel distribution' END"
_TYPES = lambda role: ", ".join(f"'{t}'" for t in casegraph.ROLE_TYPES[role])
_GRAPH = f"""{caserules._NODES}, nx AS (SELECT *, {_TEXT("nullif(source, '')", "nullif(text, '')", f"({caserules._LIST(TAGS)})[n_chars % {len(TAGS)} + 1]")} AS x FROM n),
pr AS (SELECT case_id, id, source, lang, coalesce(regexp_extract(text, '{WORD}'), '') AS w FROM n WHERE kind = 'Project' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos) = 1),
sp AS (SELECT case_id, role, name, k // 100000 * 100000 + row_number() OVER (PARTITION BY case_id, role ORDER BY k) - 1 AS seq FROM ({' UNION ALL '.join(f"SELECT case_id, '{r}' AS role, {c} AS name, {k} AS k FROM pr" for r, k, c in _SPECS)}) WHERE coalesce(name, '') <> ''),
inf AS (SELECT case_id, lower(case_id) || '_' || role || '_' || {_SLUG('name')} AS id, role, name, seq FROM sp QUALIFY row_number() OVER (PARTITION BY case_id, role, {_SLUG('name')} ORDER BY seq) = 1),
an AS (SELECT case_id, pos AS seq, id, kind, x, upper(CASE WHEN kind = 'Metric' THEN ({caserules._LIST(caserules.METRICS)})[doc_id % {len(caserules.METRICS)} + 1] ELSE source END) AS key FROM nx
UNION ALL SELECT case_id, seq + 1000000, id, 'Concept', {_TEXT('name', _ABOUT)}, upper(name) FROM inf),
ro AS (SELECT case_id, role, id, CAST(min(seq) AS BIGINT) AS seq FROM ({' UNION ALL '.join(f"SELECT case_id, '{r}' AS role, id, seq FROM an WHERE kind IN ({_TYPES(r)}) AND {_CUE(r)}" for r in casegraph.ROLE_TYPES)}
UNION ALL SELECT case_id, role, id, seq + 10000000 FROM inf) GROUP BY ALL)"""
_LOOPS = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, role ORDER BY seq, id) AS n FROM ro QUALIFY n <= {casegraph.MAX_LOOPS}),
lo AS (SELECT c.case_id, lower(c.case_id) || '_value_loop_' || {_SLUG('c.id')} || '_' || {_SLUG('v.id')} || '_' || {_SLUG('h.id')} AS edge_id, c.id AS customer, v.id AS value, h.id AS channel,
CAST(row_number() OVER (PARTITION BY c.case_id ORDER BY c.n, v.n, h.n) AS INT) AS k FROM rk c JOIN rk v USING (case_id) JOIN rk h USING (case_id) WHERE c.role = 'customer' AND v.role = 'value' AND h.role = 'channel' QUALIFY k <= {casegraph.MAX_LOOPS})"""
_ON_NODES = [
    (f"kind = 'Concept' AND ({_CUE('customer')} OR {_CUE('value')})", ["H1"], "customer_value_concept"), (f"kind = 'Artifact' AND {_CUE('report')}", ["H1", "H14"], "report_artifact"),
    ("kind = 'Metric' AND key IN ('TAM', 'SAM', 'SOM')", ["H4"], "market_size_metric"), ("kind = 'Metric' AND key IN ('CAC', 'LTV')", ["H8"], "unit_economics_metric"), ("kind = 'Metric'", ["H5"], "metric_presence"),
    ("kind = 'Evidence'", ["H13"], "evidence_node"), ("kind = 'Mistake'", ["H7", "H10"], "mistake_node"), ("kind IN ('Method', 'Task')", ["H11"], "method_or_task"), (_CUE("competitor"), ["H6"], "competitor_signal"),
]
_NOTE = lambda step, seq, label, node, rule, why, rest: f"SELECT case_id, {step} AS step, {seq} AS seq, {label} AS node_label, {node} AS node_id, '{rule}' AS rule_id, '{why}' AS reason FROM {rest}"
_NOTES = [
    *(_NOTE(0, 0, "'Project'", "id", r, why, "pr") for r, why in (("H12", "project_node"), ("H14", "project_narrative_anchor"))),
    *(_NOTE(1, f"pos * 4 + {k}", label, node, r, f"{t.lower()}_relation", f"vr WHERE type = '{t}'") for t, r in (("PREREQ", "H2"), ("EVIDENCED_BY", "H13")) for k, label, node in ((0, "sl", "s"), (1, "tl", "t"))),
    _NOTE(1, "pos * 4 + 2", "sl", "s", "H14", "evidenced_by_relation", "vr WHERE type = 'EVIDENCED_BY'"),
    *(_NOTE(2, "seq", "kind", "id", r, why, f"an WHERE {cond}") for cond, rules, why in _ON_NODES for r in rules),
    _NOTE(3, 0, "type", "edge_id", "H9", "explicit_hyperedge", "ed WHERE type = 'Value_Loop_Edge'"), _NOTE(3, 0, "type", "edge_id", "H10", "explicit_hyperedge", "ed WHERE type <> 'Value_Loop_Edge'"),
    _NOTE(3, 0, "type", "edge_id", "H15", "risk_pattern_hyperedge", "ed WHERE type = 'Risk_Pattern_Edge'"),
    *(_NOTE(4, "k", "'Value_Loop_Edge'", "edge_id", r, "inferred_customer_value_channel", "lo") for r in ("H1", "H9")),
]
_SEMANTICS = f"""{_GRAPH}, {_LOOPS}, {caserules._MEMBERS},
vr AS (SELECT a.case_id, a.pos, CASE WHEN a.n_chars % 3 = 0 THEN 'PREREQ' ELSE 'EVIDENCED_BY' END AS type, a.id AS s, a.kind AS sl, b.id AS t, b.kind AS tl FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 WHERE a.pos < 9 AND a.n_chars % 3 < 2),
ed AS (SELECT case_id, 'e' || doc_id AS edge_id, CASE WHEN doc_id // 10 % 2 = 0 THEN 'Value_Loop_Edge' ELSE 'Risk_Pattern_Edge' END AS type FROM n WHERE pos = 0),
notes AS (SELECT case_id, node_label, node_id, rule_id, reason FROM ({' UNION ALL '.join(_NOTES)}) QUALIFY row_number() OVER (PARTITION BY case_id, node_label, node_id, rule_id ORDER BY step, seq) = 1)"""
_SIZES = {
    "cases": "SELECT DISTINCT case_id FROM n", "nodes": "FROM an", "contains": "FROM an", "validates": "FROM an WHERE kind = 'Concept'", "mistakes": "FROM an WHERE kind = 'Mistake'", "relations": "FROM vr",
    "hyperedges": "SELECT case_id, edge_id FROM ed UNION SELECT case_id, edge_id FROM lo", "participants": "SELECT edge_id, k::VARCHAR, mem.id FROM mem JOIN n USING (id) UNION ALL SELECT edge_id, unnest(['c', 'v', 'h']), '' FROM lo",
    "semantics": "FROM notes", "case_rules": "SELECT DISTINCT case_id, rule_id FROM notes",
}

ORACLE_SQL = {
    "g2_inferred_nodes": f"WITH {_GRAPH} SELECT case_id, id, role, name FROM inf",
    "g3_role_nodes": f"WITH {_GRAPH} SELECT case_id, role, id, seq FROM ro",
    "g4_value_loops": f"WITH {_GRAPH}, {_LOOPS} SELECT case_id, edge_id, customer, value, channel, k FROM lo",
    "g5_semantics": f"WITH {_SEMANTICS} SELECT * FROM notes",
    "g6_payload": f"WITH {_SEMANTICS} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS rows FROM ({q})" for kind, q in _SIZES.items()),
}
