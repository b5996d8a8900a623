"""The fifteen rules over cases made of documents: ten documents in a row are the
nodes of a case, with their whole texts as descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens import bindings, schemas
from caselens.functions import text as X
from caselens.operators import casegraph, hypergraph, rules
from caselens.sources.cases import Cases

#: A document's type goes by its number, so that the types of a case differ from case to case.
TYPES = ["Project", "Concept", "Task", "Artifact", "Metric", "Mistake", "Evidence", "Method", "KnowledgeCard", "Metric", "Concept"]
METRICS = ["TAM", "SAM", "SOM", "CAC", "LTV"]
STAGES = ["idea", "mvp", "growth"]
#: Types of the two other kinds of cases that the rules are asked about: one without measures, methods and evidence, one with all five metrics.
BARE = ["Project", "Concept", "Task", "Artifact", "Mistake", "KnowledgeCard", "Concept", "Mistake", "Concept", "KnowledgeCard"]
FULL = ["Project", "Metric", "Metric", "Metric", "Metric", "Metric", "Evidence", "KnowledgeCard", "Concept", "Artifact"]
CHANNELS = ["LinkedIn", "Discord", "社交媒体"]


def _nth(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def _worded(text: Column, n: Column) -> Column:
    """``text`` and a keyword of the topics for which the digits of a digest of ``n`` stand: a case of ten has about
    half of them. Every other case has none of compliance, whose short keywords most texts have by chance."""
    digest = F.md5(n.cast("string").cast("binary"))
    often = lambda t: F.floor(n / 10) % 2 == 0 if t.startswith("compliance") else F.lit(True)
    return F.concat_ws(" ", text, *(F.when(often(t) & (F.substring(digest, i + 1, 1) == "0"), _nth(words, n)) for i, (t, words) in enumerate(rules.KEYWORDS.items())))


def document_cases(spark: SparkSession, sf_dir: str, varied: bool = False, more: dict[str, Column] | None = None) -> Cases:
    """Cases, nodes, relations and hyperedges from ``documents``.

    ``varied``: two in three cases have other types, texts have keywords behind them, and channels and metrics
    vary, as the invented texts hardly have any words that the rules look for. ``more``: other columns of the
    nodes, from those of ``documents``.
    """
    d = F.col("doc_id")
    case_of = lambda n: F.concat(F.lit("C"), F.floor(n / 10).cast("string"))
    node_of = lambda n: F.concat(F.lit("d"), n.cast("string"))
    number, kind, text, value = F.floor(d / 10), _nth(TYPES, d * 7 + F.floor(d / 10)), F.col("text"), F.col("n_chars")
    network, own, offered = F.lit("LinkedIn"), F.col("source"), F.col("source")
    if varied:
        kind = F.when(number % 3 == 1, _nth(BARE, d + number)).when(number % 3 == 2, _nth(FULL, d + number)).otherwise(kind)
        text, value, network = _worded(text, d), F.when(d % 7 == 0, 0).otherwise(value), _nth(CHANNELS, F.floor(d / 4))
        own, offered = F.when(F.floor(d / 4) % 2 == 0, "booth").otherwise(own), F.when(d % 3 == 0, "booth").otherwise(offered)
    docs = bindings.spread(bindings.read(spark, sf_dir, "documents")).select("doc_id", text.alias("text"), "lang", "source", "n_chars", value.alias("amount"), kind.alias("kind"), own.alias("own"), offered.alias("offered"))
    when = lambda cond, value: F.when(F.expr(cond), value)
    metadata = F.to_json(F.struct(
        when("doc_id % 2 = 0", F.array(F.when(d % 4 == 0, network).otherwise(F.col("own")))).alias("primary_channels"), when("doc_id % 3 = 0", F.array("lang")).alias("customer_profiles"),
        when("doc_id % 5 = 0", F.array("source")).alias("value_propositions"), when("doc_id % 4 = 0", F.when(d % 8 == 0, "ads").otherwise(F.col("lang"))).alias("pricing_model"),
        when("doc_id % 7 < 3", F.lit(True)).alias("competitor_analysis_required"), when("doc_id % 9 = 0", F.lit("route")).alias("technical_route"), when("doc_id % 2 = 1", F.col("source")).alias("milestones"),
        (d % 10).alias("trl"), when("doc_id % 4 = 1", F.array("source")).alias("rubric_required_evidence"), when("doc_id % 8 = 1", F.array("source")).alias("uploaded_files"),
    ))
    fit = F.struct(F.col("offered").alias("channel"), ((d % 10) / 10).alias("fit_score"), F.array("lang").alias("customer_segments"), F.array().cast("array<string>").alias("applicable_scenarios"))
    is_ = lambda t: F.col("kind") == t
    have = {
        "case_id": case_of(d), "pos": (d % 10).cast("int"), "id": node_of(d), "node_type": F.col("kind"), "name": F.col("source"), "description": F.col("text"), "confidence": (d % 10) / 10,
        "metric_key": F.when(is_("Metric"), _nth(METRICS, d)), "value": F.col("amount").cast("double"), "stage": F.when(is_("Project"), _nth(STAGES, d)),
        "metadata": F.when(is_("Project"), metadata), "industry_benchmarks": F.when(is_("KnowledgeCard"), F.to_json(F.struct(F.array(fit).alias("channel_fit_data")))),
    } | (more or {})

    def rows(df: DataFrame, schema: str, given: dict[str, Column]) -> DataFrame:
        return df.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in (f.split(" ") for f in schema.split(", "))))

    linked = docs.where("doc_id % 10 < 9 AND n_chars % 3 < 2")
    relation = {"case_id": case_of(d), "pos": (d % 10).cast("int"), "id": F.concat(F.lit("r"), "doc_id"), "source_id": node_of(d), "target_id": node_of(d + 1), "relation_type": F.when((F.col("n_chars") % 3 == 0) | (F.lit(varied) & (number % 6 == 1)), "PREREQ").otherwise("EVIDENCED_BY")}
    even = F.floor(d / 10) % 2 == 0
    roles = lambda names: F.create_map(*(x for k, r in enumerate(names) for x in (F.lit(r), node_of(d + 1 + 2 * k))))
    edge = {
        "case_id": case_of(d), "pos": F.lit(0), "id": F.concat(F.lit("e"), "doc_id"), "edge_type": F.when(even, "Value_Loop_Edge").otherwise("Risk_Pattern_Edge"),
        "participants": F.when(even, roles(["market", "technology", "project"])).otherwise(roles(["project", "mistake", "outcome"])),
    }
    cases = docs.select(case_of(d).alias("case_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description")).distinct()
    return Cases(cases, rows(docs, schemas.NODES, have), rows(linked, schemas.RELATIONS, relation), rows(docs.where("doc_id % 10 = 0"), schemas.HYPEREDGES, edge))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_cases(spark, sf_dir, varied=True)
    return rules.evaluate(rules.features(c.cases, c.nodes, c.relations, c.hyperedges, c.participants))


def h0_h15_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H0-H15 and, below them, F8, G17, H19, J5: the outcome of each rule in each case."""
    evidence = F.array_join(F.array_sort("evidence_nodes"), ",")
    return _results(spark, sf_dir).select("case_id", "rule_id", "status", "severity", "reason", "is_triggered", evidence.alias("evidence"), "message", "fix_suggestion")


def a14_case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.overall(_results(spark, sf_dir))


def h16_draft_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.draft_diagnosis(_results(spark, sf_dir)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


def j1_valid_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between nodes that the case has, with their labels."""
    c = document_cases(spark, sf_dir)
    return casegraph.valid_relations(c, casegraph.all_nodes(c)).select("case_id", "relation_type", "source_id", "source_label", "target_id", "target_label")


def j2_valid_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, J2."""
    c = document_cases(spark, sf_dir)
    return casegraph.valid_participants(c, casegraph.all_nodes(c)).select("case_id", "edge_id", "role", "node_id", "node_label")


def p3_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the nodes, relations and hyperedges that are rejected."""
    c = document_cases(spark, sf_dir)
    checked = [schemas.check_nodes(c.nodes), schemas.check_relations(c.relations), schemas.check_hyperedges(c.hyperedges)]
    parts = [schemas.split(x)[1].select(F.lit(kind).alias("kind"), F.explode("errors").alias("error")) for kind, x in zip(("node", "relation", "hyperedge"), checked)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind", "error").agg(F.count("*").alias("n"))


def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of cases and itself are the set."""
    c = document_cases(spark, sf_dir)
    both = c.union(c)
    tables = {"cases": both.cases, "nodes": both.nodes, "relations": both.relations, "hyperedges": both.hyperedges}
    return casegraph.summary(tables)


def u1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes and relations of two sets of cases with the same ids; what is equal in all columns is one row."""
    both = document_cases(spark, sf_dir).union(document_cases(spark, sf_dir, varied=True))
    nodes = both.nodes.select(F.lit("node").alias("kind"), "case_id", "id", F.concat_ws(" ", "node_type", F.col("value").cast("long"), "metric_key", F.md5(F.col("description").cast("binary"))).alias("detail"))
    relations = both.relations.select(F.lit("relation").alias("kind"), "case_id", "id", F.concat_ws(" ", "source_id", "target_id", "relation_type").alias("detail"))
    return nodes.unionByName(relations)


#: Words of the invented texts in the place of a teacher's keywords.
RISK_WORDS = ["thor", "eaux", "ción"]


def g16_risk_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first risk edges with a member whose text has a keyword."""
    c = document_cases(spark, sf_dir)
    nodes = c.nodes.select(F.col("id").alias("node_id"), "node_type", F.concat("name", F.lit("/"), "id").alias("name"), F.col("description").alias("text"))
    edges = c.hyperedges.where("edge_type = 'Risk_Pattern_Edge'").select(F.col("id").alias("edge_id"), "case_id")
    found = hypergraph.risk_patterns(nodes, c.participants, edges, c.nodes.select("case_id", F.col("id").alias("node_id")), RISK_WORDS, 20)
    return found.select("edge_id", "case_id", *(F.array_join(F.coalesce(x, F.array().cast("array<string>")), ",").alias(x) for x in ("matched", "members", "strategies")))


QUERIES = {f.__name__: f for f in (g16_risk_patterns, h0_h15_rules, a14_case_status, h16_draft_diagnosis, j1_valid_relations, j2_valid_participants, p3_rejected, u1_union, u1_rows)}

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_HAS = lambda topic: f"regexp_matches(x, '{X.quoted(rules.KEYWORDS[topic])}')"
_IDS = lambda cond, n=None: f"coalesce(list(id ORDER BY pos) FILTER ({cond}), []){f'[1:{n}]' if n else ''}"
_NODES = f"""n AS (SELECT 'C' || (doc_id // 10) AS case_id, doc_id % 10 AS pos, doc_id, 'd' || doc_id AS id, ({_LIST(TYPES)})[(doc_id * 7 + doc_id // 10) % {len(TYPES)} + 1] AS kind, text, source, lang, n_chars FROM documents)"""
_RELATIONS = "rel AS (SELECT case_id, id AS s, 'd' || (doc_id + 1) AS t, CASE WHEN n_chars % 3 = 0 THEN 'PREREQ' ELSE 'EVIDENCED_BY' END AS type FROM n WHERE pos < 9 AND n_chars % 3 < 2)"
_MEMBERS = "mem AS (SELECT 'C' || c AS case_id, 'e' || (10 * c) AS edge_id, unnest([1, 3, 5]) AS k, 'd' || (10 * c + unnest([1, 3, 5])) AS id, c FROM (SELECT DISTINCT doc_id // 10 AS c FROM documents WHERE doc_id % 10 = 0))"
_VARIED = f"""n AS (SELECT 'C' || (doc_id // 10) AS case_id, doc_id % 10 AS pos, doc_id, 'd' || doc_id AS id, source, lang, n_chars, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS amount,
CASE doc_id // 10 % 3 WHEN 1 THEN ({_LIST(BARE)})[(doc_id + doc_id // 10) % 10 + 1] WHEN 2 THEN ({_LIST(FULL)})[(doc_id + doc_id // 10) % 10 + 1] ELSE ({_LIST(TYPES)})[(doc_id * 7 + doc_id // 10) % {len(TYPES)} + 1] END AS kind,
concat_ws(' ', text, {', '.join(f"CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), {i}, 1) = '0'{' AND doc_id // 10 % 2 = 0' if t.startswith('compliance') else ''} THEN ({_LIST(w)})[doc_id % {len(w)} + 1] END" for i, (t, w) in enumerate(rules.KEYWORDS.items(), 1))}) AS text FROM documents)"""
_VARIED_RELATIONS = _RELATIONS.replace("n_chars % 3 = 0 THEN", "n_chars % 3 = 0 OR doc_id // 10 % 6 = 1 THEN")
_META = """CASE WHEN kind = 'Project' THEN concat_ws(' ', CASE WHEN doc_id % 4 = 0 THEN (['linkedin', 'discord', '社交媒体'])[doc_id // 4 % 3 + 1] WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id // 4 % 2 = 0 THEN 'booth' ELSE source END END, CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 5 = 0 THEN source END,
CASE WHEN doc_id % 8 = 0 THEN 'ads' WHEN doc_id % 4 = 0 THEN lang END, CASE WHEN doc_id % 7 < 3 THEN 'true' END, CASE WHEN doc_id % 9 = 0 THEN 'route' END, CASE WHEN doc_id % 2 = 1 OR doc_id % 4 = 1 THEN source END, doc_id % 10) END"""
_TOPICS = list(rules.KEYWORDS)
_METRIC = lambda k: f"first(amount ORDER BY pos) FILTER (key = '{k}') AS v_{k}, first(id ORDER BY pos) FILTER (key = '{k}') AS i_{k}"
_FEATURES = f"""{_VARIED}, {_VARIED_RELATIONS}, {_MEMBERS},
tx AS (SELECT *, CASE WHEN kind = 'Metric' THEN ({_LIST(METRICS)})[doc_id % {len(METRICS)} + 1] END AS key, CASE WHEN kind = 'Project' THEN ({_LIST(STAGES)})[doc_id % {len(STAGES)} + 1] END AS stage FROM n),
nx AS (SELECT *, trim(regexp_replace(lower(concat_ws(' ', source, text, key, stage, {_META})), '\\s+', ' ', 'g')) AS x FROM tx), fl AS (SELECT *, {', '.join(f'{_HAS(t)} AS t_{t}' for t in _TOPICS)} FROM nx),
pr AS (SELECT case_id, min_by(id, pos) AS pid, min_by(doc_id, pos) AS p, min_by(stage, pos) AS stage, min_by(source, pos) AS psource, min_by(lang, pos) AS plang FROM tx WHERE kind = 'Project' GROUP BY case_id),
li AS (SELECT case_id, s AS a, t AS b FROM rel UNION SELECT case_id, t, s FROM rel UNION SELECT x.case_id, x.id, y.id FROM mem x JOIN mem y USING (edge_id)),
re AS (WITH RECURSIVE go AS (SELECT case_id, pid AS id FROM pr UNION SELECT go.case_id, b FROM go JOIN li ON li.case_id = go.case_id AND li.a = go.id) SELECT * FROM go),
br AS (SELECT case_id, {' OR '.join(f'(bool_or(t_{t}) AND NOT bool_or(t_{t} AND re.id IS NOT NULL))' for t in ('customer', 'value', 'channel'))} AS broken FROM fl LEFT JOIN re USING (case_id, id) GROUP BY case_id),
ca AS (SELECT case_id, k.id, (k.doc_id % 10) / 10 AS fit, pr.p % 3 <> 0 OR k.lang = plang AS seg FROM pr JOIN n k USING (case_id) WHERE k.kind = 'KnowledgeCard' AND p % 2 = 0 AND p % 4 <> 0 AND CASE WHEN k.doc_id % 3 = 0 THEN 'booth' ELSE k.source END = CASE WHEN p // 4 % 2 = 0 THEN 'booth' ELSE psource END),
cf AS (SELECT case_id, coalesce(list(id) FILTER (fit < 0.35 OR NOT seg), []) AS misfits, coalesce(list(id) FILTER (fit < 0.2 OR NOT seg), []) AS unreachable FROM ca GROUP BY case_id),
g AS (SELECT case_id, {', '.join(f'bool_or(t_{t}) AS {t}' for t in _TOPICS)}, {', '.join(f"{_IDS(f't_{t}', k)} AS i_{t}" for t, k in (('customer', 2), ('value', 2), ('competitor', 4), ('compliance_control', 2)))},
{', '.join(f'''{_IDS(f"kind = '{t}'", 2)} AS k_{t}''' for t in ('Method', 'Metric', 'Artifact', 'Task'))}, {_IDS("kind = 'Evidence'", 3)} AS k_Evidence, {_IDS("kind = 'Evidence' AND t_demand", 3)} AS i_demand, {_IDS("kind = 'Evidence' AND pos < 5")} AS i_weak,
count(*) FILTER (kind = 'Evidence' AND t_payment) AS paid, {', '.join(map(_METRIC, METRICS))} FROM fl GROUP BY case_id),
ev AS (SELECT case_id, count(*) AS evidenced FROM rel WHERE type = 'EVIDENCED_BY' GROUP BY case_id), lo AS (SELECT DISTINCT case_id FROM mem WHERE c % 2 = 0),
f AS (SELECT g.*, pid, p, psource, coalesce(pr.stage, '') AS stage, coalesce(evidenced, 0) AS evidenced, lo.case_id IS NOT NULL AS looped, broken, coalesce(misfits, []) AS misfits, coalesce(unreachable, []) AS unreachable,
CASE WHEN pid IS NULL THEN [] ELSE [pid] END AS i_project FROM g LEFT JOIN pr USING (case_id) LEFT JOIN ev USING (case_id) LEFT JOIN lo USING (case_id) LEFT JOIN br USING (case_id) LEFT JOIN cf USING (case_id))"""
_ANY = lambda c: f"len({c}) > 0"
_P = lambda cond: f"coalesce({cond}, false)"
_P0 = "coalesce(p // 4 % 3, 0)"
_CHANNEL, _ROUTE, _EARLY = _P("p % 2 = 0"), _P("p % 9 = 0"), "stage IN ('idea', 'mvp')"
_MISSING = lambda *k: "(" + " OR ".join(f"v_{x} IS NULL" for x in k) + ")"
_MARKET, _UNIT = _MISSING("TAM", "SAM", "SOM"), _MISSING("CAC", "LTV")
_GAPS = f"""({_P('p % 7 < 3')} AND NOT competitor OR {_MARKET} OR {_UNIT} OR v_CAC <= 0 OR len(k_Evidence) = 0 OR stage IN ('mvp', 'growth') AND len(k_Artifact) = 0 OR {_P('p % 4 = 1 AND p % 8 <> 1')})"""
_PARTS = "CAST(len(k_Task) > 0 OR len(k_Artifact) > 0 AS INT) + CAST(len(k_Metric) > 0 AS INT) + CAST(len(k_Evidence) > 0 AS INT)"
_IDS_OF = lambda *k: "list_filter([" + ", ".join(f"i_{x}" for x in k) + "], lambda i: i IS NOT NULL)"
_W, _L, _OK = "WARNING", "FAILED", "PASSED"
_RULES = {
    "H1": ("i_project || i_customer || i_value", [
        (f"NOT customer AND NOT {_P('p % 3 = 0')}", _W, "no_customer"), (f"NOT value AND NOT {_P('p % 5 = 0')}", _W, "no_value"), (f"NOT {_CHANNEL}", _W, "no_channel"), (_ANY("misfits"), _L, "channel_misfit"),
        (f"enterprise_sale AND {_P('p % 4 = 0 AND p // 4 % 3 <> 1')}", _L, "weak_channel"), (f"{_P('p % 8 = 0')} AND enterprise_service", _L, "revenue_misfit"),
    ]),
    "H2": ("i_project", [(f"NOT {_CHANNEL}", _W, "no_channel"), (_ANY("unreachable"), _L, "unreachable"), (f"{_P('p % 4 = 0')} AND ([minors, elderly, industrial])[{_P0} + 1]", _L, "wrong_audience")]),
    "H3": ("i_project || k_Evidence", [(f"NOT {_P('p % 4 = 0')} AND NOT revenue", _W, "no_pricing"), ("paid = 0", _W, "no_payment_evidence")]),
    "H4": (_IDS_OF("TAM", "SAM", "SOM"), [(_MARKET, _W, "missing"), ("NOT (v_TAM >= v_SAM AND v_SAM >= v_SOM)", _L, "order")]),
    "H5": ("i_project || i_demand", [("len(k_Evidence) = 0 AND evidenced = 0", _W, "no_evidence"), ("len(i_weak) > 0 AND len(i_demand) = 0", _W, "weak_evidence")]),
    "H6": ("i_project || i_competitor", [(f"{_P('p % 7 < 3')} AND NOT competitor", _W, "required"), ("no_competitor AND NOT competitor", _W, "denied"), ("competitor AND NOT competitor_kind", _W, "one_sided")]),
    "H7": ("i_project || k_Method || k_Metric", [("NOT innovation", _OK, "no_claim"), (f"NOT {_ROUTE} AND len(k_Method) = 0 AND len(k_Metric) = 0", _L, "unsupported")]),
    "H8": (_IDS_OF("CAC", "LTV"), [(_UNIT, _W, "missing"), ("v_CAC <= 0", _W, "cac"), ("v_LTV < 3 * v_CAC", _W, "ratio")]),
    "H9": ("i_project || k_Artifact || k_Evidence[1:2]", [("NOT growth", _OK, "no_claim"), (f"{_EARLY} AND (len(k_Artifact) = 0 OR len(k_Evidence) = 0)", _L, "unproven")]),
    "H10": ("i_project", [(f"NOT {_P('p % 2 = 1')} AND NOT milestone", _OK, "no_plan"), ("deeptech AND NOT expert AND len(k_Method) = 0", _W, "unmanned")]),
    "H11": ("i_project || CASE WHEN compliance_signal THEN i_compliance_control ELSE [] END", [("NOT compliance_signal", _OK, "no_signal"), ("NOT compliance_control", _L, "no_control")]),
    "H12": ("i_project || k_Method", [(f"{_P('p % 10 > 7')} AND NOT expert", _L, "level"), (f"deeptech AND NOT expert AND NOT {_ROUTE} AND len(k_Method) = 0", _L, "no_route")]),
    "H13": ("i_project || k_Task[1:1] || k_Artifact[1:1] || k_Metric[1:1] || k_Evidence[1:1]", [(f"NOT {_EARLY} AND NOT experiment", _OK, "no_claim"), (f"{_PARTS} < 3", _W, "open_loop"), ("experiment_claim AND NOT control", _W, "no_control")]),
    "H14": ("i_project", [
        ("pid IS NULL", _W, "no_project"),
        (f"NOT ((customer OR {_P('p % 3 = 0')}) AND (value OR {_P('p % 5 = 0')}) AND ({_P('p % 4 = 0')} OR v_CAC IS NOT NULL OR v_LTV IS NOT NULL) AND ({_CHANNEL} OR looped))", _W, "gap"), ("broken", _W, "disconnected"),
    ]),
    "H15": (f"CASE WHEN {_GAPS} THEN i_project || k_Artifact || k_Evidence[1:2] ELSE i_project END", [(_GAPS, _W, "gaps")]),
}


def _chain(rule: str, pick: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {o[0]} THEN '{o[pick]}'" for o in _RULES[rule][1]) + f" ELSE '{default}' END"


_NAMES = lambda *pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda i: i IS NOT NULL), ', ')"
_ABSENT = {
    "H4": _NAMES(*((k, f"v_{k} IS NULL") for k in ("TAM", "SAM", "SOM"))), "H8": _NAMES(*((k, f"v_{k} IS NULL") for k in ("CAC", "LTV"))),
    "H14": _NAMES(("问题/客户", f"NOT (customer OR {_P('p % 3 = 0')})"), ("方案", f"NOT (value OR {_P('p % 5 = 0')})"), ("盈利", f"NOT ({_P('p % 4 = 0')} OR v_CAC IS NOT NULL OR v_LTV IS NOT NULL)"), ("增长", f"NOT ({_CHANNEL} OR looped)")),
    "H15": f"""CASE WHEN {_P('p % 7 < 3')} AND NOT competitor THEN '竞品对比表' WHEN {_MARKET} THEN '市场规模测算表' WHEN {_UNIT} OR v_CAC <= 0 THEN '财务测算表' WHEN len(k_Evidence) = 0 THEN '用户证据包'
WHEN stage IN ('mvp', 'growth') AND len(k_Artifact) = 0 THEN '原型或阶段性交付物' ELSE psource END""",
}


def _said(rule: str, which: int) -> str:
    """The message (0) or the advice (1) of the outcome."""
    text = lambda reason: f"replace('{rules.TEXTS[rule, reason][which]}', '{{missing}}', {_ABSENT.get(rule, repr(''))})"
    return "CASE " + " ".join(f"WHEN {o[0]} THEN {text(o[2])}" for o in _RULES[rule][1]) + f" ELSE {text('ok')} END"


_EVIDENCE = """CASE WHEN rule_id = 'H5' AND reason = 'weak_evidence' THEN i_weak WHEN reason = 'channel_misfit' THEN ids || misfits WHEN reason = 'unreachable' THEN ids || unreachable ELSE ids END"""
_ROWS = " UNION ALL ".join(f"SELECT case_id, '{r}' AS rule_id, {_chain(r, 1, _OK)} AS status, {_chain(r, 2, 'ok')} AS reason, {_said(r, 0)} AS message, {_said(r, 1)} AS fix_suggestion, {_RULES[r][0]} AS ids, i_weak, misfits, unreachable FROM f" for r in _RULES)
_HARD = ", ".join(f"'{r}'" for r, _, severity, _ in rules.CATALOG if severity == "High")
_SQL = f"WITH {_FEATURES}, rows AS ({_ROWS})"
_LABELLED = "(SELECT id, kind FROM n)"

ORACLE_SQL = {
    "g16_risk_patterns": f"""WITH {_NODES}, {_MEMBERS}, nn AS (SELECT *, source || '/' || id AS name FROM n), pm AS (SELECT mem.case_id, edge_id, (['project', 'mistake', 'outcome'])[k // 2 + 1] AS role, name, kind, text FROM mem JOIN nn ON nn.id = mem.id WHERE c % 2 = 1),
hit AS (SELECT edge_id, any_value(case_id) AS case_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS matched FROM pm WHERE kind NOT IN ('Evidence', 'KnowledgeCard') AND regexp_matches(lower(text), '{X.quoted(RISK_WORDS)}') GROUP BY edge_id ORDER BY edge_id LIMIT 20)
SELECT edge_id, case_id, matched, (SELECT array_to_string(list_sort(list(DISTINCT role || ':' || name)), ',') FROM pm WHERE pm.edge_id = hit.edge_id) AS members,
coalesce((SELECT array_to_string(list_sort(list(DISTINCT name))[1:5], ',') FROM nn WHERE nn.case_id = hit.case_id AND kind IN ('Task', 'Method', 'Artifact')), '') AS strategies FROM hit""",
    "h0_h15_rules": f"""{_SQL} SELECT case_id, rule_id, status, CASE WHEN status = 'FAILED' AND rule_id IN ({_HARD}) THEN 'High' WHEN status IN ('FAILED', 'WARNING') THEN 'Warning' ELSE 'Info' END AS severity, reason,
status <> 'PASSED' AS is_triggered, array_to_string(list_sort(list_distinct({_EVIDENCE})), ',') AS evidence, message, fix_suggestion FROM rows""",
    "a14_case_status": f"""{_SQL}, c AS (SELECT case_id, {', '.join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ('FAILED', 'WARNING', 'PASSED', 'SKIPPED'))} FROM rows GROUP BY case_id)
SELECT *, CASE WHEN failed > 0 THEN 'FAILED' WHEN warning > 0 THEN 'WARNING' ELSE 'PASSED' END AS overall_status FROM c""",
    "h16_draft_diagnosis": f"{_SQL} SELECT rule_id, status, count(*) AS n FROM rows WHERE rule_id IN ('H1', 'H4', 'H6', 'H8') AND status <> 'PASSED' GROUP BY rule_id, status",
    "j1_valid_relations": f"WITH {_NODES}, {_RELATIONS} SELECT rel.case_id, type AS relation_type, s AS source_id, a.kind AS source_label, t AS target_id, b.kind AS target_label FROM rel JOIN {_LABELLED} a ON a.id = s JOIN {_LABELLED} b ON b.id = t",
    "j2_valid_participants": f"""WITH {_NODES}, {_MEMBERS} SELECT mem.case_id, edge_id, CASE WHEN c % 2 = 0 THEN (['market', 'technology', 'project'])[k // 2 + 1] ELSE (['project', 'mistake', 'outcome'])[k // 2 + 1] END AS role,
mem.id AS node_id, kind AS node_label FROM mem JOIN {_LABELLED} l ON l.id = mem.id""",
    "p3_rejected": """SELECT 'hyperedge' AS kind, 'fit_score' AS error, count(*) AS n FROM documents WHERE doc_id % 10 = 0 AND doc_id // 10 % 2 = 0
UNION ALL SELECT 'node', 'name', n FROM (SELECT count(*) AS n FROM documents WHERE coalesce(trim(source), '') = '') WHERE n > 0""",
    "u1_rows": f"""WITH plain AS (WITH {_NODES} SELECT *, n_chars AS amount, source AS offered, CASE doc_id % 4 WHEN 0 THEN 'LinkedIn' WHEN 2 THEN source END AS own FROM n), varied AS (WITH {_VARIED} SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'booth' ELSE source END AS offered,
CASE WHEN doc_id % 4 = 0 THEN ({_LIST(CHANNELS)})[doc_id // 4 % 3 + 1] WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id // 4 % 2 = 0 THEN 'booth' ELSE source END END AS own FROM n), a AS (SELECT * FROM plain UNION ALL BY NAME SELECT * FROM varied),
r AS (WITH {_NODES}, {_RELATIONS} SELECT * FROM rel UNION SELECT * FROM (WITH {_VARIED}, {_VARIED_RELATIONS} SELECT * FROM rel))
SELECT 'node' AS kind, case_id, id, concat_ws(' ', kind, amount, CASE WHEN kind = 'Metric' THEN ({_LIST(METRICS)})[doc_id % {len(METRICS)} + 1] END, md5(text)) AS detail
FROM (SELECT DISTINCT case_id, id, doc_id, kind, amount, text, CASE kind WHEN 'Project' THEN own WHEN 'KnowledgeCard' THEN offered END AS extra FROM a)
UNION ALL SELECT 'relation', case_id, 'r' || substr(s, 2), concat_ws(' ', s, t, type) FROM r""",
    "u1_union": f"""WITH {_NODES}, {_RELATIONS} SELECT 'cases' AS kind, count(DISTINCT case_id) AS rows FROM n UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'relations', count(*) FROM rel
UNION ALL SELECT 'hyperedges', count(*) FROM n WHERE pos = 0""",
}
