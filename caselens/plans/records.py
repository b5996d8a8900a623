"""Functions on records: JSON details, tagged messages and scores made of the given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens import bindings
from caselens.functions import json as J
from caselens.functions import text as X
from caselens.operators import retrieval, scoring
from caselens.plans import documents

STATUS = ["FAILED", "warn", "Pass", "other"]
ALLOWED = {"user": ["alpha", "beta"], "assistant": ["gamma"]}


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_chars and the first words of the text as ``w``."""
    words = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0)
    return bindings.spread(bindings.read(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", F.coalesce(words, F.array().cast("array<string>")).alias("w"))


def f13_rubric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rubric for each document: by name for even ids, else as a list; a longer word is a criterion."""
    row = lambda name, k: F.struct(name.alias("criterion"), (F.length(name) + k).alias("value"), F.lit(20).alias("max_score"), F.concat(F.lit(" "), name).alias("comment"))
    names = F.array_distinct("w")
    by_name = F.map_from_entries(F.transform(names, lambda x: F.struct(x, F.struct(F.length(x).alias("score")))))
    details = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(by_name.alias("rubric")))).otherwise(F.to_json(F.struct(F.transform(names, lambda x: row(x, 1)).alias("rubric_scores"))))
    return _words(spark, sf_dir).select("doc_id", F.inline(J.rubric_rows(details))).groupBy("doc_id", "max_score").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum(F.length("comment")).alias("comment_chars"), F.max("criterion").alias("last"))


def f14_evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a text as quotes, its source in front and its language behind."""
    details = F.to_json(F.struct(F.col("w").alias("student_quotes"), F.col("source").alias("evidence_trace"), F.array("lang", "source").alias("source_excerpt")))
    trace = J.evidence_trace(details)
    return _words(spark, sf_dir).select("doc_id", F.size(trace).alias("n"), F.md5(F.array_join(trace, ",")).alias("trace_md5"))


def f15_common_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of even documents as given errors, those of the others as diagnostics."""
    given = F.transform("w", lambda x: F.struct(x.alias("error"), (F.length(x) - 5).alias("count"), F.lit("i").alias("impact")))
    told = F.transform("w", lambda x: F.struct(x.alias("rule_id"), F.concat(F.lit("fix "), x).alias("fix_suggestion")))
    details = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(given.alias("common_errors")))).otherwise(F.to_json(F.struct(told.alias("diagnostic_results"))))
    rows = _words(spark, sf_dir).select("doc_id", F.inline(J.common_errors(details)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("count").alias("times"), F.max("error").alias("last"), F.sum(F.length("impact")).alias("impact_chars"))


def f30_tagged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message with evidence behind it, taken apart again; odd turns have none."""
    m = bindings.read(spark, sf_dir, "conversations")
    tagged = F.when(F.col("turn") % 2 == 0, X.tag_evidence(F.col("text"), F.to_json(F.struct("conv_id")))).otherwise(F.col("text"))
    return m.select("conv_id", "turn", X.evidence_payload(tagged).alias("payload"), F.length(F.regexp_replace(X.strip_evidence(tagged), r"\s", "")).alias("text_chars"))


def f31_card_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a text: words in a list, its source below, its language beside."""
    details = F.to_json(F.struct(F.col("lang").alias("card_id"), F.struct(F.array(F.struct(F.col("source").alias("kg_card_id"))).alias("items"), F.col("w").alias("knowledge_card_ids")).alias("deep")))
    ids = J.card_ids(details)
    return _words(spark, sf_dir).select("doc_id", F.size(ids).alias("n"), F.md5(F.array_join(F.array_sort(ids), ",")).alias("ids_md5"))


def f33_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parts in line order as a path."""
    li = bindings.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("p"))
    part = lambda c: F.transform("p", lambda x: x[c].cast("string"))
    return li.select("l_orderkey", X.path_text(part("l_suppkey"), part("l_partkey"), F.slice(part("l_returnflag"), 2, F.size("p"))).alias("path"))


def f34_display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the second field of a line with a row's kind and day."""
    e = bindings.read(spark, sf_dir, "events")
    shown = F.when(F.col("event_id") % 3 == 0, " Not_Started ").when(F.col("event_id") % 3 == 1, "").otherwise(F.col("event_type"))
    line = F.concat(F.lit("kind: "), "event_type", F.lit("，user："), F.col("user_id").cast("string"), F.lit("\nrest"))
    return e.select("event_id", X.display_text(shown, "none").alias("shown"), X.named_field(line, "kind").alias("kind"), X.named_field(line, "user").alias("user"))


def r13_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of messages, two in three with a hint; the others go by their words or to their role's default."""
    hint = F.element_at(F.array(*map(F.lit, ("", "alpha", "gamma"))), (F.col("conv_id") % 3 + 1).cast("int"))
    routed = retrieval.supervise(F.col("role"), F.col("text"), hint, ALLOWED, documents.ROUTES, {"user": "other", "assistant": "other"})
    return bindings.read(spark, sf_dir, "conversations").select("conv_id", "turn", routed.alias("route"))


def c2_rubric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents have a rubric, all have a diagnostic."""
    docs = bindings.read(spark, sf_dir, "documents")
    items = scoring.rubric_items(docs.where("doc_id % 2 = 0"), documents.BONUS)
    status = F.element_at(F.array(*map(F.lit, STATUS)), (F.col("n_chars") % 4 + 1).cast("int"))
    notes = docs.select(F.col("doc_id").alias("owner"), F.concat(F.lit("H"), (F.col("n_chars") % 15 + 1).cast("string")).alias("rule_id"), status.alias("status"))
    return scoring.rubric_table(items, notes)


def c5_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of range, without a maximum and without a name."""
    most = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("double") * 8 - 10)
    rows = bindings.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") - 10).alias("score"), most.alias("max_score"), F.concat(F.lit(" h"), F.col("l_linenumber").cast("string")).alias("rule_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("name")
    )
    return scoring.coerce_rows(rows).select("l_orderkey", "l_linenumber", "score", "max_score", "display")


QUERIES = {f.__name__: f for f in (
    f13_rubric_rows, f14_evidence_trace, f15_common_errors, f30_tagged_evidence, f31_card_ids, f33_paths, f34_display_text, r13_supervised, c2_rubric_table, c5_coerced,
)}

_WORDS = "d AS (SELECT doc_id, source, lang, n_chars, coalesce(regexp_extract_all(text, '[a-z]{4,}'), []) AS w FROM documents)"
_GARBLED = documents.ORACLE_SQL["r11_guardrails"].split("SELECT conv_id, turn, ")[1].split(" AS reason")[0]
_ROUTED = documents.ORACLE_SQL["r12_routes"].split("SELECT conv_id, turn, ", 1)[1].split(" AS route FROM")[0]
_SCORE = "(CASE n_chars % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 5.0 WHEN 2 THEN 9.0 ELSE 6.0 END) / 2"
ORACLE_SQL = {
    "f13_rubric_rows": f"""WITH {_WORDS}, r AS (SELECT doc_id, unnest(list_distinct(w)) AS x FROM d)
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 20 END AS DOUBLE) AS max_score, count(*) AS n, CAST(sum(length(x) + doc_id % 2) AS DOUBLE) AS score, CAST(sum(doc_id % 2 * length(x)) AS BIGINT) AS comment_chars, max(x) AS last FROM r GROUP BY doc_id""",
    "f14_evidence_trace": f"""WITH {_WORDS}, a AS (SELECT doc_id, list_filter([source] || w || [lang, source], lambda x: trim(coalesce(x, '')) <> '') AS a FROM d), u AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS p FROM a),
f AS (SELECT doc_id, x, min(p) AS p FROM u GROUP BY ALL) SELECT doc_id, CAST(count(x) AS INT) AS n, md5(coalesce(string_agg(x, ',' ORDER BY p), '')) AS trace_md5 FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
    "f15_common_errors": f"""WITH {_WORDS}, r AS (SELECT doc_id, unnest(w) AS x FROM d)
SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN greatest(length(x) - 5, 1) ELSE 1 END) AS BIGINT) AS times, max(x) AS last, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE length(x) + 4 END) AS BIGINT) AS impact_chars FROM r GROUP BY doc_id""",
    "f30_tagged_evidence": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{\"conv_id\":' || conv_id || '}' END AS payload, CAST(length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS INT) AS text_chars FROM conversations",
    "f31_card_ids": f"""WITH {_WORDS}, a AS (SELECT doc_id, list_sort(list_distinct(list_filter([lang, source] || w, lambda x: trim(coalesce(x, '')) <> ''))) AS a FROM d)
SELECT doc_id, CAST(len(a) AS INT) AS n, md5(array_to_string(a, ',')) AS ids_md5 FROM a""",
    "f33_paths": """WITH p AS (SELECT *, lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS t FROM lineitem)
SELECT l_orderkey, string_agg(l_suppkey || ':' || l_partkey || coalesce(' -[' || t || ']-> ', ''), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS path FROM p GROUP BY l_orderkey""",
    "f34_display_text": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '未跟进' WHEN 1 THEN 'none' ELSE event_type END AS shown, event_type AS kind, CAST(user_id AS VARCHAR) AS user FROM events",
    "r13_supervised": f"""SELECT conv_id, turn, CASE WHEN ({_GARBLED}) <> '' THEN 'Error' WHEN conv_id % 3 = 0 THEN {_ROUTED} WHEN conv_id % 3 = 1 AND role = 'user' OR conv_id % 3 = 2 AND role = 'assistant' THEN ['alpha', 'gamma'][conv_id % 3] ELSE 'Error' END AS route
FROM (SELECT *, lower(text) AS l FROM conversations)""",
    "c2_rubric_table": f"""SELECT doc_id AS owner, rule_id AS item, score FROM ({documents.ORACLE_SQL['c1_rubric_items']}) WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'H' || (n_chars % 15 + 1), CAST({_SCORE} AS DOUBLE) FROM documents WHERE doc_id % 2 = 1""",
    "c5_coerced": """WITH m AS (SELECT *, greatest(CASE WHEN l_linenumber % 3 = 0 THEN 10 ELSE l_linenumber * 8.0 - 10 END, 0.1) AS most FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(least(greatest(l_quantity - 10, 0), most) AS DOUBLE) AS score, CAST(most AS DOUBLE) AS max_score, 'Rule-H' || l_linenumber || CASE WHEN l_returnflag <> 'N' THEN ' (' || l_returnflag || ')' ELSE '' END AS display FROM m""",
}
