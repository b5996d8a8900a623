"""Evidence of a question, quotes from all sources, and what an edge should be about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens import bindings
from caselens.functions import text as X
from caselens.operators import hypergraph, retrieval, rules
from caselens.plans import caserules, documents

#: Topics of the given texts beside the operator's own, and what edges with certain words should have.
TOPICS = hypergraph.EDGE_TOPICS | {t: rules.KEYWORDS[t] for t in ("customer", "value", "revenue", "competitor")}
INTENTS = hypergraph.EDGE_INTENTS | {
    "sale": (rules.KEYWORDS["channel"] + rules.KEYWORDS["payment"], ["customer", "value"], ["competitor"]),
    "claim": (rules.KEYWORDS["innovation"] + rules.KEYWORDS["growth"], [], ["marketing", "customer"]),
}


def r10_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of a conversation is the question, its words are the keywords, the other turns are evidence with and
    without excerpts; each fifth conversation has no evidence, but a document for the text of its project."""
    turns = bindings.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), "turn", "role", "text")
    first = turns.where("turn = 0")
    words = F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0)
    asked = first.select("owner", F.col("text").alias("keyword")).union(first.select("owner", F.explode(F.array_distinct(words))))
    later = turns.where("turn > 0 AND owner % 5 > 0")
    entries = later.select("owner", F.col("turn").alias("pos"), F.concat_ws(" -> ", "role", F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("path"), F.when(F.col("turn") % 4 != 3, F.col("text")).otherwise(" ").alias("excerpt"))
    texts = bindings.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), "text")
    found = retrieval.best_evidence(entries, asked, texts)
    return found.select("owner", F.md5("path").alias("path_md5"), F.md5("excerpt").alias("excerpt_md5"), "score")


def r14_sourced_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, given quotes (source and language), logs (events) and the text of an owner."""
    messages = bindings.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), "turn", "role", "text")
    docs = bindings.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), "text", "source", "lang")
    given = docs.select("owner", F.posexplode(F.array("source", "lang")).alias("pos", "text"))
    e = bindings.read(spark, sf_dir, "events")
    logs = e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("user_prompt"), F.col("props").alias("raw_message"))
    return retrieval.quotes(messages, docs.select("owner", "text"), given, logs).select("owner", "place", F.md5("quote").alias("quote_md5"))


def g23_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the varied cases, whose text is that of a case's first document, against their members' texts."""
    c = caserules.document_cases(spark, sf_dir, varied=True)
    nodes = c.nodes.select(F.col("id").alias("node_id"), F.col("description").alias("text"))
    edges = c.hyperedges.select(F.col("id").alias("edge_id"), F.regexp_replace("id", "^e", "d").alias("node_id")).join(nodes, "node_id").select("edge_id", "text")
    return hypergraph.semantic_check(edges, c.participants, nodes, TOPICS, INTENTS)


QUERIES = {f.__name__: f for f in (r10_best_evidence, r14_sourced_quotes, g23_topics)}

_HITS = lambda c: f"len(list_filter(coalesce(ks, []), lambda w: contains({documents._search(c)}, w)))"
#: As sentences are kept with their ends: up to an end, or a line's rest without one.
_KEPT = "list_filter(list_transform(regexp_extract_all({0}, '[^。！？.!?\\n]*[。！？.!?]|[^。！？.!?\\n]+'), lambda x: " + documents._trim.format("x") + "), lambda x: x <> '')"
_SET = lambda words: f"regexp_matches(x, '{X.quoted(words)}')"
_NAMES = lambda pairs: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in pairs) + "], lambda i: i IS NOT NULL)), ',')"


def _intent(name: str) -> str:
    words, need, bad = INTENTS[name]
    has = lambda t: f"coalesce(t_{t}, false)"
    share = " + ".join(f"CAST({has(t)} AS INT)" for t in need)
    coverage = f"({share}) / {len(need)}" if need else "1"
    missing = _NAMES([(t, f"NOT {has(t)}") for t in need]) if need else "''"
    return f"SELECT edge_id, '{name}' AS intent, CAST({coverage} AS DOUBLE) AS coverage, {missing} AS missing, {_NAMES([(t, has(t)) for t in bad])} AS forbidden FROM e LEFT JOIN h USING (edge_id) WHERE {_SET(words)}"


def _quotes(sourced: bool) -> str:
    more = """UNION ALL SELECT doc_id, 1, unnest([0, 1]), trim(unnest([source, lang])) FROM documents
UNION ALL SELECT user_id, 2, event_id, trim(coalesce(CASE WHEN event_id % 3 = 0 THEN nullif(event_type, '') END, props)) FROM events""" if sourced else ""
    return f"""WITH s AS (SELECT doc_id AS owner, trim(text) AS text, list_filter({_KEPT.format("coalesce(text, '')")}, lambda x: length(x) > 10) AS s FROM documents),
a AS (SELECT conv_id AS owner, 0 AS kind, CAST(turn AS BIGINT) AS pos, trim(text) AS quote FROM conversations WHERE lower(role) = 'user' {more}
UNION ALL SELECT owner, 3, unnest(range(least(len(s), 10))), unnest(s[1:10]) FROM s UNION ALL SELECT owner, 4, 0, substr(text, 1, 200) FROM s WHERE len(s) > 10),
f AS (SELECT * FROM a WHERE quote <> '' QUALIFY row_number() OVER (PARTITION BY owner, quote ORDER BY kind, pos) = 1)
SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY kind, pos, quote) AS INT) AS place, md5(quote) AS quote_md5 FROM f"""


ORACLE_SQL = {
    "r10_best_evidence": f"""WITH t AS (SELECT conv_id AS owner, turn, role, text FROM conversations), q AS (SELECT * FROM t WHERE turn = 0),
kw AS (SELECT owner, {documents._search()} AS k FROM q UNION SELECT owner, unnest(regexp_extract_all(text, '[a-z]{{4,}}')) FROM q), ks AS (SELECT owner, list(DISTINCT k) AS ks FROM kw WHERE k <> '' GROUP BY owner),
en AS (SELECT owner, turn AS pos, concat_ws(' -> ', role, CASE WHEN turn % 2 = 0 THEN text END) AS path, CASE WHEN turn % 4 <> 3 THEN text ELSE ' ' END AS excerpt FROM t WHERE turn > 0 AND owner % 5 > 0),
sc AS (SELECT owner, pos, path, excerpt, {_HITS("coalesce(path, '')")} + {_HITS("coalesce(excerpt, '')")} + CASE WHEN trim(coalesce(excerpt, '')) = '' THEN 0 ELSE 2 END AS score FROM en LEFT JOIN ks USING (owner)),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY owner ORDER BY score DESC, pos, path, excerpt) = 1),
te AS (SELECT doc_id AS owner, text, {_KEPT.format("coalesce(text, '')")} AS s FROM documents WHERE doc_id NOT IN (SELECT owner FROM en) AND trim(coalesce(text, '')) <> ''),
se AS (SELECT owner, unnest(x[1:20]) AS s, unnest(range(least(len(x), 20))) AS p FROM (SELECT owner, CASE WHEN len(s) > 0 THEN s ELSE [substr(trim(text), 1, 220)] END AS x FROM te)),
sp AS (SELECT owner, p, trim(substr(s, 1, 220)) AS excerpt, {_HITS("s")} AS score FROM se LEFT JOIN ks USING (owner)), sb AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY owner ORDER BY score DESC, p) = 1)
SELECT owner, md5(path) AS path_md5, md5(trim(coalesce(excerpt, ''))) AS excerpt_md5, CAST(score AS INT) AS score FROM be UNION ALL SELECT owner, md5('ProjectExcerpt'), md5(excerpt), CAST(score AS INT) FROM sb""",
    "r14_sourced_quotes": _quotes(True),
    "r14_quotes": _quotes(False),
    "g23_topics": f"""WITH {caserules._VARIED}, {caserules._MEMBERS}, x AS (SELECT id, doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS x FROM n), f AS (SELECT id, {', '.join(f'{_SET(w)} AS t_{t}' for t, w in TOPICS.items())} FROM x),
h AS (SELECT edge_id, {', '.join(f'bool_or(t_{t}) AS t_{t}' for t in TOPICS)} FROM mem JOIN f USING (id) GROUP BY edge_id), e AS (SELECT 'e' || doc_id AS edge_id, x FROM x WHERE doc_id % 10 = 0)
{' UNION ALL '.join(map(_intent, INTENTS))}""",
}
