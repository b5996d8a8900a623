"""Class analytics over the event table: a user is a student, an event type a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens import bindings
from caselens.operators import classroom as C
from caselens.operators import scoring
from caselens.sources import files

LOG_SQL = """log AS (
SELECT user_id AS student, user_id % 20 AS project, 'C' || CAST(user_id % 5 AS VARCHAR) AS class_name, event_id AS seq, ts,
  CASE event_type WHEN 'view' THEN 'H1' WHEN 'click' THEN 'H4' WHEN 'purchase' THEN 'H8' WHEN 'error' THEN 'H10' WHEN 'signup' THEN 'H13' END AS rule_id,
  CASE WHEN event_type IN ('view','click','error') THEN 'High' ELSE 'Warning' END AS severity,
  CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS stage, CAST(value % 5 AS DECIMAL(18,6)) AS score FROM events)"""
CURRENT_SQL = """cur AS (SELECT DISTINCT student, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY seq DESC) AS b FROM log) WHERE b <= 3 AND rule_id IS NOT NULL)"""
STATE_SQL = """st AS (SELECT student, max_by(stage, CASE WHEN stage IS NOT NULL THEN seq END) AS latest_stage, max_by(score, CASE WHEN score IS NOT NULL THEN seq END) AS latest_score, max_by(project, seq) AS latest_project, max_by(class_name, seq) AS latest_class_name,
max(ts) AS latest_ts, count(*) AS n_rows, count(rule_id) AS n_rules, array_to_string(list_sort(list(DISTINCT rule_id) FILTER (rule_id IS NOT NULL)), ',') AS rule_ids FROM log GROUP BY student)"""
ROSTER_SQL = """hits AS (SELECT student, rule_id FROM log WHERE rule_id IS NOT NULL UNION ALL SELECT student, rule_id FROM cur),
n AS (SELECT student, rule_id, count(*) AS n FROM hits GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY n DESC, CAST(substr(rule_id, 2) AS INT)) AS p FROM n),
per AS (SELECT student, coalesce(max(n) FILTER (rule_id = 'H1'), 0) AS h1, coalesce(max(n) FILTER (rule_id = 'H8'), 0) AS h8, max(n) AS most, sum(n) AS risk_index, string_agg(rule_id, ',' ORDER BY p) FILTER (p <= 3) AS top_rules FROM rk GROUP BY student),
ro AS (SELECT student, latest_class_name, latest_project, latest_score, CAST(coalesce(risk_index, 0) AS BIGINT) AS risk_index, coalesce(top_rules, '') AS top_rules,
CASE WHEN latest_score < 3 OR coalesce(h1, 0) > 2 OR coalesce(h8, 0) > 2 THEN 'high' WHEN latest_score < 4 OR coalesce(most, 0) > 1 THEN 'medium' ELSE 'low' END AS risk_level FROM st LEFT JOIN per USING (student))"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, kind = F.col, F.col("event_type")
    rule = F.when(kind == "view", "H1").when(kind == "click", "H4").when(kind == "purchase", "H8").when(kind == "error", "H10").when(kind == "signup", "H13")
    return bindings.read(spark, sf_dir, "events").select(
        c("user_id").alias("student"), (c("user_id") % 20).alias("project"), F.concat(F.lit("C"), (c("user_id") % 5).cast("string")).alias("class_name"), c("event_id").alias("seq"), "ts", rule.alias("rule_id"),
        F.when(kind.isin("view", "click", "error"), "High").otherwise("Warning").alias("severity"), F.when(kind != "signup", kind).alias("stage"), (c("value") % 5).cast("decimal(18,6)").alias("score"),
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.read(spark, sf_dir, "conversations")


def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return C.roster(rows, C.latest_state(rows), C.latest_rules(rows))


def a8_top_mistakes(spark, sf_dir):
    return C.top_mistakes(log(spark, sf_dir))


def a9_risk_distribution(spark, sf_dir):
    return C.risk_distribution(C.latest_rules(log(spark, sf_dir)))


def a10_kpis(spark, sf_dir):
    return C.kpis(log(spark, sf_dir))


def a11_dimension_scale(spark, sf_dir):
    return C.dimension_scale(C.rule_frame(log(spark, sf_dir)))


def a12_team_rollup(spark, sf_dir):
    return C.team_rollup(_roster(spark, sf_dir))


def a13_class_cluster(spark, sf_dir):
    return C.class_cluster(log(spark, sf_dir))


def a22_class_members(spark, sf_dir):
    return C.class_members(log(spark, sf_dir))


def c8_roster(spark, sf_dir):
    return _roster(spark, sf_dir)


def c9_dominant_rules(spark, sf_dir):
    return C.dominant_rules(C.risk_distribution(C.latest_rules(log(spark, sf_dir))), 0.4).select("rule_id", "hit_count")


def c10_profiles(spark, sf_dir):
    return C.latest_state(log(spark, sf_dir))


def c11_rule_frame(spark, sf_dir):
    return C.rule_frame(log(spark, sf_dir), "C1").select("student", "seq", "rule_id", "dimension")


def k7_highest_severity(spark, sf_dir):
    return C.highest_severity(log(spark, sf_dir).where("rule_id IS NOT NULL"))


def w2_last_messages(spark, sf_dir):
    return C.last_messages(_messages(spark, sf_dir), 4).select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


def w3_first_turns(spark, sf_dir):
    return C.first_turns(_messages(spark, sf_dir), "conv_id", ["turn", "role"]).select("conv_id", "turn", "place")


def w4_latest_texts(spark, sf_dir):
    return C.latest_texts(_messages(spark, sf_dir))


def w5_stage_progress(spark, sf_dir):
    return C.stage_progress(_messages(spark, sf_dir)).select("conv_id", "turn", "stage")


def w6_pending(spark, sf_dir):
    queue = bindings.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("target_id"), "ts", F.when(F.col("event_type") == "error", "pending").otherwise("executed").alias("status"))
    return C.pending(queue, 2).select("target_id", "id", "place")


def w10_handovers(spark, sf_dir):
    return C.handovers(_messages(spark, sf_dir))


def k4_profiles(spark, sf_dir):
    rows = log(spark, sf_dir)
    errors = rows.where("rule_id IS NOT NULL").groupBy("student", F.col("rule_id").alias("error")).agg(F.count("*").alias("count"), F.min("seq").alias("place"))
    profiles = rows.groupBy("student").agg(F.max("ts").alias("latest_ts")).withColumn("label", F.col("student").cast("string"))
    return C.newest_profiles(profiles, errors, 3).select("student", F.date_format("latest_ts", "yyyy-MM-dd HH:mm:ss").alias("latest"), F.array_join("common_errors", ",").alias("common_errors"))


def k5_top_risks(spark, sf_dir):
    return C.top_risks(C.risk_distribution(C.latest_rules(log(spark, sf_dir))), 3).select("rule_id", "hit_count")


def j14_task_cards(spark, sf_dir):
    """A card for each rule of a student, in order of its first hit; the last row is the next step."""
    rows = log(spark, sf_dir)
    first = rows.where("rule_id IS NOT NULL").groupBy(F.col("student").alias("owner"), "rule_id").agg(F.min("seq").alias("place"), F.min("severity").alias("severity"))
    cards = first.select("owner", F.col("rule_id").alias("card_id"), "rule_id", F.concat(F.lit("fix "), "rule_id").alias("task_text"), "severity", F.lit(False).alias("completed"), F.lit(False).alias("urgent"), "place")
    active = C.latest_rules(rows).withColumnRenamed("student", "owner")
    last = rows.groupBy(F.col("student").alias("owner")).agg(F.max(F.struct("seq", "rule_id", "severity")).alias("x"))
    text = F.concat(F.lit("step "), (F.col("x.seq") % 7).cast("string"))
    current = last.select("owner", F.when(F.col("x.seq") % 3 > 0, F.col("x.rule_id")).alias("rule_id"), text.alias("task_text"), "x.severity")
    return C.sync_cards(cards, active, current).select("owner", "card_id", "task_text", "severity", "completed", "urgent", "is_current", "place")


def s19_scores(spark, sf_dir):
    projects = bindings.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"), F.array(F.col("s_acctbal").cast("double")).alias("scores"))
    changes = bindings.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_suppkey") * 3).alias("project_id"), F.array(F.col("l_quantity").cast("double")).alias("scores"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return files.overwrite_scores(projects, changes).select("project_id", F.col("scores")[0].alias("score"))


def _diagnostics(spark, sf_dir):
    rows = log(spark, sf_dir).where("rule_id IS NOT NULL")
    status = F.element_at(F.array(*map(F.lit, ("FAILED", "warning", " Passed ", "odd"))), (F.col("seq") % 4 + 1).cast("int"))
    return rows.select(F.col("student").alias("owner"), F.lower("rule_id").alias("rule_id"), status.alias("status"), "seq")


def c3_ability_report(spark, sf_dir):
    owners = bindings.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"))
    return scoring.ability_report(owners, _diagnostics(spark, sf_dir))


def c3_ability_average(spark, sf_dir):
    return scoring.ability_average(c3_ability_report(spark, sf_dir))


def c4_audit_trail(spark, sf_dir):
    """Each row of the report with the owner's last quote and first card, from the events' properties and orders."""
    quotes = bindings.read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("props").alias("quote"), F.col("event_id").alias("place"))
    cards = bindings.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.concat(F.lit("K"), "o_orderkey").alias("card_id"), F.col("o_orderkey").alias("place"))
    return scoring.audit_trail(c3_ability_report(spark, sf_dir), quotes, cards).select("owner", "item_id", "rule_id", "quote", "card_id")


QUERIES = {f.__name__: f for f in (
    k4_profiles, k5_top_risks, j14_task_cards, s19_scores, c3_ability_report, c3_ability_average, c4_audit_trail,
    a8_top_mistakes, a9_risk_distribution, a10_kpis, a11_dimension_scale, a12_team_rollup, a13_class_cluster, a22_class_members, c8_roster, c9_dominant_rules, c10_profiles, c11_rule_frame,
    k7_highest_severity, w2_last_messages, w3_first_turns, w4_latest_texts, w5_stage_progress, w6_pending, w10_handovers,
)}

_DIM = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.DIMENSIONS.items()) + " ELSE 'Other' END"
_DIST = """tot AS (SELECT count(DISTINCT student) AS t FROM cur), pl AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY student) AS p FROM cur),
dist AS (SELECT rule_id, count(*) AS hit_count, string_agg(CAST(student AS VARCHAR), ',' ORDER BY student) FILTER (p <= 6) AS students_preview,
CAST(round(CAST(count(*) AS DECIMAL(18,6)) / any_value(t), 4) AS DOUBLE) AS hit_rate, CAST(round(CAST(count(*) AS DECIMAL(18,6)) / any_value(t) * 100, 1) AS DOUBLE) AS hit_rate_pct FROM pl, tot GROUP BY rule_id)"""

ORACLE_SQL = {
    "a8_top_mistakes": f"WITH {LOG_SQL} SELECT rule_id, count(*) AS hits FROM log WHERE rule_id IS NOT NULL GROUP BY rule_id ORDER BY hits DESC, rule_id LIMIT 5",
    "a9_risk_distribution": f"WITH {LOG_SQL}, {CURRENT_SQL}, {_DIST} SELECT * FROM dist",
    "a10_kpis": f"""WITH {LOG_SQL} SELECT count(rule_id) AS hits, count(*) FILTER (rule_id IS NOT NULL AND severity = 'High') AS high_hits,
CAST(round(CAST(count(*) FILTER (rule_id IS NOT NULL AND severity = 'High') AS DECIMAL(18,6)) / greatest(count(rule_id), 1), 4) AS DOUBLE) AS high_ratio,
count(DISTINCT project) AS projects, count(DISTINCT student) FILTER (rule_id IS NOT NULL) AS students_hit, count(DISTINCT student) AS students FROM log""",
    "a11_dimension_scale": f"WITH {LOG_SQL}, d AS (SELECT {_DIM} AS dimension, count(*) AS hits FROM log WHERE rule_id LIKE 'H%' GROUP BY 1) SELECT dimension, hits, CAST(round(CAST(hits AS DECIMAL(18,6)) / max(hits) OVER (), 4) AS DOUBLE) AS scaled FROM d",
    "a12_team_rollup": f"""WITH {LOG_SQL}, {CURRENT_SQL}, {STATE_SQL}, {ROSTER_SQL}, t AS (SELECT latest_project, array_to_string(list_sort(list(DISTINCT x)), ',') AS tags FROM (SELECT latest_project, unnest(string_split(top_rules, ',')) AS x FROM ro) WHERE x <> '' GROUP BY 1)
SELECT latest_project, count(*) AS members, CAST(round(avg(CAST(latest_score AS DOUBLE)), 2) AS DOUBLE) AS mean_score, CAST(sum(risk_index) AS BIGINT) AS risk_index, coalesce(any_value(tags), '') AS tags FROM ro LEFT JOIN t USING (latest_project) GROUP BY latest_project""",
    "a13_class_cluster": f"""WITH {LOG_SQL}, p AS (SELECT class_name, student, bool_or(coalesce(rule_id = 'H10', false)) AS failed FROM log GROUP BY ALL)
SELECT class_name, count(*) AS students, count(*) FILTER (failed) AS failed, CAST(round(avg(CAST(failed AS INT)), 4) AS DOUBLE) AS rate FROM p GROUP BY class_name""",
    "a22_class_members": f"WITH {LOG_SQL} SELECT class_name, count(DISTINCT student) AS students FROM log GROUP BY class_name",
    "c8_roster": f"WITH {LOG_SQL}, {CURRENT_SQL}, {STATE_SQL}, {ROSTER_SQL} SELECT * FROM ro",
    "c9_dominant_rules": f"WITH {LOG_SQL}, {CURRENT_SQL}, {_DIST} SELECT rule_id, hit_count FROM dist WHERE hit_rate > 0.4",
    "c10_profiles": f"WITH {LOG_SQL}, {STATE_SQL} SELECT * FROM st",
    "c11_rule_frame": f"WITH {LOG_SQL} SELECT student, seq, rule_id, {_DIM} AS dimension FROM log WHERE class_name = 'C1' AND rule_id LIKE 'H%'",
    "k7_highest_severity": f"""WITH {LOG_SQL}, r AS (SELECT student, rule_id, severity, row_number() OVER (PARTITION BY student ORDER BY CASE severity WHEN 'High' THEN 3 WHEN 'Warning' THEN 2 ELSE 1 END DESC, CAST(substr(rule_id, 2) AS INT)) AS p FROM log WHERE rule_id IS NOT NULL)
SELECT student, rule_id, severity FROM r WHERE p = 1""",
    "w2_last_messages": "SELECT conv_id, turn, role, CAST(length(text) AS INT) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4 AND role IN ('user', 'assistant') AND trim(text) <> ''",
    "w3_first_turns": "SELECT conv_id, turn, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS p FROM conversations) WHERE p <= 3",
    "w4_latest_texts": "SELECT conv_id, " + ", ".join(f"max_by(text, turn) FILTER (role = '{r}') AS latest_{r}" for r in ("user", "assistant", "system")) + " FROM conversations GROUP BY conv_id",
    "w5_stage_progress": "SELECT conv_id, turn, CAST(CASE WHEN u >= 3 THEN 2 WHEN u >= 2 THEN 1 ELSE 0 END AS INT) AS stage FROM (SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS u FROM conversations)",
    "w6_pending": "SELECT user_id AS target_id, event_id AS id, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type = 'error') WHERE p <= 2",
    "w10_handovers": "SELECT conv_id, turn, f AS from_role, role AS to_role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations) WHERE f IS NOT NULL AND f <> role",
}

_DIMENSIONS = ", ".join(f"('{d}', '{r}', '{i}')" for d, r, i in scoring.ABILITY)
_REPORT = f"""{LOG_SQL}, dg AS (SELECT student, rule_id, max_by((['FAILED', 'warning', ' Passed ', 'odd'])[seq % 4 + 1], seq) AS status FROM log WHERE rule_id IS NOT NULL GROUP BY ALL),
sc AS (SELECT c_custkey AS owner, d.*, dg.status FROM customer CROSS JOIN (VALUES {_DIMENSIONS}) d(dimension, rule_id, item_id) LEFT JOIN dg ON dg.student = c_custkey AND dg.rule_id = d.rule_id),
rp AS (SELECT owner, dimension, item_id, rule_id, coalesce(status, 'WARNING') AS status, CASE status WHEN 'FAILED' THEN 1.0 WHEN 'warning' THEN 2.5 WHEN ' Passed ' THEN 4.5 ELSE 3.0 END AS score_5 FROM sc
UNION ALL SELECT c_custkey, '证据溯源', 'R9', 'AUDIT', 'BOUND', 4.5 FROM customer)"""
ORACLE_SQL |= {
    "k4_profiles": f"""WITH {LOG_SQL}, e AS (SELECT student, rule_id, row_number() OVER (PARTITION BY student ORDER BY count(*) DESC, min(seq)) AS n FROM log WHERE rule_id IS NOT NULL GROUP BY student, rule_id)
SELECT student, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, coalesce((SELECT string_agg(rule_id, ',' ORDER BY n) FROM e WHERE e.student = log.student AND n <= 3), '') AS common_errors FROM log GROUP BY student""",
    "k5_top_risks": f"WITH {LOG_SQL}, {CURRENT_SQL} SELECT rule_id, count(*) AS hit_count FROM cur GROUP BY rule_id ORDER BY hit_count DESC, rule_id LIMIT 3",
    "j14_task_cards": f"""WITH {LOG_SQL}, {CURRENT_SQL}, c AS (SELECT student AS owner, rule_id AS card_id, rule_id, 'fix ' || rule_id AS task_text, min(severity) AS severity, min(seq) AS place FROM log WHERE rule_id IS NOT NULL GROUP BY student, rule_id),
l AS (SELECT student AS owner, arg_max(CASE WHEN seq % 3 > 0 THEN struct_pack(r := rule_id) ELSE struct_pack(r := NULL) END, seq).r AS rule_id, 'step ' || (max(seq) % 7) AS task_text, max_by(severity, seq) AS severity FROM log GROUP BY student),
s AS (SELECT *, coalesce(rule_id, substr(sha1(task_text), 1, 12)) AS card_id FROM l),
u AS (SELECT c.owner, c.card_id, c.rule_id, c.task_text, c.severity, false AS urgent, false AS is_current, place FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.owner = c.owner AND s.card_id = c.card_id)
UNION ALL SELECT s.owner, s.card_id, s.rule_id, s.task_text, s.severity, lower(s.severity) = 'high' OR coalesce(s.rule_id IN ('H4', 'H8'), false), true, coalesce(c.place, 0) FROM s LEFT JOIN c ON c.owner = s.owner AND c.card_id = s.card_id),
k AS (SELECT owner, card_id, task_text, severity, rule_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.student = u.owner AND cur.rule_id = u.rule_id) AS completed, urgent, is_current, CAST(row_number() OVER (PARTITION BY owner ORDER BY place, card_id) AS INT) AS place FROM u)
SELECT * FROM k WHERE place <= 5""",
    "s19_scores": """WITH c AS (SELECT l_suppkey * 3 AS k, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey AS project_id, CAST(coalesce(q, s_acctbal) AS DOUBLE) AS score FROM supplier LEFT JOIN c ON k = s_suppkey""",
    "c3_ability_report": f"WITH {_REPORT} SELECT owner, dimension, item_id, rule_id, status, CAST(score_5 AS DOUBLE) AS score_5 FROM rp",
    "c3_ability_average": f"WITH {_REPORT} SELECT owner, CAST(round(CAST(avg(score_5) AS DECIMAL(18,6)), 2) AS DOUBLE) AS average_score_5 FROM rp GROUP BY owner",
    "c4_audit_trail": f"""WITH {_REPORT}, q AS (SELECT user_id, substr(max_by(props, event_id), 1, 120) AS quote FROM events GROUP BY 1), k AS (SELECT o_custkey, 'K' || min(o_orderkey) AS card_id FROM orders GROUP BY 1)
SELECT owner, item_id, rule_id, coalesce(quote, '未提供可引用原文。') AS quote, coalesce(card_id, 'KG_CARD_UNBOUND') AS card_id FROM rp LEFT JOIN q ON user_id = owner LEFT JOIN k ON o_custkey = owner""",
}
