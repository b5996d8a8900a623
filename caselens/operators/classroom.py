"""Class analytics over an interaction log.

``log``: student, project, class_name, seq (file order), ts, rule_id, severity,
stage, score. One row for each triggered rule of an interaction; rule_id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.json import resolve_class

ALL_CLASSES = "全部班级"
HEALTHY = "✅ 健康"
#: Dimension of each rule; what is missing is "Other".
DIMENSIONS = {
    "H1": "商业", "H4": "商业", "H8": "商业", "H2": "同理", "H5": "同理", "H3": "创意", "H7": "创意", "H6": "逻辑", "H14": "逻辑", "H15": "逻辑", "H9": "执行", "H10": "执行", "H11": "执行",
}


def in_class(log: DataFrame, selected: str = ALL_CLASSES) -> DataFrame:
    """P5."""
    return log if selected == ALL_CLASSES else log.where(F.col("class_name") == selected)


def dimension(rule_id: Column) -> Column:
    """J11. The rule's dimension by a constant map."""
    table = F.create_map(*(F.lit(x) for kv in DIMENSIONS.items() for x in kv))
    return F.coalesce(table[rule_id], F.lit("Other"))


def rule_number(rule_id: Column) -> Column:
    return F.regexp_extract(rule_id, "([0-9]+)$", 1).cast("int")


def rule_frame(log: DataFrame, selected: str = ALL_CLASSES) -> DataFrame:
    """C11, P6. Rows of H rules with their dimension."""
    rows = in_class(log, selected).withColumn("rule_id", F.upper("rule_id"))
    return rows.where(F.col("rule_id").startswith("H")).withColumn("dimension", dimension(F.col("rule_id")))


def top_mistakes(log: DataFrame, n: int = 5) -> DataFrame:
    """A8. The ``n`` most frequent rules; ties by rule id."""
    return log.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "rule_id").limit(n)


def latest_state(log: DataFrame) -> DataFrame:
    """W1, C10. Of each student the last non-null stage, score and project by seq,
    the number of rows and of rules, and the distinct rule ids in order."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq")))
    return log.groupBy("student").agg(
        *(last(c).alias(f"latest_{c}") for c in ("stage", "score", "project", "class_name")),
        F.max("ts").alias("latest_ts"),
        F.count("*").alias("n_rows"),
        F.count("rule_id").alias("n_rules"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rule_ids"),
    )


def latest_rules(log: DataFrame, recent: int = 3) -> DataFrame:
    """The distinct rules of each student's ``recent`` last rows: the current diagnosis."""
    by = Window.partitionBy("student").orderBy(F.desc("seq"))
    return log.withColumn("back", F.row_number().over(by)).where(F.col("back") <= recent).where("rule_id IS NOT NULL").select("student", "rule_id").distinct()


def risk_distribution(current: DataFrame, names: int = 6) -> DataFrame:
    """A9. Of the students with a diagnosis, how many have each rule: hit_count,
    hit_rate (4 decimals), hit_rate_pct (1) and the first student names in order."""
    total = current.agg(F.count_distinct("student").alias("students"))
    by = Window.partitionBy("rule_id").orderBy("student")
    named = current.withColumn("place", F.row_number().over(by))
    rows = named.groupBy("rule_id").agg(
        F.count("*").alias("hit_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= names, F.col("student")))), lambda x: x.cast("string")), ",").alias("students_preview")
    )  # at most ``names`` of each rule are collected
    rate = F.col("hit_count").cast("decimal(18,6)") / F.col("students")
    return rows.join(F.broadcast(total), F.lit(True)).select("rule_id", "hit_count", "students_preview", F.round(rate, 4).cast("double").alias("hit_rate"), F.round(rate * 100, 1).cast("double").alias("hit_rate_pct"))


def kpis(log: DataFrame) -> DataFrame:
    """A10. One row: hits, high-risk hits and their share, projects, students covered."""
    hit, high = F.col("rule_id").isNotNull(), F.col("severity") == "High"
    return log.agg(
        F.count_if(hit).alias("hits"), F.count_if(hit & high).alias("high_hits"),
        F.round(F.count_if(hit & high).cast("decimal(18,6)") / F.greatest(F.count_if(hit), F.lit(1)), 4).cast("double").alias("high_ratio"),
        F.count_distinct("project").alias("projects"), F.count_distinct(F.when(hit, F.col("student"))).alias("students_hit"), F.count_distinct("student").alias("students"),
    )


def dimension_scale(frame: DataFrame) -> DataFrame:
    """A11. Hits of each dimension, also as a share of the largest."""
    counted = frame.groupBy("dimension").agg(F.count("*").alias("hits"))
    return counted.select("dimension", "hits", F.round(F.col("hits").cast("decimal(18,6)") / F.max("hits").over(Window.partitionBy()), 4).cast("double").alias("scaled"))


def risk_level(score: Column, h1: Column, h8: Column, most: Column) -> Column:
    """C7."""
    return F.when((score < 3) | (h1 > 2) | (h8 > 2), "high").when((score < 4) | (most > 1), "medium").otherwise("low")


def roster(log: DataFrame, state: DataFrame, current: DataFrame) -> DataFrame:
    """C7, C8, K6. Each student's rule counts, of the current diagnosis and of the
    history together, the top three rules and the risk level."""
    hits = log.where("rule_id IS NOT NULL").select("student", "rule_id").unionAll(current.select("student", "rule_id"))
    counted = hits.groupBy("student", "rule_id").agg(F.count("*").alias("n"))
    by = Window.partitionBy("student").orderBy(F.desc("n"), rule_number(F.col("rule_id")))
    ranked = counted.withColumn("place", F.row_number().over(by))
    of = lambda r: F.coalesce(F.max(F.when(F.col("rule_id") == r, F.col("n"))), F.lit(0))
    per = ranked.groupBy("student").agg(
        of("H1").alias("h1"), of("H8").alias("h8"), F.max("n").alias("most"), F.sum("n").alias("risk_index"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "rule_id")))), lambda x: x["rule_id"]), ",").alias("top_rules"),
    )
    zero = F.lit(0)
    joined = state.join(per, "student", "left")
    c = lambda n: F.coalesce(F.col(n), zero)
    return joined.select("student", "latest_class_name", "latest_project", "latest_score", c("risk_index").alias("risk_index"), F.coalesce("top_rules", F.lit("")).alias("top_rules"), risk_level(F.col("latest_score"), c("h1"), c("h8"), c("most")).alias("risk_level"))


def team_rollup(students: DataFrame) -> DataFrame:
    """A12. Members, mean score, summed risk and distinct tags without the healthy one, of each project."""
    return students.groupBy("latest_project").agg(
        F.count("*").alias("members"), F.round(F.avg(F.col("latest_score").cast("decimal(18,6)")), 2).cast("double").alias("mean_score"), F.sum("risk_index").alias("risk_index"),
        F.array_join(F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set(F.split("top_rules", ",")))), F.array(F.lit(HEALTHY), F.lit("")))), ",").alias("tags"),
    )


def class_cluster(log: DataFrame, rule: str = "H10") -> DataFrame:
    """A13. Students of each class and the share with ``rule``."""
    per = log.groupBy("class_name", "student").agg(F.bool_or(F.coalesce(F.col("rule_id") == rule, F.lit(False))).alias("failed"))
    return per.groupBy("class_name").agg(F.count("*").alias("students"), F.count_if("failed").alias("failed"), F.round(F.avg(F.col("failed").cast("int").cast("decimal(18,6)")), 4).cast("double").alias("rate"))


def class_members(log: DataFrame) -> DataFrame:
    """A22, C12. Distinct students of each class."""
    return log.groupBy("class_name").agg(F.count_distinct("student").alias("students"))


def dominant_rules(distribution: DataFrame, share: float = 0.5) -> DataFrame:
    """C9. Rules that more than ``share`` of the students have."""
    return distribution.where(F.col("hit_rate") > share)


def last_messages(messages: DataFrame, k: int = 8) -> DataFrame:
    """W2. The last ``k`` messages of a conversation, then those with a known role and a text."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("back", F.row_number().over(by)).where(F.col("back") <= k)
    return last.where(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).select("conv_id", "turn", "role", "text")


def first_turns(log: DataFrame, session: str, order: list[str], n: int = 3) -> DataFrame:
    """W3. The first ``n`` rows of a session; ``n`` is held in 1 to 50."""
    return log.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("place") <= max(1, min(50, n)))


def latest_texts(messages: DataFrame) -> DataFrame:
    """W4. The latest text of each role in a conversation."""
    last = lambda r: F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    return messages.groupBy("conv_id").agg(*(last(r).alias(f"latest_{r}") for r in ("user", "assistant", "system")))


def stage_progress(messages: DataFrame, diagnosed: Column | None = None) -> DataFrame:
    """W5. Stage index after each turn: 1 from two user turns or a diagnosis on, 2 from three; it never falls."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    users = F.count_if(F.col("role") == "user").over(by)
    now = F.when(users >= 3, 2).when((users >= 2) | (F.lit(False) if diagnosed is None else diagnosed), 1).otherwise(0)
    return messages.withColumn("now", now).withColumn("stage", F.max("now").over(by)).drop("now")


def pending(queue: DataFrame, k: int = 1) -> DataFrame:
    """W6. The ``k`` (held in 1 to 20) oldest pending rows of each target."""
    by = Window.partitionBy("target_id").orderBy("ts", "id")
    return queue.where("status = 'pending'").withColumn("place", F.row_number().over(by)).where(F.col("place") <= max(1, min(20, k)))


def handovers(messages: DataFrame) -> DataFrame:
    """W10. Turns whose role differs from the one before."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("from_role", before).where("from_role IS NOT NULL AND from_role <> role").select("conv_id", "turn", "from_role", F.col("role").alias("to_role"))


def highest_severity(results: DataFrame) -> DataFrame:
    """K7. Of each student the most severe rule, the first by number among equals."""
    weight = F.create_map(*(F.lit(x) for kv in {"High": 3, "Warning": 2, "Info": 1}.items() for x in kv))[F.col("severity")]
    return results.groupBy("student").agg(F.max_by(F.struct("rule_id", "severity"), F.struct(weight.alias("w"), (-rule_number(F.col("rule_id"))).alias("n"))).alias("x")).select("student", "x.*")


def flatten_behaviour(records: DataFrame) -> DataFrame:
    """P7, C11. The log of behaviour records (level, message, details as JSON text,
    seq): INFO rows only, one row for each diagnostic, or one without rule."""
    d = F.col("details")
    get = lambda k: F.nullif(F.trim(F.get_json_object(d, f"$.{k}")), F.lit(""))
    project = F.coalesce(get("project_name"), get("project_upload_name"))
    key = F.coalesce(get("user_id"), get("project_id"), project, F.concat(F.lit("log_student_"), F.col("seq").cast("string")))
    found = F.from_json(F.get_json_object(d, "$.diagnostic_results"), "array<struct<rule_id:string,severity:string>>")
    rows = records.where((F.upper(F.trim("level")) == "INFO") & d.isNotNull()).select(
        key.alias("student"), F.coalesce(get("project_id"), project).alias("project"), resolve_class(d).alias("class_name"), "seq", get("timestamp").alias("ts"), get("stage").alias("stage"),
        F.get_json_object(d, "$.score_snapshot.overall_score").cast("double").alias("score"), F.filter(F.coalesce(found, F.array().cast("array<struct<rule_id:string,severity:string>>")), lambda x: F.coalesce(F.trim(x["rule_id"]), F.lit("")) != "").alias("found"),
    )
    return rows.select("*", F.explode_outer("found").alias("x")).withColumns({"rule_id": F.upper(F.trim("x.rule_id")), "severity": F.col("x.severity")}).drop("found", "x")


def teacher_rubric(primary: DataFrame, legacy: DataFrame) -> DataFrame:
    """C13. student, criterion, score: the primary rows, or the legacy ones of students without any."""
    cols = ["student", "criterion", "score"]
    return primary.select(*cols).union(legacy.join(primary.select("student").distinct(), "student", "left_anti").select(*cols))


def drilldown(state: DataFrame, scores: DataFrame) -> DataFrame:
    """C14. student, n_rules, latest_stage and the mean of the scores, null if not scored."""
    mean = scores.groupBy("student").agg(F.round(F.avg(F.col("score").cast("decimal(18,6)")), 2).cast("double").alias("mean_score"))
    return state.join(mean, "student", "left").select("student", "n_rules", "latest_stage", "mean_score")


def newest_profiles(profiles: DataFrame, errors: DataFrame, most: int = 5) -> DataFrame:
    """K4. ``profiles`` (student, label, latest_ts) by latest time, then label, both
    descending, with ``common_errors``: the ``most`` most frequent of ``errors``
    (student, error, count, place), the earlier of equals first."""
    by = Window.partitionBy("student").orderBy(F.desc("count"), "place")
    top = errors.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
    lists = top.groupBy("student").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "error"))), lambda x: x["error"]).alias("common_errors"))
    joined = profiles.join(lists, "student", "left").withColumn("common_errors", F.coalesce("common_errors", F.array().cast("array<string>")))
    return joined.orderBy(F.desc("latest_ts"), F.desc("label"))


def top_risks(distribution: DataFrame, n: int = 5) -> DataFrame:
    """K5. The first ``n`` rows of a risk distribution: most hits first, then the rule."""
    return distribution.orderBy(F.desc("hit_count"), "rule_id").limit(n)


def sync_cards(cards: DataFrame, active: DataFrame, current: DataFrame, most: int = 5) -> DataFrame:
    """J14. The task cards of each owner after their next step came in.

    cards: owner, card_id, rule_id, task_text, severity, completed, urgent, place;
    active: owner, rule_id; current: owner, rule_id (null if unknown), task_text, severity.
    A card with a rule is done once its rule is not active. The next step's card
    takes the place of the one with its id (its rule, else a digest of its text), or
    comes first; ``most`` cards of an owner stay.
    """
    key = lambda c: F.nullif(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    on = active.select("owner", key(F.col("rule_id")).alias("__rule")).where("__rule IS NOT NULL").distinct()
    step = current.where(F.trim("task_text") != "").select("owner", key(F.col("rule_id")).alias("rule_id"), F.trim("task_text").alias("task_text"), "severity")
    step = step.withColumn("card_id", F.coalesce("rule_id", F.substring(F.sha1("task_text"), 1, 12)))
    urgent = (F.lower(F.trim(F.coalesce("severity", F.lit("")))) == "high") | F.coalesce(F.col("rule_id").isin("H4", "H8"), F.lit(False))
    step = step.select("owner", "card_id", "rule_id", "task_text", "severity", F.lit(False).alias("completed"), urgent.alias("urgent"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("is_current"))
    both = cards.withColumn("place", F.col("place").cast("long")).withColumn("is_current", F.lit(False)).unionByName(step)
    same = Window.partitionBy("owner", "card_id")
    # the place of the card that is replaced, else the first one
    both = both.withColumn("place", F.coalesce(F.min(F.when(~F.col("is_current"), F.col("place"))).over(same), F.lit(0).cast("long")))
    both = both.withColumn("n", F.row_number().over(same.orderBy(F.desc("is_current")))).where("n = 1").drop("n")
    known = both.join(on, (both["owner"] == on["owner"]) & (key(both["rule_id"]) == on["__rule"]), "left").drop(on["owner"])
    done = F.when(key(F.col("rule_id")).isNotNull(), F.col("__rule").isNull()).otherwise(F.col("completed"))
    ranked = known.withColumn("completed", done).drop("__rule").withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("place", "card_id")))
    return ranked.where(F.col("place") <= most)
