"""Rubric scores, ability report and contest scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import text as X

# Rubric items (weight in percent), keyword bonuses, dimensions and contest models.
RUBRIC = [("R1", "问题定义", 10), ("R2", "用户证据", 15), ("R3", "方案可行性", 10), ("R4", "商业模式一致性", 15), ("R5", "市场与竞争", 10), ("R6", "财务逻辑", 10), ("R7", "创新与差异化", 10), ("R8", "团队与执行", 5), ("R9", "展示质量", 5)]
BONUS = [(["R1", "R4"], 1.2, ["用户", "痛点", "value", "channel", "evidence"]), (["R5"], 1.0, ["竞品", "competition", "tam", "sam", "som"]), (["R6"], 1.0, ["cac", "ltv", "毛利", "回收"]), (["R8"], 0.8, ["团队", "成员", "里程碑"])]
BASE = 2.5
ABILITY = [("问题定义", "H1", "R4"), ("市场论证", "H4", "R5"), ("证据强度", "H5", "R2"), ("竞争分析", "H6", "R5"), ("财务健康", "H8", "R6")]
FORCES = ["痛点发现", "方案策划", "商业建模", "资源杠杆", "逻辑表达"]
CONTESTS = {
    "世纪杯 (学术科技类)": {"创新性": {"痛点发现": 0.7, "逻辑表达": 0.3}, "技术/科学性": {"方案策划": 0.8, "逻辑表达": 0.2}, "商业/实用性": {"商业建模": 0.7, "资源杠杆": 0.3}, "团队/社会效益": {"资源杠杆": 0.5, "逻辑表达": 0.5}},
    "“人工智能+”/机器人大赛": {"创新性": {"痛点发现": 0.6, "方案策划": 0.4}, "技术支撑": {"方案策划": 0.7, "逻辑表达": 0.3}, "应用前景": {"商业建模": 0.6, "资源杠杆": 0.4}, "团队稳定性": {"资源杠杆": 0.6, "逻辑表达": 0.4}},
    "中国国际大学生创新大赛": {"创新性": {"痛点发现": 0.5, "方案策划": 0.5}, "教育维度": {"逻辑表达": 0.8, "痛点发现": 0.2}, "商业维度": {"商业建模": 0.8, "资源杠杆": 0.2}, "社会价值": {"资源杠杆": 0.7, "逻辑表达": 0.3}},
}


def rubric_items(docs: DataFrame, bonus: list[tuple[list[str], float, list[str]]] = BONUS) -> DataFrame:
    """C1. doc_id, rule_id, score, weighted_score: nine rows for each document."""
    text = F.lower(X.lit_empty(F.col("text")))
    hit = [text.rlike(X.quoted([w.lower() for w in words])) for _, _, words in bonus]

    def item(rule: str, weight: int) -> Column:
        score = F.lit(BASE).cast("decimal(18,6)")
        for (rules, more, _), h in zip(bonus, hit):
            if rule in rules:
                score = score + F.when(h, F.lit(more)).otherwise(F.lit(0.0)).cast("decimal(18,6)")
        score = F.greatest(F.lit(0), F.least(F.lit(5), F.round(score, 2)))
        return F.struct(F.lit(rule).alias("rule_id"), score.cast("double").alias("score"), F.round(score * weight / 5, 2).cast("double").alias("weighted_score"))

    return docs.select("doc_id", F.inline(F.array(*(item(r, w) for r, _, w in RUBRIC))))


def rubric_totals(items: DataFrame) -> DataFrame:
    """C1. doc_id, weighted_percentage, overall_score and the ids of low items."""
    pct = F.sum(F.col("weighted_score").cast("decimal(18,6)"))
    return items.groupBy("doc_id").agg(
        F.round(pct, 2).cast("double").alias("weighted_percentage"), F.round(pct / 20, 2).cast("double").alias("overall_score"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("score") <= BASE, F.col("rule_id")))), ",").alias("low_items"),
    )


def rubric_table(items: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """C2, F26. owner, item, score: from rubric scores, else half of the status score."""
    a = items.select(F.col("doc_id").alias("owner"), F.col("rule_id").alias("item"), "score")
    b = diagnostics.join(a.select("owner").distinct(), "owner", "left_anti").select("owner", F.col("rule_id").alias("item"), F.round(X.status_score(F.col("status")) / 2, 2).alias("score"))
    return a.union(b)


def ability_report(owners: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """C3, J12. owner, dimension, item_id, rule_id, status, score_5: five dimensions
    by the last diagnostic of their rule, and the audit row.

    diagnostics: owner, rule_id, status, seq.
    """
    last = diagnostics.groupBy("owner", F.upper(F.trim("rule_id")).alias("rule_id")).agg(F.max_by("status", "seq").alias("status"))
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(r).alias("rule_id"), F.lit(i).alias("item_id")) for d, r, i in ABILITY))
    rows = owners.select("owner", F.inline(dims)).join(last, ["owner", "rule_id"], "left")
    score = F.when(F.col("status").isNull(), 6.0).otherwise(X.status_score(F.col("status")))
    scored = rows.select("owner", "dimension", "item_id", "rule_id", F.coalesce("status", F.lit("WARNING")).alias("status"), F.round(score / 2, 2).alias("score_5"))
    audit = owners.select("owner", F.lit("证据溯源").alias("dimension"), F.lit("R9").alias("item_id"), F.lit("AUDIT").alias("rule_id"), F.lit("BOUND").alias("status"), F.lit(4.5).alias("score_5"))
    return scored.union(audit)


def audit_trail(report: DataFrame, quotes: DataFrame, cards: DataFrame) -> DataFrame:
    """C4. Each report row with its owner's last quote (120 characters) and first card."""
    q = quotes.groupBy("owner").agg(F.substring(F.max_by("quote", "place"), 1, 120).alias("quote"))
    c = cards.groupBy("owner").agg(F.min_by("card_id", "place").alias("card_id"))
    joined = report.join(q, "owner", "left").join(c, "owner", "left")
    return joined.withColumn("quote", F.coalesce("quote", F.lit("未提供可引用原文。"))).withColumn("card_id", F.coalesce("card_id", F.lit("KG_CARD_UNBOUND")))


def ability_average(report: DataFrame) -> DataFrame:
    """C3. owner, average_score_5 over all rows."""
    return report.groupBy("owner").agg(F.round(F.avg(F.col("score_5").cast("decimal(18,6)")), 2).cast("double").alias("average_score_5"))


def contest_scores(forces: DataFrame, contest: str, id_: str = "owner") -> DataFrame:
    """C6. owner, the four dimensions and their mean by the contest's weights; an
    unknown contest takes the first model. ``forces`` has f1 to f5."""
    model = CONTESTS.get(contest, next(iter(CONTESTS.values())))
    column = {n: F.col(f"f{k}").cast("decimal(18,6)") for k, n in enumerate(FORCES, 1)}

    def one(weights: dict[str, float]) -> Column:
        total = F.lit(0).cast("decimal(18,6)")
        for n, w in weights.items():
            total = total + column[n] * F.lit(w).cast("decimal(4,2)")
        return F.round(total, 2)

    scores = [one(w) for w in model.values()]
    rows = forces.select(id_, *(s.alias(f"d{k}") for k, s in enumerate(scores, 1)))
    mean = F.round((F.col("d1") + F.col("d2") + F.col("d3") + F.col("d4")) / 4, 2)
    return rows.select(id_, *(F.col(f"d{k}").cast("double").alias(f"d{k}") for k in range(1, 5)), mean.cast("double").alias("overall"))


def coerce_rows(rows: DataFrame) -> DataFrame:
    """C5. Scores held in 0 to max_score (0.1 at least) and the rule's display form."""
    most = F.greatest(F.coalesce("max_score", F.lit(10.0)), F.lit(0.1))
    return rows.withColumn("max_score", most).withColumn("score", F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)), most)).withColumn("display", X.display_rule(F.col("rule_id"), F.col("name")))
