"""Documents to knowledge cards: labels, scenarios, industry, benchmarks, channel fit.

Dictionaries are parameters; the defaults are fixed values of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import text as X

# Keyword groups.
LABELS = {
    "B2B": ["b2b", "企业客户", "企业采购", "采购负责人"], "工业设备": ["工业设备", "压缩机", "机床", "制造业", "招投标"], "渠道策略": ["渠道", "获客", "销售渠道", "distribution", "go to market"],
    "竞品分析": ["竞品", "对标", "benchmark", "competitor"], "单位经济": ["cac", "ltv", "unit economics", "回收周期"], "校园创业": ["高校", "校园", "大学生", "社团"],
    "教育科技": ["教育", "学习", "课程", "伴学"], "SaaS": ["saas", "订阅", "续费", "座席"],
}
SCENARIOS = {
    "工业设备销售": ["工业设备", "压缩机", "工厂采购", "招投标"], "高客单价B2B": ["高客单价", "企业采购", "采购决策", "企业客户"], "校园消费": ["校园", "高校", "大学生", "社团"],
    "教育科技": ["教育", "学习", "课程", "伴学"], "SaaS 增长": ["saas", "订阅", "续费", "座席"],
}
INDUSTRIES = {
    "AI": ["ai", "人工智能", "大模型", "机器学习", "算法", "智能体", "生成式"], "跨境电商": ["跨境电商", "出海电商", "亚马逊", "temu", "shein", "独立站", "海外仓"],
    "重工业": ["重工业", "工业设备", "机床", "压缩机", "工程机械", "制造业", "工厂采购"], "教育科技": ["教育科技", "edtech", "教育", "课程", "学习平台", "伴学"],
    "医疗健康": ["医疗", "健康", "医院", "诊疗", "药械", "医药"], "企业服务": ["企业服务", "saas", "企业客户", "b2b", "协同办公", "crm", "erp"],
}
CHANNELS = {
    "社交媒体": ["社交媒体", "社媒", "微博", "微信", "公众号", "小红书"], "短视频投流": ["短视频", "短视频投流", "抖音投流", "信息流投放", "直播投流"], "直销": ["直销", "销售拜访", "顾问销售", "顾问式销售"],
    "行业展会": ["行业展会", "展会", "博览会"], "招投标": ["招投标", "投标", "招标"], "线下顾问销售": ["线下顾问销售", "线下销售", "顾问式销售", "线下面谈"],
}
METRICS = {"CAC": ["cac", "获客成本", "客户获取成本"], "LTV": ["ltv", "客户生命周期价值", "客户终身价值"], "毛利率": ["毛利率"], "转化率": ["转化率"], "留存率": ["留存率"], "客单价": ["客单价"], "回收周期": ["回收周期", "cac 回收周期"]}
BENCHMARK_CUES = ["基准", "标准", "建议", "通常", "一般", "推荐", "不低于", "不少于", "低于", "高于", "benchmark"]
GOOD_CUES, BAD_CUES = ["适合", "推荐", "优先", "宜采用", "更适合", "最佳"], ["不适合", "不宜", "避免", "慎用", "不推荐"]
LABEL_FIELDS = ["标签", "关键词", "关键字", "主题词", "labels", "keywords"]
SCENARIO_FIELDS = ["适用场景", "应用场景", "适用于", "适用对象", "scenarios"]
INDUSTRY_FIELDS = ["行业", "所属行业", "industry"]
SEGMENT_FIELDS = ["适用客户", "目标客户", "客户分层", "适用对象"]
UNITS = "%|％|元|万元|个月|月|天|倍"
COMPARATORS = ">=|<=|>|<|不少于|不低于|低于|高于|至少|至多"


def groups_found(text: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which a keyword occurs in the normalised text, in order."""
    return X.once(X.search_norm(text), lambda normed: F.array_compact(F.array(*(F.when(X.has_any(normed, w), F.lit(n)) for n, w in groups.items()))))


def labels(text: Column, groups: dict[str, list[str]] = LABELS) -> Column:
    """R1. Explicit labels, then those of the keyword groups."""
    return F.array_distinct(F.concat(X.explicit_items(text, LABEL_FIELDS), groups_found(text, groups)))


def scenarios(text: Column, found: Column, groups: dict[str, list[str]] = SCENARIOS) -> Column:
    """R2. As R1 over text and labels."""
    whole = F.concat_ws(" ", text, F.array_join(found, " "))
    return F.array_distinct(F.concat(X.explicit_items(text, SCENARIO_FIELDS), groups_found(whole, groups)))


def industry(text: Column, context: Column, groups: dict[str, list[str]] = INDUSTRIES) -> Column:
    """R3. The explicit industry, else that with most keywords in text and context,
    the first among equals; null without any."""
    scored = lambda normed: F.array(*(F.struct(X.count_hits(normed, w).alias("hits"), F.lit(-k).alias("k"), F.lit(n).alias("name")) for k, (n, w) in enumerate(groups.items())))
    # one normal form of a text for all its words
    most = X.once(X.search_norm(F.concat_ws(" ", text, context)), lambda normed: X.once(F.array_max(scored(normed)), lambda best: F.when(best["hits"] > 0, best["name"])))
    return F.coalesce(X.explicit_value(text, INDUSTRY_FIELDS), most)


def benchmarks(docs: DataFrame, metrics: dict[str, list[str]] = METRICS, cues: list[str] = BENCHMARK_CUES) -> DataFrame:
    """R4. doc_id, sentence, clause, metric, comparator, value, lower, upper, unit,
    original_text: every metric record of the clauses of cue sentences."""
    sentences = docs.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence", "s")).where(X.search_norm(F.col("s")).rlike(X.quoted(cues)))
    clauses = sentences.select("doc_id", "sentence", F.posexplode(X.trimmed(F.split("s", "[；;]"))).alias("clause", "c"))
    number = r"(\d+(?:\.\d+)?)"

    def record(norm: Column, k: int, name: str, aliases: list[str]) -> Column:
        alias = rf"(?i)(?:{X.quoted(aliases)}).{{0,12}}?"
        ranged = rf"{alias}{number}\s*({UNITS})?\s*(?:-|~|～|至|到)\s*{number}\s*({UNITS})?"
        single = rf"{alias}({COMPARATORS})?\s*{number}\s*({UNITS})?"
        get = lambda p, g: F.nullif(F.regexp_extract("c", p, g), F.lit(""))
        is_range = F.col("c").rlike(ranged)
        known = norm.rlike(X.quoted(aliases)) & (is_range | F.col("c").rlike(single))
        pick = lambda a, b: F.when(is_range, a).otherwise(b)
        none = F.lit(None)
        return F.when(known, F.struct(
            F.lit(k).alias("k"), F.lit(name).alias("metric"), pick(none.cast("string"), get(single, 1)).alias("comparator"), pick(none.cast("double"), get(single, 2).cast("double")).alias("value"),
            pick(get(ranged, 1).cast("double"), none.cast("double")).alias("lower"), pick(get(ranged, 3).cast("double"), none.cast("double")).alias("upper"),
            pick(F.coalesce(get(ranged, 2), get(ranged, 4)), get(single, 3)).alias("unit"),
        ))

    # a clause is normalised once, and no inner explode computes its array again to filter on its size
    found = X.once(X.search_norm(F.col("c")), lambda norm: F.array_compact(F.array(*(record(norm, k, n, a) for k, (n, a) in enumerate(metrics.items())))))
    return clauses.select("doc_id", "sentence", "clause", F.col("c").alias("original_text"), F.inline_outer(found)).where("metric IS NOT NULL")


def first_benchmarks(records: DataFrame) -> DataFrame:
    """R4. The first record of each metric of a document."""
    by = Window.partitionBy("doc_id", "metric").orderBy("sentence", "clause", "k")
    return records.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


def has_unit_rule(text: Column) -> Column:
    """R4. Whether the text states LTV of at least three times CAC."""
    return F.lower(X.lit_empty(text)).rlike(r"ltv.{0,10}(>=|>|不低于|至少).{0,5}3\s*[x×*]\s*cac")


def _channels_after(clause: Column, cues: list[str], stops: list[str]) -> Column:
    """Channels named after the first usable cue, up to a stopping one."""
    tail = F.lit("")
    for cue in reversed(cues):
        at = F.instr(clause, cue)
        usable = at > 0
        if cue == "适合":
            usable = usable & ~F.coalesce((at > 1) & (clause.substr(at - 1, F.lit(1)) == "不"), F.lit(False))
        tail = F.when(usable, clause.substr(at + len(cue), F.length(clause))).otherwise(tail)
    if stops:
        tail = F.regexp_replace(tail, rf"(?s)(?:{X.quoted(stops)}).*", "")
    return groups_found(tail, CHANNELS)


def channel_fit(docs: DataFrame) -> DataFrame:
    """R5, A16. doc_id, channel, fit_score, segments, scenarios, reason: the mention
    farthest from 0.5 wins, the lower among equals; the first three reasons are kept.

    ``docs``: doc_id, text, scenarios.
    """
    base = docs.select("doc_id", "text", "scenarios", X.explicit_items(F.col("text"), SEGMENT_FIELDS).alias("segments"))
    clauses = base.select("doc_id", "scenarios", "segments", F.posexplode(F.flatten(F.transform(X.sentences(F.col("text")), lambda s: X.trimmed(F.split(s, "[，,；;]"))))).alias("pos", "clause"))
    c = F.col("clause")
    tag = lambda found, score, k: F.transform(found, lambda x: F.struct(x.alias("channel"), F.lit(score).alias("score"), F.lit(k).alias("k")))
    hits = clauses.withColumn("hit", F.explode_outer(F.concat(tag(_channels_after(c, GOOD_CUES, BAD_CUES), 0.9, 0), tag(_channels_after(c, BAD_CUES, []), 0.1, 1)))).where("hit IS NOT NULL")
    strength = F.struct(F.round(F.abs(F.col("hit.score") - 0.5), 6).alias("far"), (-F.col("hit.score")).alias("low"))
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hit.k", "clause"))), lambda x: x["clause"]))
    return hits.groupBy("doc_id", F.col("hit.channel").alias("channel")).agg(
        F.max_by("hit.score", strength).alias("fit_score"), F.first("segments").alias("segments"), F.first("scenarios").alias("scenarios"), F.array_join(F.slice(reasons, 1, 3), "；").alias("reason")
    )


def card_type(text: Column, context: Column, has_channels: Column) -> Column:
    """R6. Policy, failure, channel or benchmark card, tried in this order; the words are fixed values."""
    def kind(normed: Column) -> Column:
        has = lambda *w: X.has_any(normed, w)
        policy = has("政策", "条例", "办法", "规范", "指南", "国标", "标准")
        failure = has("失败", "复盘", "教训", "踩坑", "倒闭", "误判", "谬误")
        channel = has_channels | has("渠道", "获客", "投流", "展会", "直销")
        return F.when(policy, "政策标准").when(failure, "失败案例").when(channel, "渠道策略").otherwise("行业基准")

    return X.once(X.search_norm(F.concat_ws(" ", text, context)), kind)


def cards(docs: DataFrame, start: int = 0) -> DataFrame:
    """R6, W8. A card for each document (doc_id, text, path): ids continue from ``start``."""
    t = F.col("clean")
    rows = docs.withColumn("clean", X.clean_text(F.col("text")))
    first = F.substring(F.split("clean", "\n")[0], 1, 80)
    title = F.coalesce(F.get(X.explicit_items(t, ["标题", "title"]), 0), F.nullif(first, F.lit("")), F.col("path"))
    rows = rows.withColumn("title", title).withColumn("labels", labels(t)).withColumn("scenarios", scenarios(t, F.col("labels")))
    context = F.concat_ws(" ", F.array_join("labels", " "), F.array_join("scenarios", " "))
    rows = rows.withColumn("industry", industry(t, context)).withColumn("fingerprint", X.fingerprint(F.col("path"), t))
    rows = _numbered(rows)
    return rows.select(
        "doc_id", F.concat(F.lit("KC_"), F.lpad((F.col("seq") + start).cast("string"), 3, "0")).alias("card_id"), card_type(t, context, F.size(groups_found(t, CHANNELS)) > 0).alias("type"), F.col("title").alias("name"),
        X.summary(t, F.col("title")).alias("description"), F.slice(F.array_distinct(F.array_compact(F.concat(F.array("industry"), F.col("labels"), F.col("scenarios")))), 1, 12).alias("tags"), "labels", "scenarios", "industry",
        X.evidence_source(t, F.col("path"), F.lit("")).alias("evidence_source"), "fingerprint", F.substring(t, 1, 400).alias("excerpt"), F.length(t).alias("n_chars"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """W8. ``seq`` from 1 in the order of (fingerprint, doc_id), without one task
    for all rows: numbers inside 256 slices of the fingerprint's digest, plus the
    sizes of the slices before."""
    cut = rows.withColumn("slice", F.substring(F.sha1(F.col("fingerprint").cast("binary")), 1, 2))
    before = cut.groupBy("slice").agg(F.count("*").alias("held"))
    before = before.select("slice", (F.sum("held").over(Window.orderBy("slice")) - F.col("held")).alias("before"))  # 256 rows
    local = F.row_number().over(Window.partitionBy("slice").orderBy("fingerprint", "doc_id"))
    return cut.withColumn("local", local).join(F.broadcast(before), "slice").withColumn("seq", F.col("local") + F.col("before")).drop("slice", "local", "before")


def next_card_number(card_ids: DataFrame) -> DataFrame:
    """W8. The largest number among ``card_id`` values like KC_012, 0 without any."""
    return card_ids.agg(F.coalesce(F.max(F.regexp_extract("card_id", r"^KC_(\d+)$", 1).try_cast("int")), F.lit(0)).alias("last"))


def card_filename(industry_: Column, kind: Column, card_id: Column) -> Column:
    """S14. KC_industry_type_number.json with characters that files may have."""
    def safe(c: Column, d: str) -> Column:
        s = F.coalesce(F.nullif(F.trim(X.lit_empty(c)), F.lit("")), F.lit(d))
        s = F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|]+', "_"), r"(?U)\s+", "_")
        return F.coalesce(F.nullif(F.regexp_replace(s, "^[._ ]+|[._ ]+$", ""), F.lit("")), F.lit(d))

    number = F.coalesce(F.nullif(F.regexp_extract(card_id, r"(\d+)$", 1), F.lit("")), F.lit("000"))
    return F.concat(F.concat_ws("_", F.lit("KC"), safe(industry_, "未知行业"), safe(kind, "行业基准"), number), F.lit(".json"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """A15. doc_id with, of its chunk extractions in order, the first non-empty
    scalar and the ordered distinct union of lists. ``chunks``: doc_id, pos, extraction."""
    e = F.col("extraction")
    one = lambda n: F.min_by(F.when(e[n] != "", e[n]), F.when(e[n] != "", F.col("pos"))).alias(n)
    many = lambda n: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", e[n].alias("v")))), lambda x: x["v"]))).alias(n)
    return chunks.groupBy("doc_id").agg(*(one(n) for n in ("project_name", "core_technology", "application_scene")), *(many(n) for n in ("technical_barriers", "innovation_points")))
