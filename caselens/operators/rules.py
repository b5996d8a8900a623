"""The fifteen consistency rules over a table of cases.

Each case becomes one row of features: conditional aggregates over its nodes,
relations and hyperedges, joined by case. Rules are CASE expressions over that
row, in the order in which their outcomes are tried, and one ``inline`` of an
array of structs makes a row for each rule. Evidence lists of a few ids are made
by blocks of a case's nodes and then merged; only the list of weak evidence, which
is wanted whole, has no bound.

A keyword counts as found in a case if one of its texts contains it: the parts
are not joined first, so a phrase never spans two of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import json as J
from caselens.functions import text as X
from caselens.operators.messages import DISABLED, GUIDE_CAC, GUIDE_COMPETITORS, GUIDES, KEEP, TEXTS

# Words of each topic.
KEYWORDS = {
    "customer": ["customer", "persona", "segment", "user", "客户", "用户", "客群", "画像", "采购"],
    "value": ["value proposition", "solution", "benefit", "价值主张", "方案", "卖点", "解决方案"],
    "channel": ["channel", "distribution", "acquisition", "渠道", "获客", "投流", "展会", "直销", "推广"],
    "revenue": ["revenue", "pricing", "price", "subscription", "commission", "ads", "收入", "定价", "付费", "订阅", "佣金", "广告", "变现"],
    "payment": ["willingness to pay", "price sensitivity", "支付意愿", "价格敏感", "价格测试", "付费测试", "访谈", "问卷"],
    "demand": ["interview", "survey", "observation", "behavior", "访谈", "问卷", "观察", "原话", "日志"],
    "competitor": ["competitor", "benchmark", "comparison", "alternative", "substitute", "竞品", "竞争", "对比", "替代", "平替"],
    "innovation": ["innovation", "proprietary", "moat", "patent", "algorithm", "创新", "壁垒", "专利", "算法", "技术路线", "核心竞争力"],
    "growth": ["national", "nationwide", "scale", "franchise", "全国", "扩张", "复制", "连锁", "铺开"],
    "milestone": ["milestone", "timeline", "roadmap", "里程碑", "时间表", "路线图", "交付", "上线"],
    "deeptech": ["quantum", "chip", "robotics", "medical device", "大模型", "量子", "芯片", "机器人", "医疗器械", "工业设备"],
    "compliance_signal": ["ai", "privacy", "biometric", "education", "medical", "finance", "copyright", "children", "data", "ai伦理", "数据隐私", "隐私", "准入", "医疗", "金融", "未成年人", "版权", "教育"],
    "compliance_control": ["license", "permit", "regulatory", "consent", "ethics", "privacy policy", "资质", "许可", "审批", "合规", "授权", "同意书", "伦理"],
    "experiment": ["mvp", "pilot", "experiment", "ab test", "test", "验证", "试点", "实验", "最小可行产品", "灰度"],
    "control": ["control group", "ab test", "baseline", "对照组", "实验组", "基线"],
    "expert": ["phd", "advisor", "专家", "技术合伙人", "资深工程师", "教授"],
    "enterprise_sale": ["b2b", "高客单价", "工业设备", "企业服务", "采购"],
    "enterprise_service": ["企业服务", "工业设备", "长期售后", "高可靠"],
    "no_competitor": ["没有竞争对手", "no competitor", "first of its kind"],
    "competitor_kind": ["direct", "indirect", "substitute", "直接", "间接", "替代", "隐形替代"],
    "experiment_claim": ["ab test", "实验", "对照"],
    "minors": ["小学生", "儿童", "未成年人"],
    "elderly": ["老年", "银发"],
    "industrial": ["工业设备", "采购", "企业服务"],
}
# Channels that do not reach enterprises, and words of advertising revenue.
SOCIAL_CHANNELS = ["社交媒体", "短视频投流", "linkedin", "tiktok", "微博", "小红书", "抖音"]
AD_REVENUE = ["广告", "流量变现", "ads", "advertising"]

#: Rule, name, severity of a failure, weight.
CATALOG = [
    ("H1", "客户-价值主张错位", "High", 2), ("H2", "渠道不可达", "High", 2), ("H3", "定价无支付意愿证据", "Warning", 1), ("H4", "TAM/SAM/SOM口径混乱", "High", 2),
    ("H5", "需求证据不足", "Warning", 1), ("H6", "竞品对比不可比", "Warning", 1), ("H7", "创新点不可验证", "High", 2), ("H8", "单位经济不成立", "Warning", 1),
    ("H9", "增长逻辑跳跃", "High", 2), ("H10", "里程碑不可交付", "High", 3), ("H11", "合规/伦理缺口", "High", 2), ("H12", "技术路线与资源不匹配", "High", 3),
    ("H13", "实验设计不合格", "Warning", 1), ("H14", "路演叙事断裂", "Warning", 1), ("H15", "评分项证据覆盖不足", "Warning", 1),
]

def node_text(nodes: DataFrame) -> DataFrame:
    """F8. ``nodes`` with ``text``: all that a node says, normalised."""
    lists = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    parts = [F.col("name"), F.col("description"), lists("tags"), lists("aliases"), *map(F.col, ("metric_key", "source", "expected_output", "artifact_type", "stage")), F.array_join(J.leaves(F.col("metadata")), " ")]
    return nodes.withColumn("text", X.norm(F.concat_ws(" ", *parts)))


def _flags(text: Column, topics: list[str]) -> list[Column]:
    return [X.has_any(text, KEYWORDS[t]).alias(f"t_{t}") for t in topics]


#: Nodes of a case whose evidence lists are made together before they are merged.
BLOCK = 4096


def _first(condition: Column, n: int | None) -> Column:
    """The first ``n`` (all if none) positions and ids, by position, of a block where ``condition`` holds."""
    found = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", "id"))))
    return found if n is None else F.slice(found, 1, n)


def _merged_first(name: str, n: int | None) -> Column:
    """The ids of ``_first`` over all blocks of a case: no more than ``n`` of each meet."""
    found = F.array_sort(F.flatten(F.collect_list(name)))
    return F.transform(found if n is None else F.slice(found, 1, n), lambda x: x["id"])


def metric(key: str) -> Column:
    """H19. The value of the first metric node whose key, name or id is ``key``."""
    is_it = F.greatest(*(F.coalesce(F.upper(F.trim(c)) == key, F.lit(False)) for c in ("metric_key", "name", "id")))
    return F.min(F.when((F.col("node_type") == "Metric") & is_it, F.struct("pos", "value", "id")))


def channel_findings(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """J5. case_id, card_id, fit_score, segment_overlap, scenario_overlap: the
    project's channels against the channel data of the case's cards."""
    items = "array<struct<channel:string,fit_score:double,customer_segments:array<string>,applicable_scenarios:array<string>>>"
    cards = nodes.where("node_type = 'KnowledgeCard'").select("case_id", F.col("id").alias("card_id"), F.explode(F.from_json(F.get_json_object("industry_benchmarks", "$.channel_fit_data"), items)).alias("fit"))
    normed = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), X.norm)
    leaf = lambda *keys: normed(J.leaves(J.first_present(F.col("metadata"), *keys)))
    wanted = projects.select(
        "case_id",
        F.explode(F.array_distinct(leaf("primary_channels", "channels", "acquisition_channels", "channel_strategy"))).alias("channel"),
        leaf("customer_profiles", "target_segments").alias("segments"),
        leaf("target_scenarios").alias("scenarios"),
    )
    fits = cards.withColumn("channel", X.norm(F.col("fit.channel")))
    overlap = lambda mine, theirs: (F.size(mine) == 0) | F.arrays_overlap(mine, normed(theirs))
    return wanted.join(fits, ["case_id", "channel"]).select(
        "case_id", "card_id", F.coalesce("fit.fit_score", F.lit(0.0)).alias("fit_score"),
        overlap(F.col("segments"), F.col("fit.customer_segments")).alias("segment_overlap"), overlap(F.col("scenarios"), F.col("fit.applicable_scenarios")).alias("scenario_overlap"),
    )


def components(nodes: DataFrame, relations: DataFrame, participants: DataFrame, starts: DataFrame) -> DataFrame:
    """G17. (case_id, id) of what is reachable from each start (case_id, id) over
    relations and common hyperedges.

    A hyperedge is a vertex of its own, so an edge of many members is a star and no clique.
    """
    ends = relations.select("case_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    star = participants.select("case_id", F.col("node_id").alias("a"), F.concat(F.lit("\u0001"), "edge_id").alias("b"))
    at = lambda c: F.struct("case_id", F.col(c).alias("id"))
    links = ends.union(star).where("a IS NOT NULL AND b IS NOT NULL").select(at("a").alias("a"), at("b").alias("b"))
    labels = connected(links)
    begun = starts.select(at("id").alias("node")).distinct()
    reached = begun.join(labels, "node").select("root").distinct()
    seen = begun.union(labels.join(reached, "root", "left_semi").select("node")).distinct()
    return seen.select("node.*").where(~F.col("id").startswith("\u0001"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the least node that it is connected with.

    Nodes are hung under smaller ones. A round hangs the larger neighbours of every
    node under the least of its neighbourhood, then the smaller ones; paths get
    shorter by a factor each time, so rounds grow with the logarithm of the longest
    path. Minima are aggregates that are joined back, and each round is cut from its lineage.
    """

    def hung(pairs: DataFrame, larger: bool) -> DataFrame:
        """Pairs (below, above) after the neighbours on one side of each node are hung under its least."""
        ways = pairs.select(F.col("below").alias("n"), F.col("above").alias("m"))
        if larger:
            ways = ways.union(pairs.select("above", "below"))
        least = ways.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        moved = (ways.where("m > n") if larger else ways).join(least, "n").select(F.col("m").alias("below"), F.col("low").alias("above"))
        if not larger:
            moved = moved.union(least.select("n", "low"))
        return moved.where("below <> above").distinct()

    now = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("below"), F.least("a", "b").alias("above")).distinct())
    state = None
    while state != (state := now.agg(F.count("*"), F.sum(F.xxhash64("below", "above").cast("decimal(38,0)"))).first()):
        now = checkpointed(hung(checkpointed(hung(now, True)), False))
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    tops = now.select(F.col("above").alias("node"), F.col("above").alias("root"))
    return now.select(F.col("below").alias("node"), F.col("above").alias("root")).union(tops).union(alone.join(now, F.col("node") == F.col("below"), "left_anti")).distinct()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` on shared storage; the session names the folder, or tests on one machine get their own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None and not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="caselens-"))
    return df.checkpoint()


#: Rows of a part that ``dealt`` makes.
PART_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df``, dealt out by ``keys`` into parts of about ``PART_ROWS`` rows, so that a task's memory
    stays the same while the table grows; a table of one part is left to the session's settings.

    ``rows``: about how many there are, counted if not given.
    """
    n = -(-(df.count() if rows is None else rows) // PART_ROWS)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, least), *keys) if n > 1 else df.repartition(*keys)


def features(cases: DataFrame, nodes: DataFrame, relations: DataFrame, hyperedges: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each case with all that the rules look at."""
    topics = list(KEYWORDS)
    texts = node_text(nodes)
    rows = texts.select("*", *_flags(F.col("text"), topics))
    kind = lambda t: F.col("node_type") == t
    count = lambda c: F.count_if(c)
    evidence = kind("Evidence")
    lists = {f"ids_{t}": (F.col(f"t_{t}"), k) for t, k in (("customer", 2), ("value", 2), ("competitor", 4), ("compliance_control", 2))}
    lists |= {f"ids_{t}": (kind(t), 2) for t in ("Method", "Metric", "Artifact", "Task")}
    lists |= {"ids_Evidence": (evidence, 3), "ids_demand": (evidence & F.col("t_demand"), 3), "ids_weak": (evidence & (F.col("confidence") < 0.5), None)}
    keys = ("TAM", "SAM", "SOM", "CAC", "LTV")
    # blocks of a case first, so that a case of any size is no array
    blocks = rows.groupBy("case_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        *(F.bool_or(f"t_{t}").alias(f"n_{t}") for t in topics),
        *(_first(found, k).alias(name) for name, (found, k) in lists.items()),
        count(evidence & F.col("t_payment")).alias("paid_evidence"),
        *(metric(k).alias(k) for k in keys),
        F.min(F.when(kind("Project"), F.struct("pos", "id", "name", "description", "stage", "metadata"))).alias("project"),
    )
    by_node = blocks.groupBy("case_id").agg(
        *(F.bool_or(f"n_{t}").alias(f"n_{t}") for t in topics), *(_merged_first(name, k).alias(name) for name, (_, k) in lists.items()),
        F.sum("paid_evidence").alias("paid_evidence"), *(F.min(c).alias(c) for c in (*keys, "project")),
    )
    relation_text = X.norm(F.concat_ws(" ", "relation_type", "description", F.array_join(F.coalesce("evidence_ids", F.array().cast("array<string>")), " "), F.array_join(J.leaves(F.col("metadata")), " ")))
    by_relation = relations.select("case_id", "relation_type", *_flags(relation_text, topics)).groupBy("case_id").agg(
        *(F.bool_or(f"t_{t}").alias(f"r_{t}") for t in topics), count(F.col("t_payment")).alias("paid_relations"), count(F.col("relation_type") == "EVIDENCED_BY").alias("evidenced")
    )
    edge_text = X.norm(F.concat_ws(" ", "name", "description", F.array_join(F.map_keys("participants"), " "), F.array_join(J.leaves(F.col("metadata")), " ")))
    by_edge = hyperedges.select("case_id", "edge_type", *_flags(edge_text, topics)).groupBy("case_id").agg(*(F.bool_or(f"t_{t}").alias(f"e_{t}") for t in topics), count(F.col("edge_type") == "Value_Loop_Edge").alias("loops"))
    own = X.norm(F.concat_ws(" ", "title", "description"))
    projects = nodes.where("node_type = 'Project'").groupBy("case_id").agg(F.min(F.struct("pos", "id", "metadata")).alias("p")).select("case_id", "p.id", "p.metadata")
    fits = channel_findings(nodes, projects)
    by_fit = fits.groupBy("case_id").agg(
        F.array_sort(F.collect_set(F.when((F.col("fit_score") < 0.35) | ~F.col("segment_overlap"), F.col("card_id")))).alias("misfits"),
        F.array_sort(F.collect_set(F.when((F.col("fit_score") < 0.2) | ~F.col("segment_overlap") | ~F.col("scenario_overlap"), F.col("card_id")))).alias("unreachable"),
    )
    reached = components(nodes, relations, participants, projects).withColumn("in", F.lit(True))
    roles = rows.join(reached, ["case_id", "id"], "left").groupBy("case_id").agg(
        F.array_compact(F.array(*(F.when(F.bool_or(f"t_{t}") & ~F.bool_or(F.col(f"t_{t}") & F.coalesce("in", F.lit(False))), F.lit(role)) for t, role in (("customer", "problem"), ("value", "solution"), ("channel", "growth"))))).alias("broken")
    )
    out = cases.select("case_id", "title", *(X.has_any(own, KEYWORDS[t]).alias(f"c_{t}") for t in topics))
    for part in (by_node, by_relation, by_edge, by_fit, roles):
        out = out.join(part, "case_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    for t in topics:
        out = out.withColumn(t, flag(f"c_{t}") | flag(f"n_{t}") | flag(f"r_{t}") | flag(f"e_{t}"))
    return out


def evaluate(f: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """H0. case_id, rule_id, name, status, severity, reason, is_triggered,
    evidence_nodes, message, fix_suggestion: fifteen rows for each row of features.

    ``reason`` names the outcome. ``switches`` (rule_id, enabled) turns rules off;
    what it does not list is on.
    """
    meta = F.col("project.metadata")
    get = lambda *k: J.first_present(meta, *k)
    some = lambda *k: F.size(J.leaves(get(*k))) > 0
    listed = lambda *k: F.coalesce(J.list_given(get(*k)), F.lit(False))
    true = lambda *k: F.coalesce(J.truthy(get(*k)), F.lit(False))
    node = lambda t: F.coalesce(F.col(f"n_{t}"), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    ids = lambda *names: F.concat(*(F.coalesce(F.col(n) if isinstance(n, str) else n, F.array().cast("array<string>")) for n in names))
    any_of = lambda n: F.size(F.coalesce(F.col(n), F.array().cast("array<string>"))) > 0
    project = F.array_compact(F.array(F.col("project.id")))
    channels = F.transform(J.leaves(get("primary_channels", "channels", "acquisition_channels")), X.norm)
    has_channel = F.size(channels) > 0
    uses = lambda names: F.arrays_overlap(channels, F.array(*(F.lit(" ".join(n.lower().split())) for n in names)))
    revenue = F.array_join(J.leaves(get("revenue_model", "revenue_streams", "pricing_model", "monetization")), " ")
    stage = F.coalesce(X.norm(F.col("project.stage")), F.lit(""))
    early = stage.isin("idea", "mvp")
    value = lambda k: F.col(f"{k}.value")
    metric_ids = lambda *keys: F.array_compact(F.array(*(F.col(f"{k}.id") for k in keys)))
    missing = lambda *keys: reduce(lambda a, b: a | b, (value(k).isNull() for k in keys))
    route = true("technical_route", "technology_path", "研发路线")
    # a numeric level only: text levels are not read, as documented in the survey
    trl = F.coalesce(*(J.number(J.field(meta, k)) for k in ("trl", "TRL", "technology_readiness_level")))
    parts = (any_of("ids_Task") | any_of("ids_Artifact")).cast("int") + any_of("ids_Metric").cast("int") + any_of("ids_Evidence").cast("int")
    c = F.col
    weak = any_of("ids_weak")
    narrative = {
        "problem": node("customer") | listed("customer_profiles"),
        "solution": node("value") | listed("value_propositions"),
        "revenue": some("revenue_model", "revenue_streams", "pricing_model", "pricing") | value("CAC").isNotNull() | value("LTV").isNotNull(),
        "growth": has_channel | (count("loops") > 0),
    }
    uploaded = F.transform(J.leaves(get("attachments", "uploaded_files")), X.norm)
    demanded = F.filter(J.leaves(get("rubric_required_evidence", "required_attachments")), lambda x: ~F.array_contains(uploaded, X.norm(x)))
    gaps = F.array_distinct(F.concat(
        F.array_compact(F.array(
            F.when(true("competitor_analysis_required") & ~node("competitor"), F.lit("竞品对比表")), F.when(missing("TAM", "SAM", "SOM"), F.lit("市场规模测算表")),
            F.when(missing("CAC", "LTV") | (value("CAC") <= 0), F.lit("财务测算表")), F.when(~any_of("ids_Evidence"), F.lit("用户证据包")),
            F.when(stage.isin("mvp", "growth") & ~any_of("ids_Artifact"), F.lit("原型或阶段性交付物")),
        )), demanded,
    ))
    W, L, P = "WARNING", "FAILED", "PASSED"
    # rule -> (evidence, outcomes in order: condition, status, reason, extra evidence)
    none = F.array().cast("array<string>")
    rules: dict[str, tuple[Column, list[tuple[Column, str, str, Column]]]] = {
        "H1": (ids(project, "ids_customer", "ids_value"), [
            (~node("customer") & ~listed("customer_profiles", "customer_segments"), W, "no_customer", none),
            (~node("value") & ~listed("value_propositions"), W, "no_value", none),
            (~has_channel, W, "no_channel", none),
            (any_of("misfits"), L, "channel_misfit", ids("misfits")),
            (c("enterprise_sale") & uses(SOCIAL_CHANNELS), L, "weak_channel", none),
            (revenue.rlike("(?i)" + X.quoted(AD_REVENUE)) & c("enterprise_service"), L, "revenue_misfit", none),
        ]),
        "H2": (project, [
            (~has_channel, W, "no_channel", none),
            (any_of("unreachable"), L, "unreachable", ids("unreachable")),
            ((c("minors") & uses(["linkedin"])) | (c("elderly") & uses(["discord"])) | (c("industrial") & uses(["短视频投流", "社交媒体"])), L, "wrong_audience", none),
        ]),
        "H3": (ids(project, "ids_Evidence"), [
            (~some("pricing_model", "pricing", "price", "revenue_model", "revenue_streams") & ~c("revenue"), W, "no_pricing", none),
            ((count("paid_evidence") == 0) & (count("paid_relations") == 0), W, "no_payment_evidence", none),
        ]),
        "H4": (metric_ids("TAM", "SAM", "SOM"), [
            (missing("TAM", "SAM", "SOM"), W, "missing", none),
            (~((value("TAM") >= value("SAM")) & (value("SAM") >= value("SOM"))), L, "order", none),
        ]),
        "H5": (ids(project, "ids_demand"), [
            (~any_of("ids_Evidence") & (count("evidenced") == 0), W, "no_evidence", none),
            (weak & ~any_of("ids_demand"), W, "weak_evidence", none),
        ]),
        "H6": (ids(project, "ids_competitor"), [
            (true("competitor_analysis_required") & ~node("competitor") & ~c("competitor"), W, "required", none),
            (c("no_competitor") & ~node("competitor"), W, "denied", none),
            (c("competitor") & ~c("competitor_kind"), W, "one_sided", none),
        ]),
        "H7": (ids(project, "ids_Method", "ids_Metric"), [
            (~c("innovation"), P, "no_claim", none),
            (~true("technical_route", "technology_path", "研发路线", "patent_status") & ~any_of("ids_Method") & ~any_of("ids_Metric"), L, "unsupported", none),
        ]),
        "H8": (metric_ids("CAC", "LTV"), [
            (missing("CAC", "LTV"), W, "missing", none),
            (value("CAC") <= 0, W, "cac", none),
            (value("LTV") < 3 * value("CAC"), W, "ratio", none),
        ]),
        "H9": (ids(project, "ids_Artifact", F.slice(F.coalesce("ids_Evidence", none), 1, 2)), [
            (~c("growth"), P, "no_claim", none),
            (early & (~any_of("ids_Artifact") | ~any_of("ids_Evidence")), L, "unproven", none),
        ]),
        "H10": (project, [
            (~some("milestones", "timeline", "roadmap", "delivery_plan") & ~c("milestone"), P, "no_plan", none),
            (c("deeptech") & ~c("expert") & ~any_of("ids_Method"), W, "unmanned", none),
        ]),
        "H11": (ids(project, F.when(c("compliance_signal"), c("ids_compliance_control")).otherwise(none)), [
            (~c("compliance_signal"), P, "no_signal", none),
            (~c("compliance_control"), L, "no_control", none),
        ]),
        "H12": (ids(project, "ids_Method"), [
            ((trl > 7) & ~c("expert"), L, "level", none),
            (c("deeptech") & ~c("expert") & ~route & ~any_of("ids_Method"), L, "no_route", none),
        ]),
        "H13": (ids(project, *(F.slice(F.coalesce(c(f"ids_{t}"), none), 1, 1) for t in ("Task", "Artifact", "Metric", "Evidence"))), [
            (~early & ~c("experiment"), P, "no_claim", none),
            (parts < 3, W, "open_loop", none),
            (c("experiment_claim") & ~c("control"), W, "no_control", none),
        ]),
        "H14": (project, [
            (F.col("project.id").isNull(), W, "no_project", none),
            (~reduce(lambda a, b: a & b, narrative.values()), W, "gap", none),
            (any_of("broken"), W, "disconnected", none),
        ]),
        "H15": (F.when(F.size(gaps) > 0, ids(project, "ids_Artifact", F.slice(F.coalesce("ids_Evidence", none), 1, 2))).otherwise(project), [
            (F.size(gaps) > 0, W, "gaps", none),
        ]),
    }
    absent = {
        "H4": F.array_compact(F.array(*(F.when(value(k).isNull(), F.lit(k)) for k in ("TAM", "SAM", "SOM")))),
        "H8": F.array_compact(F.array(*(F.when(value(k).isNull(), F.lit(k)) for k in ("CAC", "LTV")))),
        "H14": F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in zip(("问题/客户", "方案", "盈利", "增长"), narrative.values())))),
        "H15": F.slice(gaps, 1, 1),
    }

    def filled(rule: str, text: str) -> Column:
        """``text`` with the names of what is missing."""
        return F.replace(F.lit(text), F.lit("{missing}"), F.array_join(absent[rule], ", ")) if "{missing}" in text else F.lit(text)

    structs = []
    for rule, name, severity, weight in CATALOG:
        evidence, outcomes = rules[rule]
        status, reason, extra = F.lit(P), F.lit("ok"), none
        message, fix = (F.lit(t) for t in TEXTS[rule, "ok"])
        for condition, s, r, more in reversed(outcomes):
            hit = F.coalesce(condition, F.lit(False))
            pick = lambda new, old, hit=hit: F.when(hit, new).otherwise(old)
            status, reason, extra = pick(F.lit(s), status), pick(F.lit(r), reason), pick(more, extra)
            message, fix = (pick(filled(rule, t), old) for t, old in zip(TEXTS[rule, r], (message, fix)))
        if rule == "H5":
            evidence = F.when(reason == "weak_evidence", ids("ids_weak")).otherwise(evidence)
        structs.append(F.struct(
            F.lit(rule).alias("rule_id"), F.lit(name).alias("name"), status.alias("status"),
            F.when(status == L, F.lit(severity)).when(status == W, F.lit("Warning")).otherwise(F.lit("Info")).alias("severity"), reason.alias("reason"), (status != P).alias("is_triggered"),
            F.array_distinct(F.concat(evidence, extra)).alias("evidence_nodes"), message.alias("message"), fix.alias("fix_suggestion"), F.lit(weight).alias("weight"),
        ))
    out = f.select("case_id", F.inline(F.array(*structs)))
    if switches is None:
        return out
    off = switches.where("NOT enabled").select("rule_id").distinct().withColumn("off", F.lit(True))
    out = out.join(F.broadcast(off.limit(len(CATALOG))), "rule_id", "left")  # at most one row for each rule
    skipped = F.coalesce("off", F.lit(False))
    set_ = lambda n, v: F.when(skipped, v).otherwise(F.col(n)).alias(n)
    return out.select(
        "case_id", "rule_id", "name", set_("status", F.lit("SKIPPED")), set_("severity", F.lit("Info")), set_("reason", F.lit("disabled")), set_("is_triggered", F.lit(False)),
        set_("evidence_nodes", none), set_("message", F.lit(DISABLED[0])), set_("fix_suggestion", F.lit(DISABLED[1])), "weight",
    )


def overall(results: DataFrame) -> DataFrame:
    """A14. case_id, counts by status and the worst status of each case."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = results.groupBy("case_id").agg(*(n(s).alias(s.lower()) for s in ("FAILED", "WARNING", "PASSED", "SKIPPED")))
    return counted.withColumn("overall_status", F.when(F.col("failed") > 0, "FAILED").when(F.col("warning") > 0, "WARNING").otherwise("PASSED"))


def draft_diagnosis(results: DataFrame, rule_ids: tuple[str, ...] = ("H1", "H4", "H6", "H8")) -> DataFrame:
    """H16, P9. The rules of a draft that did not pass."""
    return results.where(F.col("rule_id").isin(list(rule_ids)) & ~F.upper("status").isin("PASSED", "PASS", "SUCCESS", "SKIPPED"))


def guided(results: DataFrame) -> DataFrame:
    """H18. ``results`` with the message that a student sees."""
    r = F.col("rule_id")
    prefix = F.create_map(*(F.lit(x) for kv in GUIDES.items() for x in kv))[r]
    plain = F.when(prefix.isNotNull(), F.concat(prefix, F.lit(" "), F.col("message"))).otherwise(F.col("message"))
    special = F.when((r == "H6") & (F.col("reason") == "required"), GUIDE_COMPETITORS).when((r == "H8") & (F.col("reason") == "cac"), GUIDE_CAC)
    return results.withColumn("assistant_message", F.coalesce(special, plain))


def metric_rules(metrics: DataFrame) -> DataFrame:
    """H4 and H8 on a table of numbers (case_id, tam, sam, som, cac, ltv): two rows
    for each case, without a join."""
    c = F.col
    gap = lambda *k: reduce(lambda a, b: a | b, (c(x).isNull() for x in k))
    h4 = F.when(gap("tam", "sam", "som"), "WARNING").when((c("tam") >= c("sam")) & (c("sam") >= c("som")), "PASSED").otherwise("FAILED")
    h8 = F.when(gap("cac", "ltv"), "WARNING").when(c("cac") <= 0, "WARNING").when(c("ltv") >= 3 * c("cac"), "PASSED").otherwise("WARNING")
    row = lambda r, s: F.struct(F.lit(r).alias("rule_id"), s.alias("status"), (s != "PASSED").alias("is_triggered"))
    return metrics.select("case_id", F.inline(F.array(row("H4", h4), row("H8", h8))))
