"""Keyword extraction, card retrieval, evidence choice, guardrails and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import text as X
from caselens.operators import similarity
from caselens.operators.rules import checkpointed

# Concepts, stop words, patterns and routing words.
CONCEPTS = ["商业模式", "痛点", "用户画像", "价值主张", "核心竞争力", "技术壁垒", "获客成本", "留存率", "复购率", "转化率", "渠道策略", "销售渠道", "团队分工", "里程碑", "最小可行产品", "mvp", "tam", "sam", "som", "cac", "ltv"]
STOPWORDS = ["我们", "你们", "他们", "这个", "那个", "现在", "目前", "以及", "如果", "因为", "所以", "然后", "需要", "希望", "怎么", "什么", "请问", "一个", "项目", "学生", "老师", "用户", "产品", "方案"]
TOKEN_SPLIT = r"[\s,，。！？；:：（）)\[\]{}<>/\\|]+"
MOJIBAKE = r"�|Ã.|Â.|Ð.|Ñ.|Ê.|Õ.|æ.|å.|ç.|þ.|¤"
EMOJI = r"[\x{1F300}-\x{1FAFF}☀-➿]"
EMOJI_FILL = r"[\s.,!?;:'\"“”‘’，。！？、~`@#$%^&*()\[\]{}<>\-_=+/\\|：…·♥❤️‍]+"
INJECTION = (
    r"(?i)(ignore\s+(all|any|previous)\s+(instructions|rules|messages)|system\s+prompt|developer\s+message|reveal\s+prompt|jailbreak|do\s+anything\s+now|"
    r"忽略(之前|以上|所有).{0,20}(指令|规则|消息)|系统提示词|开发者消息|越狱|绕过)"
)
LONGEST_INPUT = 2000
ROUTES = {
    "student": [
        ("clarification", ["没懂", "不懂", "什么意思", "啥意思", "再说一遍", "解释一下", "讲白话", "clarify", "explain"]),
        ("project", ["提交项目", "项目书", "bp", "商业计划书", "计划书", "路演稿", "压力测试", "诊断", "校验"]),
        ("competition", ["模拟比赛", "模拟答辩", "比赛", "赛事", "挑战杯", "互联网+", "rubric", "评分"]),
        ("tutor", ["是什么", "什么意思", "定义", "概念", "区别", "怎么理解"]),
    ],
    "teacher": [
        ("instructor", ["干预", "干预计划", "教学建议", "教学计划", "教师建议", "辅导", "改进", "提升"]),
        ("assessment", ["评估", "评价", "报告", "引用原文", "结构化", "rubric", "评分表", "诊断", "风险", "财务", "cac", "ltv", "tam", "sam", "som"]),
    ],
}
DEFAULT_ROUTE = {"student": "project", "teacher": "assessment", "admin": "admin"}


def tokens(text: Column) -> Column:
    """The lower-cased tokens of 2 to 18 characters that are no stop word or number, in order of the alphabet."""
    words = F.filter(F.transform(F.split(text, TOKEN_SPLIT), lambda t: F.lower(F.trim(t))), lambda t: F.length(t).between(2, 18))
    return F.sort_array(F.filter(words, lambda t: ~t.isin(STOPWORDS) & ~t.rlike(r"^\d+$")))


def _counted(sorted_: Column) -> Column:
    """a (minus the count), b (minus the length), keyword of each distinct token of a sorted
    array, in order of these: a run's length is told by where the next one begins."""

    def runs(tokens_: Column) -> Column:
        n, get = F.size(tokens_), lambda i: F.get(tokens_, i.cast("int"))
        first = F.filter(F.transform(tokens_, lambda t, i: i), lambda i: (i == 0) | (get(i) != get(i - 1)))
        one = lambda starts: lambda i, k: F.struct((i - F.coalesce(F.get(starts, k + 1), n)).cast("long").alias("a"), (-F.length(get(i))).alias("b"), get(i).alias("keyword"))
        return F.sort_array(X.once(first, lambda starts: F.transform(starts, one(starts))))

    return X.once(sorted_, runs)


def keywords(texts: DataFrame, most: int = 12, concepts: list[str] = CONCEPTS) -> DataFrame:
    """R8, W9, K2. doc_id, place, keyword: concepts of the text in their order, then
    tokens by (count desc, length desc, token), distinct after normalisation.

    All of it happens inside the text's row: tokens are sorted, their runs counted, the
    runs sorted again and the first ``most`` taken, so no token is ever shuffled.
    """
    found = lambda t: F.array(*(F.when(t.contains(w.lower()), F.struct(F.lit(k).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(w).alias("keyword"))) for k, w in enumerate(concepts)))
    # a variable of one element: a text is normalised once
    named = F.array_compact(F.flatten(F.transform(F.array(X.search_norm(F.col("text"))), found)))
    every = F.concat(named, _counted(tokens(F.col("text"))))
    # a plain token is its own normal form
    key = lambda c: F.when(c.rlike("^[a-z0-9]+$"), c).otherwise(X.search_norm(c))
    held = F.array().cast("array<struct<key:string,keyword:string>>")
    known = lambda acc, x: F.exists(acc, lambda y: y["key"] == key(x["keyword"])) | (key(x["keyword"]) == "")
    add = lambda acc, x: F.when(F.size(acc) >= most, acc).when(known(acc, x), acc).otherwise(F.concat(acc, F.array(F.struct(key(x["keyword"]).alias("key"), x["keyword"].alias("keyword")))))
    # the first few are nearly always enough; the others are looked at only where they are not
    few = 4 * most
    rest = lambda all_, acc: F.when((F.size(acc) < most) & (F.size(all_) > few), F.aggregate(F.slice(all_, few + 1, F.greatest(F.size(all_), F.lit(1))), acc, add)).otherwise(acc)
    fold = X.once(every, lambda all_: X.once(F.aggregate(F.slice(all_, 1, few), held, add), lambda acc: rest(all_, acc)))
    best = texts.select("doc_id", fold.alias("__best"))
    # an inner explode would have its array computed again, to filter on its size
    out = best.select("doc_id", F.posexplode_outer("__best").alias("pos", "x")).where("x IS NOT NULL")
    return out.select("doc_id", (F.col("pos") + 1).alias("place"), "x.keyword")


def retrieve(cards: DataFrame, words: list[str], limit: int = 3) -> DataFrame:
    """R9, K3, J7. card_id, title, score, matched for a keyword list: 6 for a
    keyword in the title, else up to 4 for its occurrences in the text.

    The keywords are a parameter, so they are expressions on the cards and no join.
    """
    keys = [(w, " ".join(w.lower().split())) for w in words if w.strip()]
    if not keys:
        return cards.select("card_id", "title", F.lit(0).alias("score"), F.array().cast("array<string>").alias("matched")).where("false")

    def points(card: Column, key: str) -> Column:
        count = F.floor((F.length(card["body"]) - F.length(F.replace(card["body"], F.lit(key), F.lit("")))) / len(key))
        return F.when(card["title"].contains(key), 6).otherwise(F.least(count, F.lit(4))).cast("int")

    # a variable of one element: the two texts are normalised once, whatever the number of keywords
    card = F.array(F.struct(X.search_norm(F.col("title")).alias("title"), X.search_norm(F.col("text")).alias("body")))
    each = F.flatten(F.transform(card, lambda c: F.array(*(F.struct(F.lit(w).alias("word"), points(c, key).alias("points")) for w, key in keys))))
    score = F.aggregate("each", F.lit(0), lambda n, x: n + x["points"])
    matched = F.transform(F.filter("each", lambda x: x["points"] > 0), lambda x: x["word"])
    rows = cards.select("card_id", "title", each.alias("each")).select("card_id", "title", score.alias("score"), F.slice(matched, 1, 5).alias("matched"))
    best = rows.orderBy(F.desc("score"), "title", "card_id").limit(limit)
    return best.where("score > 0")  # after the limit: a filter below it would score every card twice


def best_sentence(texts: DataFrame, words: list[str], most: int = 20, width: int = 220) -> DataFrame:
    """R10. doc_id, hits, sentence: of the first ``most`` sentences the first with most keywords."""
    rows = texts.select("doc_id", F.posexplode(F.slice(X.sentences(F.col("text")), 1, most)).alias("pos", "s"))
    hits = X.count_hits(F.lower("s"), [w.lower() for w in words])
    best = rows.withColumn("hits", hits).groupBy("doc_id").agg(F.max_by(F.struct("hits", "s"), F.struct("hits", (-F.col("pos")).alias("p"))).alias("x"))
    return best.select("doc_id", "x.hits", F.substring("x.s", 1, width).alias("sentence"))


def guardrail(text: Column) -> Column:
    """R11. garbled_text, emoji_only, prompt_injection, or empty if nothing blocks."""
    t = F.trim(X.lit_empty(text))
    odd = F.regexp_count(t, F.lit(r"[\p{Cc}\p{Cs}�]"))
    garbled = t.rlike(r"^[?？]{4,}$") | t.rlike(MOJIBAKE) | ((t != "") & (odd * 10 >= F.length(t)))
    emoji = t.rlike(EMOJI) & (F.regexp_replace(F.regexp_replace(t, EMOJI, ""), EMOJI_FILL, "") == "")
    injected = (F.length(t) > LONGEST_INPUT) & t.rlike(INJECTION)
    return F.when(t == "", "").when(garbled, "garbled_text").when(emoji, "emoji_only").when(injected, "prompt_injection").otherwise("")


def route(role: Column, text: Column, routes: dict[str, list[tuple[str, list[str]]]] = ROUTES, defaults: dict[str, str] = DEFAULT_ROUTE) -> Column:
    """R12. The first route of the role of which a word occurs, else the role's default."""
    t = F.lower(X.lit_empty(text))
    out = F.lit(None).cast("string")
    for r, default in defaults.items():
        inner = F.lit(default)
        for name, words in reversed(routes.get(r, [])):
            inner = F.when(t.rlike(X.quoted(words)), name).otherwise(inner)
        out = F.when(role == r, inner).otherwise(out)
    return F.coalesce(out, F.lit("Error"))


# Routes that a role may ask for.
ALLOWED_ROUTES = {"student": ["Student Learning Tutor", "Project Coach", "Competition Advisor", "Project Reviewer"], "teacher": ["Instructor Assistant", "Assessment Assistant"], "admin": ["Assessment Assistant"]}


def supervise(
    role: Column, text: Column, hint: Column, allowed: dict[str, list[str]] = ALLOWED_ROUTES,
    routes: dict[str, list[tuple[str, list[str]]]] = ROUTES, defaults: dict[str, str] = DEFAULT_ROUTE,
) -> Column:
    """R13, P11. Error where the guardrail blocks; then the hint, or Error where the
    role may not go there; without a hint R12."""
    may = F.lit(False)
    for r, names in allowed.items():
        may = may | ((role == r) & hint.isin(names))
    return F.when(guardrail(text) != "", "Error").when(F.coalesce(hint, F.lit("")) != "", F.when(may, hint).otherwise("Error")).otherwise(route(role, text, routes, defaults))


def quotes(messages: DataFrame, sources: DataFrame, given: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """R14. owner, place, quote: user messages (owner, turn, role, text), then quotes
    that are given (owner, pos, text), then prompts of logs (owner, pos, user_prompt,
    else raw_message), then the sentences of the project text (owner, text); the first
    of equals stays."""
    part = lambda kind, pos, quote: ("owner", F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), quote.alias("quote"))
    every = messages.where(F.lower("role") == "user").select(*part(0, F.col("turn"), F.trim("text")))
    if given is not None:
        every = every.union(given.select(*part(1, F.col("pos"), F.trim("text"))))
    if logs is not None:
        every = every.union(logs.select(*part(2, F.col("pos"), F.trim(F.coalesce(F.nullif("user_prompt", F.lit("")), "raw_message")))))
    kept = F.filter(X.sentences_kept(F.col("text")), lambda s: F.length(s) > 10)
    rows = sources.select("owner", kept.alias("s"), F.trim("text").alias("text"))
    found = rows.select("owner", F.posexplode(F.slice("s", 1, 10)).alias("at", "quote")).select(*part(3, F.col("at"), F.col("quote")))
    head = rows.where(F.size("s") > 10).select(*part(4, F.lit(0), F.substring("text", 1, 200)))
    every = every.union(found).union(head).where("quote <> ''")
    # the first of equals is an aggregate, so a quote that an owner repeats is combined before it moves
    first = every.groupBy("owner", "quote").agg(F.min(F.struct("kind", "pos")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("at", "quote"))).select("owner", "place", "quote")


def best_evidence(entries: DataFrame, asked: DataFrame, texts: DataFrame | None = None, most: int = 20, width: int = 220) -> DataFrame:
    """R10. owner, path, excerpt, score: of an owner's evidence (owner, pos, path, excerpt) the first
    entry in which its keywords (owner, keyword: the question and its words) occur most often.

    A keyword counts once for the path and once for the excerpt, an excerpt that is not blank
    counts two. An owner without entries has the best of the first ``most`` sentences of its text
    (owner, text), where such are given, with the path ProjectExcerpt.

    The keywords of an owner are one array, a question's few; entries are scored in their rows and
    only the best is kept before rows meet.
    """
    k = asked.select("owner", X.search_norm(F.col("keyword")).alias("k")).where("k <> ''").groupBy("owner").agg(F.collect_set("k").alias("keywords"))
    none = F.array().cast("array<string>")
    within = lambda text: X.once(text, lambda t: F.size(F.filter(F.coalesce("keywords", none), lambda w: F.contains(t, w))))
    blank = F.trim(F.coalesce("excerpt", F.lit(""))) == ""
    rows = entries.join(k, "owner", "left").withColumn("score", within(X.search_norm(F.col("path"))) + within(X.search_norm(F.col("excerpt"))) + F.when(blank, 0).otherwise(2))
    best = rows.groupBy("owner").agg(F.min_by(F.struct("path", "excerpt", "score"), F.struct(-F.col("score"), "pos", "path", "excerpt")).alias("x"))
    out = best.select("owner", "x.path", F.trim(F.coalesce("x.excerpt", F.lit(""))).alias("excerpt"), "x.score")
    if texts is None:
        return out
    bare = texts.join(entries.select("owner").distinct(), "owner", "left_anti").join(k, "owner", "left")
    whole = F.trim(X.lit_empty(F.col("text")))
    split = X.sentences_kept(F.col("text"))
    split = F.slice(F.when(F.size(split) > 0, split).otherwise(F.array(F.trim(F.substring(whole, 1, width)))), 1, most)
    # greatest score, then the least place
    scored = F.transform(split, lambda s, i: F.struct(within(X.search_norm(s)).alias("score"), (-i).alias("at"), F.trim(F.substring(s, 1, width)).alias("excerpt")))
    seeded = bare.where(whole != "").select("owner", F.array_max(scored).alias("x"))
    return out.union(seeded.select("owner", F.lit("ProjectExcerpt"), "x.excerpt", "x.score"))


def resolve_student(prompt: str, profiles: DataFrame, selected: str | None = None) -> DataFrame:
    """R15. One profile (student_key, label, name, project, project_id, seq): the
    first that the prompt names, else the selected one, else the first."""
    p = F.lit(prompt)
    named = F.lit(False)
    for c in ("label", "name", "project", "project_id"):
        named = named | ((F.coalesce(F.col(c), F.lit("")) != "") & p.contains(F.col(c)))
    rank = F.when(named, 0).when(F.col("student_key") == F.lit(selected), 1).otherwise(2)
    return profiles.withColumn("rank", rank).orderBy("rank", "seq").limit(1).drop("rank")


def align(names: DataFrame, known: DataFrame, close: float = 0.84) -> DataFrame:
    """R7, J13. name, aligned, how: a known name (name, pos) that is equal, else the
    first that contains it or lies in it, else the closest one, else itself.

    Equal names are an equi join; the others meet on rare bigrams (``similarity``), so a
    common one brings no two names together. A known name of one character is only found
    where it is equal.
    """
    n = names.select("name").where("name IS NOT NULL").distinct()
    k = known.select(F.col("name").alias("known"), "pos").groupBy("known").agg(F.min("pos").alias("pos"))
    exact = n.join(k, n.name == k.known).select("name", F.col("known").alias("aligned"), F.lit("exact").alias("how"))
    rest = checkpointed(n.join(exact.select("name"), "name", "left_anti"))
    a, b = similarity.ordered_bigrams(rest.select(F.col("name").alias("s")), k.select(F.col("known").alias("s")))
    placed = lambda pairs: pairs.join(k, F.col("b") == F.col("known"))
    inside = placed(similarity.contained(a, b)).groupBy(F.col("a").alias("name")).agg(F.min_by("known", "pos").alias("aligned"))
    inside = checkpointed(inside.select("name", "aligned", F.lit("contained").alias("how")))
    left_over = a.join(inside.select(F.col("name").alias("s")), "s", "left_anti")
    near = placed(similarity.close(left_over, b, close)).groupBy(F.col("a").alias("name")).agg(F.max_by("known", F.struct("ratio", (-F.col("pos")).alias("p"))).alias("aligned"))
    found = exact.union(inside).union(near.select("name", "aligned", F.lit("close").alias("how")))
    return n.join(found, "name", "left").select("name", F.coalesce("aligned", "name").alias("aligned"), F.coalesce("how", F.lit("itself")).alias("how"))
