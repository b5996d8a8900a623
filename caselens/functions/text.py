"""Text functions as Column expressions: no Python runs on the rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and cues that must be found inside a text, and white space in every script.
WHITE = r"(?U)\s+"
QUOTED = r".^$*+?{}[]|()\\-"


def lit_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def quoted(words: Iterable[str]) -> str:
    """A regular expression that matches any of ``words`` literally, the longest first."""
    return "|".join("".join("\\" + c if c in QUOTED else c for c in w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITE, " "))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` as a variable, computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def norm(c: Column) -> Column:
    """F1. Lower case, runs of white space as one space."""
    return collapse(F.lower(lit_empty(c)))


def search_norm(c: Column) -> Column:
    """F2. Lower case; everything but word characters of any script, white space too, becomes one space."""
    return F.trim(F.regexp_replace(F.lower(lit_empty(c)), r"(?U)[^\w一-鿿]+", " "))


def slug(c: Column, fallback: str = "node") -> Column:
    """F3."""
    s = F.substring(F.replace(search_norm(c), F.lit(" "), F.lit("_")), 1, 80)
    return F.when(s == "", fallback).otherwise(s)


def label(c: Column, default: str = "Concept") -> Column:
    """F4. ASCII letters, digits and underscores; a digit in front gets a prefix."""
    s = F.regexp_replace(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default)), "[^0-9A-Za-z_]", "")
    return F.when(s == "", default).when(s.rlike("^[0-9]"), F.concat(F.lit("Node_"), s)).otherwise(s)


def dual_labels(node_type: Column) -> Column:
    return F.array_distinct(F.array(F.lit("Node"), label(node_type)))


#: F5. The three separators in use.
SPLITS = {"slash": r"[,;/|]", "line": r"[,\n;；、|]+", "wide": r"[，,、;/|；\n]+"}


def trimmed(items: Column) -> Column:
    """Items without outer white space; empty ones go."""
    return F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def split_items(c: Column, kind: str = "wide") -> Column:
    return trimmed(F.split(lit_empty(c), SPLITS[kind]))


def ordered_distinct(items: Column) -> Column:
    """A21. Trimmed, non-empty, the first of equals."""
    return F.array_distinct(trimmed(F.filter(items, lambda x: x.isNotNull())))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of ``words`` lies in ``text``, as the pattern ``quoted`` would find it: plain
    searches for one word each, which read a long text many times faster than the pattern does."""
    found = [text.contains(w) for w in sorted(set(words), key=lambda w: (len(w), w))]
    return reduce(lambda a, b: a | b, found, F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """P1. A normalised word occurs in the normalised text, inside words too."""
    return once(norm(text), lambda t: has_any(t, (" ".join(w.lower().split()) for w in words if w.strip())))


def matches_cues(texts: Iterable[Column], cues: Iterable[str]) -> Column:
    """P2. As P1 on text without punctuation."""
    joined = F.concat_ws(" ", *(F.nullif(lit_empty(t), F.lit("")) for t in texts))
    return once(search_norm(joined), lambda t: has_any(t, cues))


def cues_found(texts: Iterable[Column], cues: dict[str, list[str]]) -> Column:
    """The names of those ``cues`` (lower case) that ``matches_cues`` finds, in their order.

    A cue of one word is looked for in the lower-cased text as it is; the text is rid of punctuation
    only for a cue of several words, all of which it has.
    """
    joined = F.concat_ws(" ", *(F.nullif(lit_empty(t), F.lit("")) for t in texts))

    def found(text: Column, words: list[str]) -> Column:
        single = [w for w in words if re.fullmatch(r"\w+", w)]
        several = [w for w in words if not any(x in w for x in single)]
        most = (reduce(lambda a, b: a & b, (text.contains(x) for x in w.split())) & search_norm(text).contains(w) for w in several)
        return reduce(lambda a, b: a | b, most, has_any(text, single))

    return once(F.lower(joined), lambda t: F.array_compact(F.array(*(F.when(found(t, w), F.lit(n)) for n, w in cues.items()))))


def count_hits(text: Column, words: Iterable[str]) -> Column:
    """How many different words occur in ``text``."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


# Predicates of the card graph, and spellings of relations.
PREDICATES = ["PREREQ", "FIX_STRATEGY", "ASSOCIATED_WITH", "SUPPORTS", "CONSTRAINS", "INDICATES", "TRIGGERS", "INVOLVES"]
RELATION_ALIASES = {"TRIGGER": "TRIGGERS", "INVOLVE": "INVOLVES", "PREREQUISITE": "PREREQ", "PREREQUISITES": "PREREQ"}


def predicate(c: Column, allowed: list[str] = PREDICATES, default: str = "ASSOCIATED_WITH") -> Column:
    """F9."""
    s = F.regexp_replace(F.regexp_replace(F.upper(lit_empty(c)), "[^A-Z_]", "_"), "^_+|_+$", "")
    alias = F.create_map(*(F.lit(x) for kv in RELATION_ALIASES.items() for x in kv))
    s = F.coalesce(alias[s], s)
    return F.when(s.isin(allowed), s).otherwise(default)


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """F10. Rule ids in upper case, then the alias of the normalised name, else the trimmed name."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return once(F.regexp_replace(lit_empty(c), r"(?U)^\s+|\s+$", ""), lambda name: F.when(name.rlike("^[hH][0-9]+$"), F.upper(name)).otherwise(F.coalesce(table[search_norm(name)], name)))


def case_id(name: Column, path: Column) -> Column:
    """F11. Trailing eight hexadecimal digits of the stem, else of the digest of name and path."""
    stem = F.regexp_replace(F.regexp_extract(lit_empty(name), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    token = F.regexp_extract(stem, "([0-9a-fA-F]{8})$", 1)
    digest = F.substring(F.sha1(F.concat(lit_empty(name), F.lit("|"), lit_empty(path)).cast("binary")), 1, 8)
    return F.concat(F.lit("P_"), F.upper(F.when(token != "", token).otherwise(digest)))


def chunks(c: Column, size: int) -> Column:
    """F18. Pieces of ``size`` characters."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def clean_text(c: Column) -> Column:
    """F19. Without mojibake marks and carriage returns; trimmed non-empty lines."""
    t = F.regexp_replace(F.regexp_replace(lit_empty(c), "�|锟斤拷", " "), "\r\n?", "\n")
    return F.array_join(trimmed(F.split(t, "\n")), "\n")


def _field(names: Iterable[str]) -> str:
    return rf"(?imU)^\s*(?:{quoted(names)})\s*[:：]\s*(.+)$"


def explicit_items(c: Column, names: Iterable[str]) -> Column:
    """F20. Items of all lines ``name: a, b``."""
    values = F.regexp_extract_all(lit_empty(c), F.lit(_field(names)), 1)
    return F.array_distinct(F.flatten(F.transform(values, lambda v: split_items(v))))


def explicit_value(c: Column, names: Iterable[str]) -> Column:
    """F20. The first line ``name: value``, unsplit; null without one."""
    return F.nullif(F.trim(F.regexp_extract(lit_empty(c), _field(names), 1)), F.lit(""))


def summary(c: Column, fallback: Column) -> Column:
    """F21. An abstract of 20 to 400 characters, else the first three lines, else the title."""
    abstract = collapse(F.regexp_extract(lit_empty(c), r"(?i)(?:摘要|abstract)\s*[:：]\s*([^\n]{20,400})", 1))
    head = F.array_join(F.slice(trimmed(F.split(lit_empty(c), "\n")), 1, 3), " ")
    return F.when(abstract != "", F.substring(abstract, 1, 280)).otherwise(F.coalesce(F.nullif(F.substring(head, 1, 280), F.lit("")), fallback))


def evidence_source(text: Column, path: Column, locator: Column) -> Column:
    """F22. Names of the fields are fixed values."""
    source = explicit_value(text, ["出处", "来源", "原文出处", "文献出处", "证据来源", "source", "参考来源", "参考文献"])
    page = explicit_value(text, ["页码", "引用页码", "page", "pages", "page_range"])
    first = F.when(source.isNotNull(), F.concat(F.lit("原文出处: "), source)).otherwise(F.concat(F.lit("文件来源: "), lit_empty(path)))
    second = F.when(page.isNotNull(), F.concat(F.lit("页码: "), page)).otherwise(F.nullif(lit_empty(locator), F.lit("")))
    return F.concat_ws(" | ", first, second)


def fingerprint(name: Column, text: Column) -> Column:
    """F23."""
    stem = F.regexp_replace(lit_empty(name), r"(?<=.)\.[^.]*$", "")
    stem = F.lower(F.regexp_replace(F.regexp_replace(stem, "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    return F.concat(F.lit("knowledge_card_"), F.coalesce(F.nullif(stem, F.lit("")), F.lit("doc")), F.lit("_"), F.substring(F.sha1(lit_empty(text).cast("binary")), 1, 10))


def sentences(c: Column) -> Column:
    """F24. Split at sentence ends, which are dropped."""
    return trimmed(F.split(lit_empty(c), r"[。！？!?\n]+"))


def sentences_kept(c: Column) -> Column:
    """F24. Split after sentence ends, which are kept, and at line ends."""
    return trimmed(F.split(lit_empty(c), r"(?<=[。！？.!?])|\n+"))


def formulae(c: Column) -> Column:
    """F25. Distinct ``$...$`` spans in order."""
    return F.array_distinct(trimmed(F.regexp_extract_all(lit_empty(c), F.lit(r"\$([^$]+)\$"), 1)))


RULE_ID = r"(?i)\b(H1[0-5]|H[1-9])\b"


def rule_ids(c: Column) -> Column:
    """F29. Distinct rule ids mentioned in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(lit_empty(c), F.lit(RULE_ID), 1), F.upper))


def strip_rule_ids(c: Column) -> Column:
    return collapse(F.regexp_replace(lit_empty(c), RULE_ID, ""))


def display_rule(rule_id: Column, name: Column) -> Column:
    r = F.upper(F.trim(lit_empty(rule_id)))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("Rule-"), r, F.lit(" ("), name, F.lit(")"))).otherwise(F.concat(F.lit("Rule-"), r))


def evidence_payload(c: Column) -> Column:
    """F30. The JSON between evidence tags, null where there is none or it is broken."""
    body = F.regexp_extract(lit_empty(c), r"(?s)<evidence>\s*(.*?)\s*</evidence>", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def strip_evidence(c: Column) -> Column:
    return F.trim(F.regexp_replace(lit_empty(c), r"(?s)\s*<evidence>.*?</evidence>\s*", " "))


def tag_evidence(text: Column, payload: Column) -> Column:
    return F.concat(lit_empty(text), F.lit("\n<evidence>"), lit_empty(payload), F.lit("</evidence>"))


def named_field(c: Column, name: str) -> Column:
    """F32. The value of ``name:`` up to a separator or the line's end."""
    return F.nullif(F.trim(F.regexp_extract(lit_empty(c), rf"{quoted([name])}\s*[:：]\s*([^\n，,；;。]+)", 1)), F.lit(""))


def path_text(labels: Column, names: Column, types: Column) -> Column:
    """F33. ``Label:Name -[TYPE]-> Label:Name``; one type fewer than nodes."""
    nodes = F.zip_with(labels, names, lambda a, b: F.concat(a, F.lit(":"), b))
    arrows = F.transform(types, lambda t: F.concat(F.lit(" -["), t, F.lit("]-> ")))
    return F.array_join(F.zip_with(nodes, arrows, lambda n, a: F.concat(n, F.coalesce(a, F.lit("")))), "")


# Placeholders of old logs and what is shown for them.
PLACEHOLDERS = {"unnamed project": "未命名项目", "not_started": "未跟进"}


def display_text(c: Column, default: str = "") -> Column:
    """F34. A broken spelling is mended; a placeholder gets its name, nothing the default."""
    t = F.replace(F.trim(lit_empty(c)), F.lit("瀛︾敓"), F.lit("学生"))
    names = F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv))
    return F.when(t == "", default).otherwise(F.coalesce(names[F.lower(t)], t))


def status_score(status: Column) -> Column:
    """F26. Score out of 10 of a rule's status."""
    s = F.lower(F.trim(lit_empty(status)))
    return F.when(s.isin("failed", "fail", "error"), 2.0).when(s.isin("warning", "warn"), 5.0).when(s.isin("passed", "pass", "success"), 9.0).otherwise(6.0)


def clip_score(score: Column, low: float = 0.0, high: float = 5.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(score, 2)))


def page_ranges(pages: Column) -> Column:
    """W7. Sorted distinct page numbers as ``1-3, 6-7``: a number starts a range
    where the one before it is missing."""
    p = F.array_sort(F.array_distinct(pages))
    starts = F.filter(p, lambda x: ~F.array_contains(p, x - 1))
    ends = F.filter(p, lambda x: ~F.array_contains(p, x + 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b))), ", ")


def html_text(c: Column) -> Column:
    """S12. The text between tags, a line for each non-empty run; text of scripts and styles stays."""
    parts = F.split(F.regexp_replace(lit_empty(c), r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "\u0001"), r"(?s)<[^<>]+>|\u0001")
    plain = F.transform(parts, lambda x: collapse(_entities(x)))
    return F.array_join(F.filter(plain, lambda x: x != ""), "\n")


def _entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c
