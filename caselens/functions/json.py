"""JSON functions as Column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.functions.text import lit_empty, once, ordered_distinct

_TOKEN = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\btrue\b|\bfalse\b'


def field(c: Column, key: str) -> Column:
    """The JSON text of a member; null if it is missing, ``null`` if it is null."""
    return F.when(has_key(c, key), F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(c), f"$.{key}", "variant")), F.lit("null")))


def has_key(c: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def first_present(c: Column, *keys: str) -> Column:
    """F7. The JSON text of the first key that is there, even if its value is null or empty."""
    out = F.when(has_key(c, keys[0]), field(c, keys[0]))
    for k in keys[1:]:
        out = out.when(has_key(c, k), field(c, k))
    return out


def leaves(c: Column) -> Column:
    """F6. All leaf values as strings, in document order, whatever the depth; keys,
    nulls and blank strings are left out."""
    tokens = F.filter(F.regexp_extract_all(lit_empty(c), F.lit(_TOKEN), 0), lambda t: ~t.endswith(":"))
    values = F.from_json(F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]")), "array<string>")
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))


def truthy(c: Column) -> Column:
    """Whether the value of a JSON text counts as true: not null, false, 0 or empty."""
    return c.isNotNull() & ~F.trim(c).isin("null", "false", "0", "0.0", '""', "[]", "{}")


def list_given(c: Column) -> Column:
    """Whether a value coerced to a list has an item: all but null and the empty list."""
    return c.isNotNull() & ~F.trim(c).isin("null", "[]")


def number(c: Column) -> Column:
    """A JSON number as double; null for anything else."""
    return F.when(lit_empty(c).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), c.cast("double"))


def lenient(c: Column) -> Column:
    """F16. JSON text out of a model's answer: fence and surroundings go, control
    characters too where it does not parse with them; null if nothing parses."""
    inner = F.coalesce(F.nullif(F.regexp_extract(lit_empty(c), r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), lit_empty(c))
    inner = F.regexp_replace(inner, r"^\s+|\s+$", "")
    braces = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    plain = F.regexp_replace(braces, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    flat = F.regexp_replace(braces, r"[\x00-\x1f]", " ")
    out = F.when(F.try_parse_json(inner).isNotNull() & inner.startswith("{"), inner)
    for t in (braces, plain, flat):
        out = out.when((t != "") & F.try_parse_json(t).isNotNull(), t)
    return out


def extraction(c: Column) -> Column:
    """F17. The five fields of an extraction: trimmed strings, ordered distinct lists."""
    schema = "project_name string, technical_barriers array<string>, innovation_points array<string>, core_technology string, application_scene string"
    s = F.from_json(c, schema)
    text = lambda n: F.trim(lit_empty(s[n])).alias(n)
    items = lambda n: F.coalesce(ordered_distinct(s[n]), F.array().cast("array<string>")).alias(n)
    return F.struct(text("project_name"), items("technical_barriers"), items("innovation_points"), text("core_technology"), text("application_scene"))


def triggered_rules(c: Column) -> Column:
    """F12. Upper-cased rule ids of one object, a list of objects or a list of
    strings; broken JSON and items without an id give nothing."""
    text = F.trim(lit_empty(c))
    ok = F.try_parse_json(text).isNotNull()
    whole = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).when(text.startswith("["), text)
    raw = F.from_json(F.when(ok, whole), "array<string>")
    items = F.coalesce(raw, F.array().cast("array<string>"))
    ids = F.transform(items, lambda x: F.upper(F.trim(F.when(F.substring(x, 1, 1) == "{", F.get_json_object(x, "$.rule_id")).otherwise(x))))
    return F.filter(ids, lambda x: x.isNotNull() & (x != "") & ~x.startswith("["))


def rubric_rows(details: Column) -> Column:
    """F13. criterion, score, max_score, comment of a rubric given as map or list.

    The rubric is taken out of ``details`` and read once, and the members of an item together.
    """
    block = lambda d, k: once(F.get_json_object(d, k), lambda x: F.when(x != "", x))
    given = lambda d: F.coalesce(block(d, "$.rubric"), block(d, "$.rubric_scores"), block(d, "$.score_snapshot.rubric"))
    read = lambda j: F.from_json(j, "criterion string, score string, value string, max_score string, comment string")
    item = lambda x, name: F.struct(
        F.when(F.trim(name) != "", F.trim(name)).otherwise(F.lit("未命名维度")).alias("criterion"),
        F.coalesce(x["score"], x["value"], F.lit("0")).cast("double").alias("score"),
        F.coalesce(x["max_score"], F.lit("10")).cast("double").alias("max_score"),
        F.trim(lit_empty(x["comment"])).alias("comment"),
    )
    from_map = lambda g: F.transform(F.map_entries(F.from_json(g, "map<string,string>")), lambda e: once(read(e["value"]), lambda x: item(x, e["key"])))
    from_list = lambda g: F.transform(F.filter(F.from_json(g, "array<string>"), lambda j: j.startswith("{")), lambda j: once(read(j), lambda x: item(x, x["criterion"])))
    return once(details, lambda d: once(given(d), lambda g: F.when(g.startswith("{"), from_map(g)).when(g.startswith("["), from_list(g))))


#: The members that hold traces, in order.
TRACE_KEYS = ["evidence_trace", "student_quotes", "student_quote", "quoted_text", "source_excerpt", "evidence_snippet"]


def evidence_trace(details: Column) -> Column:
    """F14. Ordered distinct strings of the trace members, lists or single."""
    def one(k: str) -> Column:
        v = F.get_json_object(details, f"$.{k}")
        return F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))

    return ordered_distinct(F.concat(*(one(k) for k in TRACE_KEYS)))


def common_errors(details: Column) -> Column:
    """F15. error, count, impact; the diagnostics where no error is given.

    A list is taken out of ``details`` and read once, and the members of an item together.
    """
    none = F.array().cast("array<string>")
    items = lambda d, k: F.coalesce(F.from_json(F.get_json_object(d, k), "array<string>"), none)
    each = lambda d, k, members, make: F.transform(items(d, k), lambda j: once(F.from_json(j, members), make))
    text = lambda c: F.trim(lit_empty(c))
    some = lambda c: F.when(text(c) != "", text(c))
    row = lambda error, count, impact: F.struct(error.alias("error"), count.alias("count"), impact.alias("impact"))
    error = lambda x: row(F.coalesce(some(x["error"]), some(x["label"])), F.greatest(F.coalesce(x["count"].cast("int"), F.lit(1)), F.lit(1)), text(x["impact"]))
    # a diagnostic without a rule is left out
    told = lambda x: F.when(text(x["rule_id"]) != "", row(F.coalesce(some(x["trigger_message"]), some(x["rule_id"])), F.lit(1), text(x["fix_suggestion"])))
    given = lambda d: F.filter(each(d, "$.common_errors", "error string, label string, count string, impact string", error), lambda x: x["error"].isNotNull())
    fallback = lambda d: F.filter(each(d, "$.diagnostic_results", "rule_id string, trigger_message string, fix_suggestion string", told), lambda x: x.isNotNull())
    return once(details, lambda d: once(given(d), lambda g: F.when(F.size(g) > 0, g).otherwise(fallback(d))))


def card_ids(c: Column) -> Column:
    """F31. Distinct values of card id members at any depth."""
    single = F.regexp_extract_all(lit_empty(c), F.lit(r'"(?:card_id|knowledge_card_id|kg_card_id)"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1)
    lists = F.regexp_extract_all(lit_empty(c), F.lit(r'"knowledge_card_ids"\s*:\s*(\[[^\]]*\])'), 1)
    return ordered_distinct(F.concat(single, F.flatten(F.transform(lists, lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))))))


def resolve_class(details: Column, default: str = "默认班级") -> Column:
    """P5. The first non-empty of three members."""
    get = lambda k: F.nullif(F.trim(F.get_json_object(details, k)), F.lit(""))
    return F.coalesce(get("$.class_name"), get("$.class_id"), get("$.class"), F.lit(default))
