"""Long texts are normalised, and JSON details read, once for all that is asked of them."""

import pytest
from pyspark.sql import functions as F

from caselens.functions import json as J
from caselens.functions import text as X
from caselens.operators import ingest, rules


def used(spark, column, name):
    plan = spark.createDataFrame([("a", "b")], "text string, name string").select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    return plan.count(name)


def test_industry_normalises_once(spark):
    column = ingest.industry(F.col("text"), F.col("name"), {f"g{k}": [f"w{k}", f"v{k}"] for k in range(9)})
    assert used(spark, column, "regexp_replace(") == 1
    rows = spark.createDataFrame([(" W1, v3-w3 x",), ("none",), (None,), ("行业: 教育\nw1",)], "text string")
    got = [r.x for r in rows.select(ingest.industry(F.col("text"), F.lit(""), {f"g{k}": [f"w{k}", f"v{k}"] for k in range(9)}).alias("x")).collect()]
    assert got == ["g3", None, None, "教育"]


@pytest.mark.parametrize("make", [J.rubric_rows, J.common_errors])
def test_details_are_made_once(spark, make):
    assert used(spark, make(F.upper("name")), "upper(") == 1


def test_items_of_details(spark):
    rows = spark.createDataFrame([
        ('{"common_errors": [{"error": " e ", "count": 3, "impact": " i"}, {"label": "l"}, {"error": ""}, 5, "s"]}',),
        ('{"common_errors": [], "diagnostic_results": [{"rule_id": "H1", "trigger_message": "m", "fix_suggestion": "f"}, {"rule_id": " H2 "}, {"trigger_message": "no rule"}]}',),
        ("{}",), ("broken",), (None,),
    ], "d string")
    got = [[tuple(x) for x in r.x] for r in rows.select(J.common_errors(F.col("d")).alias("x")).collect()]
    assert got == [[("e", 3, "i"), ("l", 1, "")], [("m", 1, "f"), ("H2", 1, "")], [], [], []]
    rows = spark.createDataFrame([('{"rubric": {"a": {"score": 2, "comment": " c "}, " ": {"value": "3", "max_score": 5}, "n": 7}}',), ('{"rubric": "", "rubric_scores": [{"criterion": "k", "score": 1.5}, 5, {}]}',), ("{}",)], "d string")
    got = [r.x and [tuple(x) for x in r.x] for r in rows.select(J.rubric_rows(F.col("d")).alias("x")).collect()]
    assert got == [[("a", 2.0, 10.0, "c"), ("未命名维度", 3.0, 5.0, ""), ("n", 0.0, 10.0, "")], [("k", 1.5, 10.0, ""), ("未命名维度", 0.0, 10.0, "")], None]


def test_topics_of_a_case_without_patterns(spark):
    flags = rules._flags(F.col("text"), list(rules.KEYWORDS))
    assert all(used(spark, f, "RLIKE") == 0 for f in flags[:3])
    texts = spark.createDataFrame([("the customer pays",), ("a.b|c",), (None,)], "text string")
    assert [tuple(r) for r in texts.select(X.has_any(F.col("text"), ["customer", "x"]), X.has_any(F.col("text"), [".b|"])).collect()] == [(True, False), (False, True), (None, None)]
