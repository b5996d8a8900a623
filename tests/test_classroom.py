import json

from caselens.operators import classroom as C


def test_behaviour_to_profile(spark):
    d = [
        {"user_id": "u1", "class": "2", "stage": "idea", "timestamp": "t1", "diagnostic_results": [{"rule_id": "h1", "severity": "High"}, {"rule_id": "H8"}, {"rule_id": ""}]},
        {"user_id": "u1", "class": "2", "timestamp": "t2", "score_snapshot": {"overall_score": 3.5}},
        {"project_upload_name": "P"},
    ]
    rows = [("INFO", "m", json.dumps(x), k) for k, x in enumerate(d)] + [("ERROR", "m", json.dumps(d[0]), 9), ("info", "m", None, 10)]
    log = C.flatten_behaviour(spark.createDataFrame(rows, "level string, message string, details string, seq bigint"))
    got = {r.student: r for r in C.latest_state(log).collect()}
    assert set(got) == {"u1", "P"}
    assert (got["u1"].latest_stage, got["u1"].latest_score, got["u1"].rule_ids, got["u1"].n_rules, got["u1"].latest_class_name) == ("idea", 3.5, "H1,H8", 2, "2")
    assert got["P"].latest_class_name == "默认班级"
    assert C.in_class(log, "2").count() == 3 and C.in_class(log).count() == 4
    assert {(r.rule_id, r.dimension) for r in C.rule_frame(log).collect()} == {("H1", "商业"), ("H8", "商业")}


def test_class_rate(spark):
    rows = [(f"s{k}", "A", "H10" if k < 2 else None) for k in range(5)]
    r = C.class_cluster(spark.createDataFrame(rows, "student string, class_name string, rule_id string")).first()
    assert (r.students, r.failed, r.rate) == (5, 2, 0.4)


def test_fallback_and_drilldown(spark):
    a = spark.createDataFrame([("s", "x", 1.0)], "student string, criterion string, score double")
    b = spark.createDataFrame([("s", "old", 9.0), ("t", "old", 2.0)], a.schema)
    rows = C.teacher_rubric(a, b)
    assert {(r.student, r.criterion) for r in rows.collect()} == {("s", "x"), ("t", "old")}
    state = spark.createDataFrame([("s", 3, "mvp"), ("u", 0, None)], "student string, n_rules bigint, latest_stage string")
    assert {r.student: r.mean_score for r in C.drilldown(state, rows).collect()} == {"s": 1.0, "u": None}
