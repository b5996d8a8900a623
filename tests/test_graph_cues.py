"""Cues are found once for each node, before any shuffle, and the roles of a case are read once."""

from pyspark.sql import functions as F

from caselens.functions import text as X
from caselens.operators import casegraph
from caselens.plans import casegraphs


def test_cues_as_matches_cues_says(spark):
    words = ["Customer", "go-to  market", "go market to", "pain...POINT", "pain and point", "pmf", "Value-proposition", "students", "vs.", "", None, "GTM", "re-port", "Ärger, survey", "go to\nmarket plan", "problem / solution"]
    rows = spark.createDataFrame([(a, b, [a or ""]) for a in words for b in words], "name string, description string, tags array<string>")
    texts = casegraph.cue_texts()
    each = F.array_compact(F.array(*(F.when(X.matches_cues(texts, w), F.lit(n)) for n, w in casegraph.CUES.items())))
    found = rows.select(X.cues_found(texts, casegraph.CUES).alias("a"), each.alias("b"))
    assert found.where("a <> b").count() == 0 and found.where("size(a) > 0").count() > 100


def test_loops_in_nested_order(spark):
    ids = {"customer": 3, "value": 2, "channel": 5}
    rows = [(case, role, f"{role[0]}{k}", k) for case in ("A", "B", None) for role, n in ids.items() for k in range(n) if (case, role) != ("B", "value")]
    got = casegraph.value_loops(spark.createDataFrame(rows, "case_id string, role string, id string, seq long")).orderBy("k").collect()
    want = [(f"c{c}", f"v{v}", f"c{h}") for c in range(3) for v in range(2) for h in range(5)][: casegraph.MAX_LOOPS]
    assert [(r.customer, r.value, r.channel) for r in got] == want and [r.k for r in got] == list(range(1, 13)) and {r.case_id for r in got} == {"A"}


def test_documents_are_read_a_few_times_and_texts_are_not_shuffled(spark, sf_dir, capsys):
    casegraphs.g4_value_loops(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    # own nodes, the ids that they have, and twice the inferred ones
    assert plan.count("Scan parquet") // 2 <= 4
    exchanged = [x for x in plan.split("\n\n") if " Exchange" in x.split("\n")[0] and "SinglePartition" not in x and "RoundRobin" not in x]
    assert exchanged and not any("description#" in x or "text#" in x for x in exchanged)
