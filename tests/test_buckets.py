"""Copy-on-write merges of keyed tables, and the state of students over restarts."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caselens.operators import casegraph, classroom
from caselens.sources.buckets import BucketStore, Keyed
from caselens.streaming import jobs, state

TABLE = {"t": Keyed("k bigint, name string, nation bigint, origin string", ("k",))}


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def plain(old, new):
    return casegraph.upsert(old, new, ["k"], "seq")


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), TABLE, buckets=40)
    schema = TABLE["t"].schema + ", seq bigint"
    store.merge({"t": spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("name"), F.lit(1).cast("long").alias("nation"), F.lit("o").alias("origin"), F.lit(1).cast("long").alias("seq"))}, {"t": plain})
    want = dict.fromkeys(range(2000), "a")
    for n in range(8):
        before = files(tmp_path / "data")
        store.merge({"t": spark.createDataFrame([(n * 7, f"b{n}", 2, "p", 1)], schema)}, {"t": plain}, n)
        want[n * 7] = f"b{n}"
        new = {p for p in files(tmp_path / "data") if p not in before}
        assert len(new) == 1 and len(new) < 0.05 * len(before)
        assert store.vacuum() == 1  # the bucket's former version
    assert {r.k: r.name for r in store.read("t").collect()} == want
    assert len(files(tmp_path / "data")) == len(store.manifest()["tables"]["t"]) == 40
    # a batch that runs again changes nothing
    version = store.manifest()["version"]
    assert store.merge({"t": spark.createDataFrame([(0, "again", 2, "p", 1)], schema)}, {"t": plain}, 7) == version
    assert {r.k: r.name for r in store.read("t").collect()} == want


def test_a_killed_batch_leaves_the_old_state(spark, tmp_path):
    both = TABLE | {"u": Keyed("k bigint, v string", ("k",))}
    store = BucketStore(spark, str(tmp_path), both, buckets=4)
    rows = lambda v: {"t": spark.createDataFrame([(1, v, 1, v, 1)], TABLE["t"].schema + ", seq bigint"), "u": spark.createDataFrame([(1, v, 1)], "k bigint, v string, seq bigint")}
    store.merge(rows("old"), {"t": plain, "u": plain}, 0)

    def dies(old, new):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):  # t is written, u is not
        store.merge(rows("new"), {"t": plain, "u": dies}, 1)
    assert store.read("t").first().name == "old" and store.read("u").first().v == "old"
    store.merge(rows("new"), {"t": plain, "u": plain}, 1)
    assert store.read("t").first().name == "new" and store.read("u").first().v == "new"
    assert store.read("t", 1).first().name == "old"  # a version that is kept
    store.vacuum()
    assert store._versions() == [2]


def test_rows_can_go_and_nothing_is_a_batch_too(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), TABLE, buckets=4)
    assert store.read("t").count() == 0 and store.vacuum() == 0 if store._versions() else store.read("t").count() == 0
    schema = TABLE["t"].schema
    store.merge({"t": spark.createDataFrame([(k, "a", 1, None) for k in range(20)], schema)}, {"t": lambda old, new: old.union(new)})
    store.merge({"t": spark.createDataFrame([(k, "a", 1, None) for k in range(20)], schema)}, {"t": lambda old, new: old.join(new, "k", "left_anti")})
    assert store.read("t").count() == 0 and store.manifest()["tables"]["t"] == {}
    store.merge({"t": spark.createDataFrame([], schema)}, {"t": lambda old, new: old.union(new)})
    assert store.read("t").count() == 0


@pytest.mark.parametrize(("keep", "create_only"), [((), ()), (("name",), ()), ((), ("origin", "name", "nation")), (("name",), ("origin",))])
def test_merge_variants(spark, tmp_path, keep, create_only):
    schema = TABLE["t"].schema + ", seq bigint"
    batches = [[(k, None if k % 3 == b else f"n{b}", b, f"o{b}", k) for k in range(b * 5, 30 + b)] for b in range(3)]
    store, want = BucketStore(spark, str(tmp_path), TABLE, buckets=8), {}
    for b, rows in enumerate(batches):
        store.merge({"t": spark.createDataFrame(rows, schema)}, {"t": lambda old, new: casegraph.upsert(old, new, ["k"], "seq", keep, create_only)}, b)
        for k, *values, _ in rows:
            old = want.get(k)
            want[k] = tuple(o if old and c in create_only else o if c in keep and v is None else v for c, v, o in zip(("name", "nation", "origin"), values, old or (None,) * 3))
    assert {r.k: (r.name, r.nation, r.origin) for r in store.read("t").collect()} == want


LOG = "student bigint, seq bigint, ts timestamp, rule_id string, role string, user_turn boolean, diagnosed boolean"


def turn(student, seq, role="user", hour=0, rule=None):
    return (student, seq, datetime(2024, 1, 1) + timedelta(hours=hour), rule, role, role == "user", rule is not None)


def test_stage_never_falls_over_restarts(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / x) for x in ("src", "out", "state"))
    batches = [
        [turn(1, 0), turn(1, 1, "assistant"), turn(2, 0), turn(3, 0, "assistant", rule="H4")],
        [turn(1, 4), turn(2, 2, "assistant")],
        [turn(1, 2), turn(4, 0)],  # turn 2 comes after turn 4
        [turn(2, 3), turn(3, 1)],
    ]
    seen = {}
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)
        jobs.latest_state(spark.readStream.schema(LOG).parquet(src), out, checkpoint, buckets=4).awaitTermination()  # each start is a restart
        for r in jobs.students(spark, out).collect():
            assert r.stage >= seen.get(r.student, 0)
            seen[r.student] = r.stage
    whole = spark.createDataFrame([x for b in batches for x in b], LOG).withColumnsRenamed({"student": "conv_id", "seq": "turn"})
    ever = F.max(F.col("diagnosed").cast("int")).over(classroom.Window.partitionBy("conv_id").orderBy("turn").rowsBetween(classroom.Window.unboundedPreceding, 0)) == 1
    staged = classroom.stage_progress(whole.withColumn("ever", ever), F.col("ever"))
    want = {r.conv_id: (r.turn, r.stage) for r in staged.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max("stage").alias("stage")).collect()}
    assert {r.student: (r.seq, r.stage) for r in jobs.students(spark, out).collect()} == want == {1: (4, 2), 2: (3, 1), 3: (1, 1), 4: (0, 0)}


def test_state_holds_the_live_students_only(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / x) for x in ("src", "out", "state"))
    sizes = []
    for day in range(3):
        rows = [turn(day * 10 + k, s, hour=24 * day + s) for k in range(10) for s in range(2)]
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)
        query = jobs.latest_state(spark.readStream.schema(LOG).parquet(src), out, checkpoint, idle="6 hours", buckets=4)
        query.awaitTermination()
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    assert sizes[-1] <= sizes[0] * 1.5  # and not three times the first day's
    got = jobs.students(spark, out).collect()
    assert len(got) == 30 and all((r.users, r.stage, r.seq) == (2, 1, 1) for r in got)
    # one who comes back after being forgotten keeps the stage
    spark.createDataFrame([turn(0, 9, "assistant", hour=200)], LOG).coalesce(1).write.mode("append").parquet(src)
    jobs.latest_state(spark.readStream.schema(LOG).parquet(src), out, checkpoint, idle="6 hours", buckets=4).awaitTermination()
    back = jobs.students(spark, out).where("student = 0").first()
    assert (back.seq, back.stage, back.users) == (9, 1, 2)
    assert state.UPDATE.startswith("student")
