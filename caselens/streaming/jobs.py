"""Structured Streaming over the append-only flows of the domain.

``log`` streams have student, rule_id, ts, session and seq; every job takes a
streaming DataFrame and leaves starting, triggers and checkpoints to the caller,
but for the two that write keyed state.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caselens.operators.retrieval import guardrail, route
from caselens.sources.buckets import BucketStore, Keyed
from caselens.sources.files import extracted
from caselens.streaming.state import rocksdb, student_updates


def rule_hits(log: DataFrame) -> DataFrame:
    """X1. rule_id, hits over the whole stream; output mode complete."""
    return log.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("hits"))


def windowed_hits(log: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """X2. rule_id and hits of each tumbling or sliding window; rows later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    hits = log.where("rule_id IS NOT NULL").withWatermark("ts", late).groupBy(w.alias("w"), "rule_id").agg(F.count("*").alias("hits"))
    return hits.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rule_id", "hits")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """X3. student, first, last, turns of each session: a gap ends it."""
    s = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "student").agg(F.count("*").alias("turns"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.select("student", "first", "last", "turns")


def labelled(messages: DataFrame) -> DataFrame:
    """X7. Guardrail and route of each message; stateless."""
    return messages.withColumn("blocked", guardrail(F.col("text"))).withColumn("route", route(F.col("role"), F.col("text")))


#: X4. A student's last row, user turns and stage. X5. A queue of interventions.
STUDENTS = {"students": Keyed("student bigint, seq bigint, rule_id string, ts timestamp, users bigint, stage int", ("student",))}
QUEUE = {"interventions": Keyed("id bigint, target_id string, content string, status string, ts timestamp", ("id",))}


def latest_state(log: DataFrame, path: str, checkpoint: str, idle: str | None = None, buckets: int = 64) -> StreamingQuery:
    """X4, W5. The last row, user turns and stage of each student: state in RocksDB
    (``student_updates``), and a bucketed table of which a batch rewrites the buckets that
    it has students in. A student who comes back after being closed keeps the stage."""

    def merge(batch: DataFrame, number: int) -> None:
        store = BucketStore(batch.sparkSession, path, STUDENTS, buckets)
        last = batch.groupBy("student").agg(F.max_by(F.struct("seq", "rule_id", "ts", "users", "stage"), F.struct("users", "seq")).alias("x")).select("student", "x.*")
        store.merge({"students": last}, {"students": newest_students}, number)
        store.vacuum()

    with rocksdb(log.sparkSession):
        updates = student_updates(log, idle)
        return updates.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_students(old: DataFrame, new: DataFrame) -> DataFrame:
    """The row of the greater ``seq`` of each student; user turns and stage of either, whichever is further."""
    last = F.max_by(F.struct("seq", "rule_id", "ts"), "seq").alias("x")
    return old.unionByName(new).groupBy("student").agg(last, F.max("users").alias("users"), F.max("stage").alias("stage")).select("student", "x.*", "users", "stage")


def students(spark: SparkSession, path: str) -> DataFrame:
    return BucketStore(spark, path, STUDENTS).read("students")


def interventions(events: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """X5. id, target_id, content, status, ts: inserted as pending, executed once and for good.

    events: id, target_id, content, kind (insert or execute), ts, seq.
    """

    def combine(old: DataFrame, rows: DataFrame) -> DataFrame:
        both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(rows)
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        status = F.when(F.bool_or(F.col("status") == "executed"), "executed").otherwise("pending").alias("status")
        return both.groupBy("id").agg(last("target_id"), last("content"), status, last("ts"))

    def merge(batch: DataFrame, number: int) -> None:
        executed = F.col("kind") == "execute"
        rows = batch.select(
            F.col("id").cast("bigint"), F.col("target_id").cast("string"), "content", F.when(executed, "executed").otherwise("pending").alias("status"),
            F.col("ts").cast("timestamp"), F.col("seq").cast("long").alias("seq"),
        )
        store = BucketStore(batch.sparkSession, path, QUEUE, buckets)
        store.merge({"interventions": rows}, {"interventions": combine}, number)
        store.vacuum()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue(spark: SparkSession, path: str) -> DataFrame:
    return BucketStore(spark, path, QUEUE).read("interventions")


def ingest_files(spark: SparkSession, path: str, out: str, failures: str, checkpoint: str) -> StreamingQuery:
    """X6. Files of any kind that S10, S11, S12 and S13 read, dropped into ``path``: path, text
    and encoding go to ``out``, path and error of unreadable ones (P10) to ``failures``; the
    checkpoint keeps files that are done from being read again. Spark's file sources list no
    file of no bytes, so such a file is in neither table."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(path)

    def write(batch: DataFrame, number: int) -> None:
        rows = extracted(batch).withColumn("batch", F.lit(number)).persist(StorageLevel.DISK_ONLY)  # read once for both tables
        parts = ((out, rows.where("error IS NULL").drop("error")), (failures, rows.where("error IS NOT NULL").select("path", "error", "batch")))
        for name, part in parts:
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(name)
        rows.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
