"""Streaming jobs run over the given tables to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.bindings import scratch
from caselens.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("student"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("rule_id"))


def _finish(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote: in complete mode the last batch.
    Each batch has a folder by its number, so one that runs again writes the same rows once."""
    spark = df.sparkSession
    base = scratch(spark, "stream")
    # without an event-time column a result may be written in full
    write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{base}/out")
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{base}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("__batch"))
        rows = rows.join(F.broadcast(last), F.col("batch") == F.col("__batch")).drop("__batch")  # one row
    return rows.drop("batch")


def x1_rule_hits(spark, sf_dir):
    return _finish(jobs.rule_hits(_log(spark, sf_dir)), "complete")


def x2_windowed_hits(spark, sf_dir):
    return _finish(jobs.windowed_hits(_log(spark, sf_dir), "1 day"), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "rule_id", "hits")


def x3_sessions(spark, sf_dir):
    rows = _finish(jobs.sessions(_log(spark, sf_dir), "6 hours"), "complete")
    return rows.select("student", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "turns")


def x2_closed_windows(spark, sf_dir):
    """Each day once, when the watermark has passed its end."""
    return _finish(jobs.windowed_hits(_log(spark, sf_dir), "1 day"), "append").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "rule_id", "hits")


def x3_closed_sessions(spark, sf_dir):
    """Each session once, when the watermark has passed its end."""
    rows = _finish(jobs.sessions(_log(spark, sf_dir), "6 hours"), "append")
    return rows.select("student", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "turns")


def x4_latest_state(spark, sf_dir):
    base = scratch(spark, "stream")
    jobs.latest_state(_log(spark, sf_dir), f"{base}/out", f"{base}/state").awaitTermination()
    return jobs.students(spark, f"{base}/out").select("student", "seq", "rule_id")


def x4_stages(spark, sf_dir):
    """Each conversation's last turn, user turns and stage, from state: W5 as a stream."""
    base = scratch(spark, "stream")
    turns = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("student"), F.col("turn").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("rule_id"), (F.col("role") == "user").alias("user_turn"))
    jobs.latest_state(turns, f"{base}/out", f"{base}/state").awaitTermination()
    return jobs.students(spark, f"{base}/out").select("student", "seq", "users", "stage")


def x5_interventions(spark, sf_dir):
    """Groups of four events as interventions: a purchase executes one, the others ask for it."""
    base = scratch(spark, "stream")
    e = _stream(spark, sf_dir, "events")
    done = F.col("event_type") == "purchase"
    rows = e.select(
        F.shiftright("event_id", 2).alias("id"), F.when(~done, F.col("user_id").cast("string")).alias("target_id"), F.when(~done, F.col("event_type")).alias("content"),
        F.when(done, "execute").otherwise("insert").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
    )
    jobs.interventions(rows, f"{base}/out", f"{base}/state").awaitTermination()
    return jobs.queue(spark, f"{base}/out").select("id", "target_id", "content", "status")


def x7_labelled(spark, sf_dir):
    return _finish(jobs.labelled(_stream(spark, sf_dir, "conversations")), "append").select("conv_id", "turn", "blocked", "route")


QUERIES = {f.__name__: f for f in (x1_rule_hits, x2_windowed_hits, x2_closed_windows, x3_sessions, x3_closed_sessions, x4_latest_state, x4_stages, x5_interventions, x7_labelled)}

_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS student, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS turns FROM s GROUP BY user_id, k"""
_RULE = "CASE WHEN event_type <> 'signup' THEN event_type END AS rule_id"
ORACLE_SQL = {
    "x1_rule_hits": "SELECT event_type AS rule_id, count(*) AS hits FROM events WHERE event_type <> 'signup' GROUP BY 1",
    "x2_windowed_hits": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS rule_id, count(*) AS hits FROM events WHERE event_type <> 'signup' GROUP BY ALL",
    "x2_closed_windows": """WITH e AS (SELECT ts, event_type FROM events WHERE event_type <> 'signup')
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS rule_id, count(*) AS hits FROM e
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM e) GROUP BY ALL""",
    "x3_sessions": _SESSIONS,
    "x3_closed_sessions": _SESSIONS + " HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
    "x4_latest_state": f"SELECT user_id AS student, event_id AS seq, {_RULE} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "x4_stages": "SELECT conv_id AS student, max(turn) AS seq, count(*) FILTER (role = 'user') AS users, CAST(least(greatest(count(*) FILTER (role = 'user') - 1, 0), 2) AS INT) AS stage FROM conversations GROUP BY conv_id",
    "x5_interventions": """SELECT event_id // 4 AS id, arg_max(CAST(user_id AS VARCHAR), event_id) FILTER (event_type <> 'purchase') AS target_id, arg_max(event_type, event_id) FILTER (event_type <> 'purchase') AS content,
CASE WHEN bool_or(event_type = 'purchase') THEN 'executed' ELSE 'pending' END AS status FROM events GROUP BY 1""",
    "x7_labelled": "SELECT conv_id, turn, CASE WHEN trim(text) <> '' AND (regexp_matches(trim(text), '�|Ã.|Â.|Ð.|Ñ.|Ê.|Õ.|æ.|å.|ç.|þ.|¤') OR len(regexp_extract_all(trim(text), '[\\p{Cc}�]')) * 10 >= length(trim(text))) THEN 'garbled_text' ELSE '' END AS blocked, 'Error' AS route FROM conversations",
}
