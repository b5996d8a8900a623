"""Keyed state of students in the RocksDB state store.

A student's state is the last row (by ``seq``), the number of user turns and the
stage, which never falls. Only students with new rows are read and written; with
``idle`` a student whose last row lies further back than that, by the watermark, is
closed and forgotten, so the store holds the live ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a batch says of each student that it has rows of, or that it closes.
UPDATE = "student bigint, seq bigint, rule_id string, ts timestamp, users bigint, stage int, closed boolean"
_STATE = "seq bigint, rule_id string, ts bigint, users bigint, stage int"


class StudentState(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("student", _STATE)

    def _row(self, key: tuple, state: tuple, closed: bool) -> pd.DataFrame:
        seq, rule, ts, users, stage = state
        return pd.DataFrame({"student": [key[0]], "seq": [seq], "rule_id": [rule], "ts": [None if ts is None else pd.Timestamp(ts, unit="us")], "users": [users], "stage": [stage], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, rule, ts, users, stage = self.state.get() if self.state.exists() else (None, None, None, 0, 0)
        seen = None
        for batch in rows:
            users += int(batch["user_turn"].fillna(False).astype(bool).sum())
            if batch["diagnosed"].fillna(False).astype(bool).any():
                stage = max(stage, 1)
            known = batch[batch["seq"].notna()]
            if len(known):
                last = known.loc[known["seq"].astype("int64").idxmax()]
                if seq is None or int(last["seq"]) >= seq:
                    seq, rule = int(last["seq"]), None if pd.isna(last["rule_id"]) else last["rule_id"]
                    ts = None if pd.isna(last["ts"]) else last["ts"].value // 1000
            newest = batch["ts"].max()
            if not pd.isna(newest):
                seen = newest.value // 1_000_000 if seen is None else max(seen, newest.value // 1_000_000)
        stage = max(stage, 2 if users >= 3 else 1 if users >= 2 else 0)
        self.state.update((seq, rule, ts, users, stage))
        if self.idle_ms is not None and seen is not None:
            # one timer a student, that of the newest row
            old = list(self.handle.listTimers())
            until = max([seen + self.idle_ms, *old])
            for at in old:
                if at != until:
                    self.handle.deleteTimer(at)
            if until not in old:
                self.handle.registerTimer(until)
        yield self._row(key, (seq, rule, ts, users, stage), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        self.state.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """A stream that starts inside keeps its state in RocksDB, with changelog checkpoints."""
    base = "spark.sql.streaming.stateStore."
    wanted = {base + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", base + "rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def student_updates(log: DataFrame, idle: str | None = None, late: str = "2 hours") -> DataFrame:
    """UPDATE for each student of a batch; output mode update, under ``rocksdb``.

    log: student, seq, ts, rule_id, and, as far as there are such columns, user_turn and
    diagnosed. Without ``idle`` no row is late and no student is closed; with it rows
    later than ``late`` are dropped.
    """
    has = lambda c: F.col(c) if c in log.columns else F.lit(False)
    rows = log.select(
        F.col("student").cast("bigint").alias("student"), F.col("seq").cast("bigint").alias("seq"), F.col("rule_id").cast("string").alias("rule_id"), F.col("ts").cast("timestamp").alias("ts"),
        has("user_turn").cast("boolean").alias("user_turn"), has("diagnosed").cast("boolean").alias("diagnosed"),
    )
    if idle is None:
        return rows.groupBy("student").transformWithStateInPandas(StudentState(None), UPDATE, "Update", "None")
    ms = rows.sparkSession.range(1).select(F.expr(f"unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {idle})")).first()[0]
    return rows.withWatermark("ts", late).groupBy("student").transformWithStateInPandas(StudentState(int(ms)), UPDATE, "Update", "EventTime")
