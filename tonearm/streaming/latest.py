"""The latest action of each user as state of a stream, which goes when it expires.

Records of actions arrive in any order within the watermark: an action when it is made, and again when it is changed.  A user's state
is the record that was made last, and of it the version that was written last; an action stored again keeps its first expiry, and a
version written after that is ignored.  A user's latest action may be unusable: no older one takes its place.  What becomes of
the state is written as changes: one row for a user whose state a batch changed, one when it expires and leaves the store.

Defined results: of actions made at the same moment the larger id is the later; repeated records change nothing; records without
a user, an id or a time are left out; a record that is later than the watermark allows is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tonearm.operators.actions import LIFETIME, expires

HELD = "created bigint, action_id string, written bigint, payload string, expires_ms bigint"
FIELDS = ["created", "action_id", "written", "payload", "expires_ms"]
#: Spark keeps several states and timers a key in this store only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


class LatestAction(StatefulProcessor):
    """One record a user, and one timer at its expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("latest", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        best = before
        for some in rows:  # a user's records come in batches, in no order
            r = some.sort_values(FIELDS[:3]).iloc[-1]
            one = (int(r.created), r.action_id, int(r.written), None if pd.isna(r.payload) else r.payload, int(r.expires_ms))
            if best is None or one[:3] > best[:3]:
                best = one
        if best is not None and best != before:
            if before is None or before[4] != best[4]:
                if before is not None:
                    self.handle.deleteTimer(before[4])
                self.handle.registerTimer(best[4])
            self.held.update(best)
            yield self._change(key, best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held = tuple(self.held.get())
            if held[4] <= expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
                yield self._change(key, held, False)

    def close(self) -> None:
        pass

    def _change(self, key, held: tuple, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], **{name: [x] for name, x in zip(FIELDS, held, strict=True)}, "live": [live]})


def changes(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(user_id, created, action_id, written, payload, expires_ms, live) from a stream of user_id, action_id, created_at, written_at, payload.

    Times come out in microseconds.  delay: how much later than others a record may arrive.
    """
    named = records.where("user_id is not null and action_id is not null and created_at is not null and written_at is not null")
    timely = named.withColumn("expires_at", expires()).where("written_at < expires_at").withWatermark("written_at", delay)
    ms = F.ceil(F.unix_micros("expires_at") / 1000).cast("bigint")
    rows = timely.select("user_id", "written_at", F.unix_micros("created_at").alias("created"), F.col("action_id").cast("string").alias("action_id"), F.unix_micros("written_at").alias("written"), F.col("payload").cast("string").alias("payload"), ms.alias("expires_ms"))
    out = f"user_id {records.schema['user_id'].dataType.simpleString()}, {HELD}, live boolean"
    return rows.groupBy("user_id").transformWithStateInPandas(LatestAction(), out, "Append", "EventTime")


def run(records: DataFrame, path: str, delay: str = "1 hour") -> StreamingQuery:
    """Take in all that has arrived and end; state and offsets lie under `path`, so the next run goes on from there."""
    spark = records.sparkSession
    before = spark.conf.get(PROVIDER_KEY)
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    try:
        writer = changes(records, delay).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        started = writer.option("path", f"{path}/changes").option("checkpointLocation", f"{path}/state").start()
    finally:
        spark.conf.set(PROVIDER_KEY, before)
    started.awaitTermination()
    return started


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, action_id, created_at, written_at, payload, expires_at, live): the last change of each user that ever had an action."""
    rows = spark.read.parquet(f"{path}/changes")
    last = F.max_by(F.struct(*FIELDS, "live"), F.struct("created", "action_id", "written", ~F.col("live"))).alias("r")
    r = rows.groupBy("user_id").agg(last).select("user_id", "r.*").withColumn("created_at", F.timestamp_micros("created"))
    return r.select("user_id", "action_id", "created_at", F.timestamp_micros("written").alias("written_at"), "payload", (F.col("created_at") + F.expr(f"interval {LIFETIME}")).alias("expires_at"), "live")
