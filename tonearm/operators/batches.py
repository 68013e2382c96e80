"""Lists written batch by batch, with receipts, so that a broken write goes on where it stopped.

A list goes out in batches of SIZE, one after another: the first replaces, the others append.  Each try of a batch leaves a receipt.  A
rate-limited try is repeated RETRIES times at most, after a pause that doubles; any other error ends the list's write.  What
comes next follows from batches and receipts alone, for all lists at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators import positions
from tonearm.operators.filters import LIST

SIZE, RETRIES = 100, 3
#: Milliseconds: between two batches of a list, before the first repeated try, and the longest pause.
PACE, FIRST_PAUSE, LONGEST_PAUSE = 250, 250, 2000
COMPLETE, PENDING, FAILED = "complete", "pending", "failed"
BATCH = [*LIST, "batch_no"]


def cut(rows: DataFrame, lists: DataFrame, size: int = SIZE) -> DataFrame:
    """(user_id, playlist_id, batch_no, values) of rows (user_id, playlist_id, position from 0, uri); a list without rows is one empty batch."""
    held = positions.segments(rows, LIST, "uri", size).withColumnRenamed("segment", "batch_no")
    none = lists.select(*LIST).distinct().join(held.select(*LIST), LIST, "left_anti").select(*LIST, F.lit(0).cast("bigint").alias("batch_no"), F.array().cast("array<string>").alias("values"))
    return held.unionByName(none)


def progress(batches: DataFrame, receipts: DataFrame) -> DataFrame:
    """(user_id, playlist_id, n_batches, done, n_written, status, next_batch, attempt, wait_ms, snapshot, error) of each list.

    receipts: user_id, playlist_id, batch_no, attempt from 1, ok, limited, retry_after_ms, snapshot, error; those of batches after the
    first one that is not confirmed count for nothing.  attempt is the next try of next_batch; wait_ms is the pause before it.
    """
    tried = receipts.groupBy(*BATCH).agg(F.max("attempt").alias("tries"), F.bool_or("ok").alias("ok"), F.max_by(F.struct("limited", "retry_after_ms", "error"), "attempt").alias("last"), F.max(F.when(F.col("ok"), F.col("snapshot"))).alias("snapshot"))
    rows = batches.select(*BATCH, F.size("values").alias("n")).join(tried, BATCH, "left")
    # the first batch without a confirmation; batch numbers have no gaps
    open_ = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.struct("batch_no", "tries", "last")))
    found = rows.groupBy(*LIST).agg(F.count("*").alias("n_batches"), open_.alias("o"), F.collect_list(F.struct("batch_no", "n", "snapshot")).alias("all"))
    done = F.coalesce(F.col("o.batch_no"), F.col("n_batches"))
    sent = F.filter("all", lambda x: x["batch_no"] < done)
    tries = F.coalesce("o.tries", F.lit(0))
    over = tries.isNotNull() & (tries > 0) & (~F.coalesce("o.last.limited", F.lit(False)) | (tries > RETRIES))
    status = F.when(F.col("o").isNull(), COMPLETE).when(over, FAILED).otherwise(PENDING)
    pause = F.coalesce("o.last.retry_after_ms", F.least(F.lit(FIRST_PAUSE) * F.pow(F.lit(2.0), tries - 1), F.lit(LONGEST_PAUSE)).cast("bigint"))
    wait = F.when(tries > 0, pause).when(done > 0, PACE).otherwise(0)
    going = status == PENDING
    told = found.select(*LIST, "n_batches", done.alias("done"), F.aggregate(F.transform(sent, lambda x: x["n"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_written"), status.alias("status"), F.when(going, F.col("o.batch_no")).alias("next_batch"), F.when(going, tries + 1).alias("attempt"), F.when(going, wait).cast("bigint").alias("wait_ms"), F.array_max(F.filter(sent, lambda x: x["batch_no"] == done - 1))["snapshot"].alias("snapshot"), F.when(status == FAILED, F.col("o.last.error")).alias("error"))
    return told


def due(batches: DataFrame, receipts: DataFrame) -> DataFrame:
    """(user_id, playlist_id, batch_no, attempt, wait_ms, replaces, values): the next batch of each list that is not finished; the first one replaces."""
    going = progress(batches, receipts).where(F.col("status") == PENDING).select(*LIST, F.col("next_batch").alias("batch_no"), "attempt", "wait_ms")
    return batches.join(going, BATCH).select(*BATCH, "attempt", "wait_ms", (F.col("batch_no") == 0).alias("replaces"), "values")


def held(batches: DataFrame, receipts: DataFrame) -> DataFrame:
    """(user_id, playlist_id, position, uri) of what the lists hold after the confirmed batches."""
    sent = batches.join(progress(batches, receipts).select(*LIST, "done"), LIST).where(F.col("batch_no") < F.col("done"))
    before = F.col("batch_no") * F.max(F.size("values")).over(Window.partitionBy(*LIST))
    return sent.select(*LIST, before.alias("before"), F.posexplode("values").alias("at", "uri")).select(*LIST, (F.col("before") + F.col("at")).alias("position"), "uri")


def drive(batches: DataFrame, receipts: DataFrame, send: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Send what is due, round by round: in each round every unfinished list gets its next batch.  Returns all receipts.

    send: due rows to receipts.  keep: writes receipts to a table and reads it back, so that a restart finds them.  A restart is
    a call with the receipts kept so far; batches that were confirmed are never sent again.
    """
    for _ in range(rounds):
        now = due(batches, receipts)
        if now.isEmpty():
            break
        receipts = keep(receipts.unionByName(send(now)))
    return receipts
