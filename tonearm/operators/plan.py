"""Plans of lists to write: (user_id, playlist_id, position, uri) rows, and what a run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.filters import LIST, copyable

COPY_SUFFIX = " — Copy"
BACKUP_SUFFIX = " — Backup"
NOT_SAFE = "the list holds items that could not be written again, so a direct change could not be undone"
NO_SOURCE = "source not found"


def list_id(kind: str, *keys: str) -> Column:
    """A stable id of a list to be made."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *(F.col(k).cast("string") for k in keys)), 256)


def new_lists(rows: DataFrame, kind: str, name: Column, *keys: str) -> DataFrame:
    """Headers (user_id, playlist_id, name, owner_id, collaborative, public) of lists to be made: always private."""
    own = rows.select("user_id", list_id(kind, *keys).alias("playlist_id"), name.alias("name"))
    return own.distinct().select("*", F.col("user_id").alias("owner_id"), F.lit(False).alias("collaborative"), F.lit(False).alias("public"))


def candidates(assigned: DataFrame, buckets: DataFrame) -> DataFrame:
    """(user_id, bucket, bucket_ordinal, position, uri) of the source's items."""
    return assigned.select("user_id", "bucket", "position", "uri").join(buckets.select("user_id", "bucket", "bucket_ordinal"), ["user_id", "bucket"])


def auto_create(assigned: DataFrame, buckets: DataFrame) -> DataFrame:
    """A new private list for every bucket, Other too."""
    rows = candidates(assigned, buckets)
    at = F.row_number().over(Window.partitionBy("user_id", "bucket").orderBy("position")) - 1
    return rows.select("user_id", "bucket", list_id("auto", "user_id", "bucket").alias("list_id"), at.alias("position"), "uri")


def _concat(base: DataFrame, more: DataFrame) -> DataFrame:
    """Base items, then candidates by bucket and place, numbered through."""
    a = base.select(*LIST, F.lit(0).alias("segment"), F.lit(0).alias("bucket_ordinal"), "position", "uri")
    b = more.select(*LIST, F.lit(1).alias("segment"), "bucket_ordinal", "position", "uri")
    at = F.row_number().over(Window.partitionBy(*LIST).orderBy("segment", "bucket_ordinal", "position")) - 1
    return a.unionByName(b).select(*LIST, at.alias("position"), "segment", "uri")


def base_items(destinations: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, playlist_id, position, uri) of the copyable items of some lists, dealt by user, as the rows are that they meet."""
    kept = items.where(copyable(F.col("track"))).select(*LIST, "position", F.col("track.uri").alias("uri"))
    return kept.repartition("user_id").join(destinations.select(*LIST).repartition("user_id"), LIST, "left_semi")


def safe_copy(matched: DataFrame, assigned: DataFrame, buckets: DataFrame, items: DataFrame) -> DataFrame:
    """Each matched original once: its copyable items, then its buckets' items."""
    more = candidates(assigned, buckets).join(matched.select("user_id", "bucket", "playlist_id"), ["user_id", "bucket"])
    return _concat(base_items(matched, items), more)


def direct(matched: DataFrame, assigned: DataFrame, buckets: DataFrame, safety: DataFrame) -> DataFrame:
    """Rows to append to replay-safe originals, numbered behind what they hold."""
    ok = matched.join(safety.where("safe").select(*LIST, "n_items"), LIST)
    more = candidates(assigned, buckets).join(ok.select("user_id", "bucket", "playlist_id", "n_items"), ["user_id", "bucket"])
    at = F.row_number().over(Window.partitionBy(*LIST).orderBy("bucket_ordinal", "position")) - 1
    return more.select(*LIST, (F.col("n_items") + at).alias("position"), "uri")


def refused(safety: DataFrame, reason: str = NOT_SAFE) -> DataFrame:
    """(user_id, playlist_id, refusal): lists that a direct run never writes."""
    return safety.where("not safe").select(*LIST, F.lit(reason).alias("refusal"))


def backup(sources: DataFrame, items: DataFrame, suffix: str = BACKUP_SUFFIX) -> DataFrame:
    """A copy of the source's copyable items."""
    at = F.row_number().over(Window.partitionBy(*LIST).orderBy("position")) - 1
    named = sources.select(*LIST, F.concat("name", F.lit(suffix)).alias("name"), list_id("backup", *LIST).alias("list_id"))
    return base_items(sources, items).withColumn("position", at).join(named, LIST).select("user_id", "name", "list_id", "position", "uri")


def backup_status(asked: DataFrame, headers: DataFrame, items: DataFrame, suffix: str = BACKUP_SUFFIX) -> DataFrame:
    """(user_id, playlist_id, list_id, name, tracks_copied, status) of each source (user_id, playlist_id) to be backed up.

    A source without a header aborts its run before anything is written.
    """
    n = base_items(asked, items).groupBy(*LIST).agg(F.count("*").alias("n"))
    rows = asked.select(*LIST).join(headers.select(*LIST, "name", F.lit(True).alias("there")), LIST, "left").join(n, LIST, "left")
    there = F.coalesce("there", F.lit(False))
    return rows.select(*LIST, F.when(there, list_id("backup", *LIST)).alias("list_id"), F.when(there, F.concat(F.coalesce("name", F.lit("")), F.lit(suffix))).alias("name"), F.when(there, F.coalesce("n", F.lit(0))).otherwise(0).alias("tracks_copied"), F.when(there, "success").otherwise(NO_SOURCE).alias("status"))


def runs(asked: DataFrame, backups: DataFrame, assigned: DataFrame) -> DataFrame:
    """(user_id, playlist_id, n_sortable, outcome) of each run: aborted, empty (backed up, if asked, and nothing else) or sorted."""
    n = assigned.groupBy(*LIST).agg(F.count("*").alias("n"))
    bad = backups.where(F.col("status") == NO_SOURCE).select(*LIST, F.lit(True).alias("bad"))
    rows = asked.select(*LIST).join(n, LIST, "left").join(bad, LIST, "left")
    outcome = F.when(F.col("bad"), "aborted").when(F.col("n").isNull(), "empty").otherwise("sorted")
    return rows.select(*LIST, F.coalesce("n", F.lit(0)).alias("n_sortable"), outcome.alias("outcome"))


def copy_name(names: str = "safe_copy_names") -> Column:
    """The name asked for, else the original's with a suffix."""
    return F.coalesce(F.try_element_at(F.col(names), F.col("playlist_id").cast("string")), F.concat("name", F.lit(COPY_SUFFIX)))


def ledger(buckets: DataFrame, matched: DataFrame, receipts: DataFrame, refusals: DataFrame | None = None) -> DataFrame:
    """(user_id, bucket, playlist_id, n, status, tracks_added, reason, result_ordinal): unmatched buckets first.

    A failed write or a refused list fails exactly its own buckets; failed buckets add no tracks but keep theirs listed.
    """
    rows = buckets.select("user_id", "bucket", "bucket_ordinal", "n").join(matched.select("user_id", "bucket", "playlist_id"), ["user_id", "bucket"], "left").join(receipts.select(*LIST, "ok", "error"), LIST, "left")
    rows = rows.join(refusals, LIST, "left") if refusals is not None else rows.withColumn("refusal", F.lit(None).cast("string"))
    ok = F.col("playlist_id").isNotNull() & F.col("refusal").isNull() & F.coalesce("ok", F.lit(False))
    reason = F.when(F.col("playlist_id").isNull(), "no matching playlist").when(~ok, F.coalesce("refusal", "error", F.lit("not written")))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("playlist_id").isNotNull(), "bucket_ordinal"))
    return rows.select("user_id", "bucket", "playlist_id", "n", F.when(ok, "success").otherwise("failed").alias("status"), F.when(ok, F.col("n")).otherwise(0).alias("tracks_added"), reason.alias("reason"), order.alias("result_ordinal"))


def ledger_totals(results: DataFrame) -> DataFrame:
    good = F.col("status") == "success"
    return results.groupBy("user_id").agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("tracks_added")).otherwise(0)).alias("tracks_added"))


def unique_copies(results: DataFrame) -> DataFrame:
    """(user_id, playlist_id, bucket): each list once, with the bucket that named it first."""
    first = F.min(F.struct("result_ordinal", "bucket"))["bucket"].alias("bucket")
    return results.where("status = 'success'").groupBy(*LIST).agg(first)
