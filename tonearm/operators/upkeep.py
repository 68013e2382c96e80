"""Counts of lists kept up to date from what changed, instead of reading all items again.

The state is one row a list and bucket, and one a list.  Items that came and went change the counts by their number; where a
bucket's first item left and others stay, the new first place is looked up, in the lists concerned only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.filters import LIST, copyable

KEY = [*LIST, "bucket"]


def counted(assigned: DataFrame) -> DataFrame:
    """(user_id, playlist_id, bucket, n, first_position) of classified items (user_id, playlist_id, position, bucket)."""
    return assigned.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("position").alias("first_position"))


def changed(counts: DataFrame, added: DataFrame, removed: DataFrame, now: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The counts after items were added and removed; both are classified items of the changed lists.

    now: from lists (user_id, playlist_id) to their classified items after the change; it is asked for those lists only in which a
    bucket's first item left while others stay.  An item at the place of a removed one is an added one.
    """
    plus = added.groupBy(*KEY).agg(F.count("*").alias("more"), F.min("position").alias("first_added"))
    minus = removed.groupBy(*KEY).agg(F.count("*").alias("less"), F.min("position").alias("first_removed"))
    rows = counts.join(plus, KEY, "full").join(minus, KEY, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    stays = zero("n") - zero("less")
    rows = rows.select(*KEY, (stays + zero("more")).alias("n"), F.when(stays > 0, F.col("first_position")).alias("old"), "first_added", (F.coalesce(F.col("first_removed") <= F.col("first_position"), F.lit(False)) & (stays > 0)).alias("open"))
    lost = rows.where("open").select(*KEY)
    found = now(lost.select(*LIST).distinct()).join(lost, KEY, "left_semi").groupBy(*KEY).agg(F.min("position").alias("looked_up"))
    whole = rows.join(found, KEY, "left")
    first = F.when(F.col("open"), F.col("looked_up")).otherwise(F.least("old", "first_added"))
    return whole.where("n > 0").select(*KEY, "n", first.alias("first_position"))


def profile(counts: DataFrame) -> DataFrame:
    """counts and share: what part of its list's items a bucket has."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*LIST)))


def totals(items: DataFrame) -> DataFrame:
    """(user_id, playlist_id, n_copyable, n_items) of items (user_id, playlist_id, track)."""
    return items.groupBy(*LIST).agg(F.count_if(copyable(F.col("track"))).alias("n_copyable"), F.count("*").alias("n_items"))


def changed_totals(held: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """totals() after items were added and removed; a list that lost all its items stays, with zeros."""
    gone = totals(removed).select(*LIST, (-F.col("n_copyable")).alias("n_copyable"), (-F.col("n_items")).alias("n_items"))
    parts = held.select(*LIST, "n_copyable", "n_items").unionByName(totals(added)).unionByName(gone)
    return parts.groupBy(*LIST).agg(F.sum("n_copyable").alias("n_copyable"), F.sum("n_items").alias("n_items"))
