"""Profiles of destination lists and the best destination of each bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.filters import LIST, copyable, exclusion

NAME_SCORE = 0.1


def validate(playlists: DataFrame) -> DataFrame:
    """playlists and reason: null where the list may be a destination."""
    return playlists.withColumn("reason", exclusion())


def selected(requested: DataFrame, playlists: DataFrame) -> DataFrame:
    """Headers that were asked for; their own order, each once."""
    return playlists.join(requested.select(*LIST), LIST, "left_semi")


def not_found(requested: DataFrame, playlists: DataFrame) -> DataFrame:
    """Asked-for ids without a header; repeated requests repeat."""
    return requested.join(playlists.select(*LIST), LIST, "left_anti").withColumn("reason", F.lit("not found"))


def validate_destinations(requested: DataFrame, playlists: DataFrame, sources: DataFrame, proceeding: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Destinations and exclusions of the users in proceeding; the others stop before anything is validated.

    requested: user_id, playlist_id, asked (place in the request).  sources: user_id, source_id; a source is never a
    destination.  Destinations are headers in their own order; exclusions (user_id, playlist_id, name, reason, place) have those
    without a header first, in order of the request, then the others in order of the headers.
    """
    asked = requested.join(proceeding.select("user_id"), "user_id", "left_semi")
    told = validate(selected(asked, playlists)).join(sources.select("user_id", F.col("source_id").alias("__source")), "user_id", "left").where(~F.col("playlist_id").eqNullSafe(F.col("__source"))).drop("__source")
    lost = not_found(asked, playlists).select(*LIST, F.lit("").alias("name"), "reason", F.lit(0).alias("part"), F.col("asked").alias("at"))
    bad = told.where("reason is not null").select(*LIST, "name", "reason", F.lit(1).alias("part"), F.col("ordinal").alias("at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("part", "at"))
    return told.where("reason is null").drop("reason"), lost.unionByName(bad).select(*LIST, "name", "reason", place.alias("place"))


def genre_profile(assigned: DataFrame) -> DataFrame:
    """(user_id, playlist_id, bucket, n, share); no rows for a list without sortable items."""
    n = assigned.groupBy(*LIST, "bucket").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*LIST)))


def scores(buckets: DataFrame, destinations: DataFrame, profile: DataFrame) -> DataFrame:
    """(user_id, bucket, bucket_ordinal, playlist_id, ordinal, score) of each bucket with each destination of its user.

    A list without sortable items scores NAME_SCORE where its name holds a word of the bucket's.  At most 16 buckets a user.
    """
    filled = profile.groupBy(*LIST).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "share"))).alias("shares"))
    known = destinations.select(*LIST, "ordinal", "name").join(filled, LIST, "left")
    words = F.split(F.lower("bucket"), r"[\s/&]+")
    named = F.when(F.exists(words, lambda k: F.contains(F.lower("name"), k)), NAME_SCORE).otherwise(0.0)
    score = F.when(F.col("shares").isNull(), named).otherwise(F.coalesce(F.try_element_at("shares", F.col("bucket")), F.lit(0.0)))
    return buckets.select("user_id", "bucket", "bucket_ordinal").join(known, "user_id").select("user_id", "bucket", "bucket_ordinal", "playlist_id", "ordinal", score.alias("score"))


def positive(buckets: DataFrame, destinations: DataFrame, profile: DataFrame) -> DataFrame:
    """The rows of scores() above 0, without making the others: a list meets only the buckets of its profile, or of its name if it has none."""
    share = profile.select(*LIST, F.col("bucket").alias("held"), "share")
    known = destinations.select(*LIST, "ordinal", F.lower("name").alias("name")).join(share, LIST, "left")
    words = F.split(F.lower("bucket"), r"[\s/&]+")
    own = buckets.select("user_id", "bucket", "bucket_ordinal", words.alias("words"))
    named = F.col("held").isNull() & F.exists("words", lambda k: F.contains(F.col("name"), k))
    met = own.join(known.withColumnRenamed("user_id", "of"), (F.col("user_id") == F.col("of")) & ((F.col("held") == F.col("bucket")) | named))
    return met.select("user_id", "bucket", "bucket_ordinal", "playlist_id", "ordinal", F.coalesce("share", F.lit(NAME_SCORE)).alias("score"))


def best(scored: DataFrame) -> DataFrame:
    """(user_id, bucket, playlist_id, score): the highest score above 0, the earliest list on a tie."""
    top = F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "playlist_id")).alias("t")
    return scored.where("score > 0").groupBy("user_id", "bucket").agg(top).select("user_id", "bucket", F.col("t.playlist_id").alias("playlist_id"), F.col("t.score").alias("score"))


def unmatched(buckets: DataFrame, matched: DataFrame) -> DataFrame:
    return buckets.join(matched, ["user_id", "bucket"], "left_anti")


def replay_safe(destinations: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, playlist_id, n_copyable, n_items, safe): whether every item could be added again; an empty list is safe."""
    n = items.groupBy(*LIST).agg(F.count_if(copyable(F.col("track"))).alias("k"), F.count("*").alias("n"))
    joined = destinations.select(*LIST).join(n, LIST, "left")
    k, n = F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0))
    return joined.select(*LIST, k.alias("n_copyable"), n.alias("n_items"), (k == n).alias("safe"))
