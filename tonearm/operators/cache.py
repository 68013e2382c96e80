"""The artist table: what is fresh, what is missing, what a run may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL = "14 days"


def fresh(requested: DataFrame, cached: DataFrame, as_of: Column) -> DataFrame:
    """Cached rows of requested artists, fetched TTL ago at most (that moment included)."""
    return cached.where(F.col("last_fetched_at") >= as_of - F.expr(f"interval {TTL}")).join(requested.select("artist_id"), "artist_id", "left_semi")


def missing(requested: DataFrame, fresh_rows: DataFrame) -> DataFrame:
    return requested.join(fresh_rows.select("artist_id"), "artist_id", "left_anti")


def upsert_latest(rows: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """One row a key: the latest by `at`, the larger values on a tie."""
    last = F.max(F.struct(at, *values)).alias("r")
    return rows.groupBy(key).agg(last).select(key, F.col(f"r.{at}").alias(at), *(F.col(f"r.{v}").alias(v) for v in values))


def effective(fresh_rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """(artist_id, genres): fetched rows win over fresh ones; stale rows are never used."""
    both = fresh_rows.select("artist_id", "genres", F.lit(0).alias("w")).unionByName(fetched.select("artist_id", "genres", F.lit(1).alias("w")))
    return both.groupBy("artist_id").agg(F.max_by("genres", "w").alias("genres"))


def refresh(requested: DataFrame, cached: DataFrame, fetched: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a run may use (artist_id, genres), what it has to ask for (artist_id), and the table as it is afterwards.

    requested: artist_id, empty and repeated ids allowed.  cached: artist_id, genres, last_fetched_at.  fetched: artist_id,
    genres of the artists that an answer came for; what is not answered stays as it was and is not used if stale.
    """
    wanted = requested.where("artist_id <> ''").select("artist_id").distinct()
    good = fresh(wanted, cached, as_of)
    ask = missing(wanted, good)
    got = fetched.join(ask, "artist_id", "left_semi").select("artist_id", "genres").withColumn("last_fetched_at", as_of)
    return effective(good, got), ask, cached.join(got, "artist_id", "left_anti").unionByName(got)


def upsert_profiles(stored: DataFrame, new: DataFrame, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Profiles by user_id: new values replace old ones, null ones too, but for the columns in keep_if_null."""
    cols = [c for c in stored.columns if c != "user_id"]
    value = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keep_if_null else F.when(F.col("n.seen"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    joined = stored.alias("o").join(new.withColumn("seen", F.lit(True)).alias("n"), "user_id", "full")
    return joined.select("user_id", *(value(c).alias(c) for c in cols))
