"""Readers of landed page dumps, and the write that can clear a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm import schemas
from tonearm.operators.filters import LIST


def _rows(pages: DataFrame, name: str) -> DataFrame:
    """One row for each item of each page, null items too; the place is the page's offset and the index in it."""
    return pages.select("user_id", "playlist_id", "offset", F.posexplode("items").alias("at", name)).withColumn("position", F.col("offset") + F.col("at")).drop("offset", "at")


def liked_of(pages: DataFrame) -> DataFrame:
    return _rows(pages, "row").select("user_id", F.lit("liked").alias("playlist_id"), "position", F.col("row.track").alias("track"))


def items_of(pages: DataFrame) -> DataFrame:
    return _rows(pages, "row").select("user_id", "playlist_id", "position", F.col("row.item").alias("track"))


def headers_of(pages: DataFrame) -> DataFrame:
    p = F.col("p")
    rows = _rows(pages, "p").where(p.isNotNull())
    return rows.select("user_id", p["id"].alias("playlist_id"), F.col("position").alias("ordinal"), p["name"].alias("name"), p["owner"]["id"].alias("owner_id"), p["collaborative"].alias("collaborative"), p["snapshot_id"].alias("snapshot_id"), p["items"]["total"].alias("items_total"), p["tracks"]["total"].alias("tracks_total"))


def artists_of(batches: DataFrame) -> DataFrame:
    """(artist_id, genres): unknown artists are dropped, the last row of a repeated id wins."""
    rows = batches.select("seq", F.posexplode("artists").alias("at", "a")).where("a is not null")
    return rows.groupBy(F.col("a.id").alias("artist_id")).agg(F.max_by("a.genres", F.struct("seq", "at")).alias("genres"))


def liked_items(spark: SparkSession, path: str) -> DataFrame:
    return liked_of(spark.read.schema(schemas.LIKED_PAGE).json(path))


def playlist_items(spark: SparkSession, path: str) -> DataFrame:
    return items_of(spark.read.schema(schemas.ITEM_PAGE).json(path))


def playlists(spark: SparkSession, path: str) -> DataFrame:
    return headers_of(spark.read.schema(schemas.PLAYLIST_PAGE).json(path))


def artists(spark: SparkSession, path: str) -> DataFrame:
    return artists_of(spark.read.schema(schemas.ARTIST_BATCH).json(path))


def snapshots(headers: DataFrame) -> DataFrame:
    return headers.select(*LIST, F.col("snapshot_id").alias("actual"))


def append_items(items: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of `more` (user_id, playlist_id, rank, track) numbered behind what each list holds; lists without rows get none."""
    held = items.groupBy(*LIST).agg(F.count("*").alias("n"))
    return more.join(held, LIST, "left").select(*LIST, (F.coalesce("n", F.lit(0)) + F.col("rank")).alias("position"), "track")


def replace_items(items: DataFrame, affected: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """All items with the affected lists (user_id, playlist_id) replaced; an affected list without rebuilt rows is cleared."""
    return items.join(affected.select(*LIST).distinct(), LIST, "left_anti").unionByName(rebuilt)
