"""Projections and predicates on items, headers and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What tells a list apart: one list may stand in the libraries of several users.
LIST = ["user_id", "playlist_id"]
#: White space, the no-break space, the other Unicode blanks and the byte order mark included.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BLANK = f"^{SPACE}*$"


def trimmed(text: Column) -> Column:
    """The text without any kind of white space at its ends; the built-in trim knows the plain space only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def units(text: Column) -> Column:
    """Length in UTF-16 units, where characters beyond the first 65,536 count twice."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def copyable(track: Column) -> Column:
    """The track exists, is not local, not known to be unplayable, and has an id and a uri."""
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    return track.isNotNull() & ~F.coalesce(track["is_local"], F.lit(False)) & F.coalesce(track["is_playable"], F.lit(True)) & text(track["id"]) & text(track["uri"])


def sortable(track: Column) -> Column:
    """Copyable, with an artist at least."""
    return copyable(track) & (F.coalesce(F.size(track["artists"]), F.lit(0)) > 0)


def summary(track: Column) -> Column:
    return F.struct(track["id"].alias("id"), track["name"].alias("name"), F.transform(track["artists"], lambda a: a["name"]).alias("artists"), F.coalesce(track["album"]["name"], F.lit("")).alias("album"), F.coalesce(track["url"], F.lit("")).alias("url"))


def copyable_uris(items: DataFrame) -> DataFrame:
    """(user_id, playlist_id, uris): order and duplicates kept."""
    rows = items.where(copyable(F.col("track"))).groupBy("user_id", "playlist_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("track.uri").alias("uri")))).alias("r"))
    return rows.select("user_id", "playlist_id", F.transform("r", lambda x: x["uri"]).alias("uris"))


def item_count(playlists: DataFrame) -> Column:
    return F.coalesce("items_total", "tracks_total")


def editable() -> Column:
    """Owned or collaborative, whatever the name."""
    return F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)) | F.coalesce("collaborative", F.lit(False))


def exclusion() -> Column:
    """The first reason against a destination, null for a valid one."""
    return F.when(F.coalesce("name", F.lit("")).rlike(BLANK), "no name").when(~editable(), "not editable")


def without_source(destinations: DataFrame, source_col: str = "source_id") -> DataFrame:
    return destinations.where(~F.col("playlist_id").eqNullSafe(F.col(source_col)))


def profile(user: Column) -> Column:
    """A stored profile from a user record; never a credential."""
    return F.struct(user["id"].alias("user_id"), user["display_name"].alias("display_name"), F.get(user["images"], F.lit(0))["url"].alias("picture_url"))


def public_user(users: DataFrame) -> DataFrame:
    """What anybody may see of a stored profile."""
    return users.select("user_id", "display_name", "picture_url")


def batches(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """(keys, batch_no, values): an ordered list cut into runs of `size`, the last one short."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = rows.select(*keys, F.col(value).alias("v"), at.alias("at")).withColumn("batch_no", F.floor(F.col("at") / size))
    return numbered.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("r")).select(*keys, "batch_no", F.transform("r", lambda x: x["v"]).alias("values"))
