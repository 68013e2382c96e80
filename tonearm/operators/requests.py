"""The gate for run requests: rows with their issues; a row without issues is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.operators.filters import trimmed, units

MAX_NAME = 100


def _issue(path: Column | str, message: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(path).alias("path"), text(message).alias("message"))


def _when(rule: Column, path: str, message: str) -> Column:
    """One issue or none."""
    return F.when(F.coalesce(rule, F.lit(False)), F.array(_issue(path, message))).otherwise(F.array().cast("array<struct<path:string,message:string>>"))


def _each(found: Column, issue) -> Column:
    """An issue for each element of an array; none for a null array."""
    return F.coalesce(F.transform(found, issue), F.array().cast("array<struct<path:string,message:string>>"))


def with_issues(requests: DataFrame) -> DataFrame:
    """requests and issues, an array of (path, message) in order; rules across fields run if all fields are good.

    Ids and names are trimmed of every kind of white space first; a rule on ids or names gives one issue for each that breaks it.
    """
    c = F.col
    names = c("safe_copy_names")
    source = trimmed(c("playlist_id"))
    ids = F.transform("editable_playlist_ids", lambda x: trimmed(x))
    existing = c("output_mode") == "sort-into-existing"
    placed = F.transform(ids, lambda x, i: F.struct(x.alias("id"), i.alias("at")))
    named = F.transform(F.map_entries(names), lambda e: F.struct(e["key"].alias("key"), trimmed(e["value"]).alias("name")))
    at = lambda field, x: F.concat(F.lit(field + "."), x.cast("string"))
    # Paths and messages.
    fields = F.concat(
        _when(~F.coalesce(c("source_type").isin("liked", "playlist"), F.lit(False)), "sourceType", "sourceType must be 'liked' or 'playlist'"),
        _when(~F.coalesce(c("output_mode").isin("auto-create", "sort-into-existing"), F.lit(False)), "outputMode", "outputMode must be 'auto-create' or 'sort-into-existing'"),
        _when(~c("write_mode").isin("copy", "direct"), "existingPlaylistWriteMode", "existingPlaylistWriteMode must be 'copy' or 'direct'"),
        _when(source == "", "playlistId", "playlistId must not be blank"),
        _when(F.size(ids) == 0, "editablePlaylistIds", "editablePlaylistIds must contain at least one playlist id"),
        _each(F.filter(placed, lambda x: F.coalesce(x["id"], F.lit("")) == ""), lambda x: _issue(at("editablePlaylistIds", x["at"]), "editablePlaylistIds must not hold blank ids")),
        _each(F.filter(named, lambda x: F.coalesce(x["name"], F.lit("")) == ""), lambda x: _issue(at("safeCopyNames", x["key"]), "safe copy name must not be blank")),
        _each(F.filter(named, lambda x: units(x["name"]) > MAX_NAME), lambda x: _issue(at("safeCopyNames", x["key"]), "safe copy name must be at most 100 characters")),
    )
    stray = F.filter(F.map_keys(names), lambda k: ~F.coalesce(F.array_contains(ids, k), F.lit(False)))
    across = F.concat(
        _when((c("source_type") == "playlist") & source.isNull(), "playlistId", "playlistId is required when sourceType is playlist"),
        _when(existing & ids.isNull(), "editablePlaylistIds", "editablePlaylistIds are required for sort-into-existing mode"),
        _when((c("source_type") == "liked") & c("create_backup"), "createBackup", "createBackup is only valid when sourceType is playlist"),
        _when(~existing & c("write_mode").isNotNull(), "existingPlaylistWriteMode", "existingPlaylistWriteMode is only valid when outputMode is sort-into-existing"),
        _when(names.isNotNull() & ~existing, "safeCopyNames", "safeCopyNames is only valid when outputMode is sort-into-existing"),
        _when(names.isNotNull() & existing & (F.coalesce("write_mode", F.lit("copy")) != "copy"), "safeCopyNames", "safeCopyNames is only valid when existingPlaylistWriteMode is copy"),
        _each(stray, lambda k: _issue(at("safeCopyNames", k), F.concat(F.lit("safeCopyNames key '"), k, F.lit("' is not in editablePlaylistIds")))),
        _when((c("source_type") == "playlist") & existing & F.array_contains(ids, source), "editablePlaylistIds", "source playlist cannot be a destination"),
    )
    return requests.withColumn("__fields", fields).withColumn("issues", F.when(F.size("__fields") > 0, F.col("__fields")).otherwise(across)).drop("__fields")


def write_mode() -> Column:
    """The write mode in force: copy unless told otherwise when sorting into existing lists, else none."""
    return F.when(F.col("output_mode") == "sort-into-existing", F.coalesce("write_mode", F.lit("copy")))
