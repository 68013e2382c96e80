"""The artist table on disk, laid out for its look-ups and upserts.

The table is cut into parts by a hash of the artist id, and every part into the same number of buckets by it.  A look-up joins
bucket by bucket: only the ids asked for are shuffled, the table is read where it lies, and parts that no id falls in are
not read.  An upsert rewrites the parts that its rows fall in and no other; it joins the stored rows bucket by bucket as well.

An upsert that dies leaves every part either as it was or as it was to be; the same upsert again ends right, as it may be repeated.
One writer at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm import tables
from tonearm.operators import cache

COLUMNS = ["artist_id", "genres", "last_fetched_at"]


class ArtistTable:
    """Artists by id, in `parts` folders of `buckets` buckets; both must stay as they were when the folder was made.

    Null and empty ids are not kept.  Of repeated ids in one upsert the latest is kept, the larger genres on a tie; what is upserted
    replaces what was stored.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 16, buckets: int = 8):
        self.spark, self.path, self.parts, self.buckets = spark, path, parts, buckets
        self.name = "artists_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        # the session's catalog holds the layout only; the rows lie in the folder and outlive the session
        spark.sql(
            f"create table if not exists {self.name} (artist_id string, genres array<string>, last_fetched_at timestamp, part int) "
            f"using parquet options (path '{path}') partitioned by (part) clustered by (artist_id) into {buckets} buckets"
        )
        if tables.exists(spark, path):
            spark.sql(f"msck repair table {self.name}")  # finds the parts that other sessions have made

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("artist_id"), F.lit(self.parts)).cast("int").alias("part")

    def _stored(self, parts: list[int] | None = None) -> DataFrame:
        """The rows of some parts; of all that are there without a list."""
        rows = self.spark.table(self.name)
        return rows if parts is None else rows.where(F.col("part").isin(parts) if parts else F.lit(False))

    def _touched(self, keyed: DataFrame) -> list[int]:
        """At most `parts` numbers."""
        return sorted(r.part for r in keyed.select(self._part()).distinct().collect())

    def rows(self) -> DataFrame:
        return self._stored().select(*COLUMNS)

    def _wanted(self, requested: DataFrame) -> DataFrame:
        return requested.where("artist_id <> ''").select("artist_id").distinct()

    def found(self, requested: DataFrame) -> DataFrame:
        """Stored rows of requested artists (artist_id), whatever their age."""
        wanted = self._wanted(requested)
        return self._stored(self._touched(wanted)).select(*COLUMNS).join(wanted, "artist_id", "left_semi")

    def fresh(self, requested: DataFrame, as_of: Column) -> DataFrame:
        """Stored rows of requested artists that may still be used."""
        wanted = self._wanted(requested)
        return cache.fresh(wanted, self._stored(self._touched(wanted)).select(*COLUMNS), as_of)

    def upsert(self, new: DataFrame) -> list[int]:
        """Put in or replace artists (artist_id, genres, last_fetched_at); the parts that were rewritten, none for no rows."""
        latest = cache.upsert_latest(new.where("artist_id <> ''"), "artist_id", "last_fetched_at", ["genres"]).select(*COLUMNS)
        latest = tables.write(latest)  # read three times; what it is made from may be this table
        touched = self._touched(latest)
        if touched:
            kept = self._stored(touched).select(*COLUMNS).join(latest, "artist_id", "left_anti")
            rows = kept.unionByName(latest).select(*COLUMNS, self._part())
            # a task has a bucket of every touched part, so a part gets one file a bucket
            rows = rows.repartition(self.buckets, "artist_id")
            self._overwrite(rows)
            self.spark.catalog.refreshTable(self.name)
        tables.discard(latest)
        return touched

    def _overwrite(self, rows: DataFrame) -> None:
        """Replace the parts that rows has and no other; new files take their places when all of them are written."""
        conf, name = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(name)
        conf.set(name, "dynamic")
        try:
            rows.write.insertInto(self.name, overwrite=True)
        finally:
            conf.set(name, before)

    def refresh(self, requested: DataFrame, fetch: Callable[[DataFrame], DataFrame], as_of: Column) -> DataFrame:
        """(artist_id, genres) that a run may use, after the artists that are missing or stale were asked for and put in.

        fetch: from artists (artist_id) to artist_id and genres of those that an answer came for.
        """
        good = tables.write(self.fresh(requested, as_of))
        ask = tables.write(cache.missing(self._wanted(requested), good))
        got = tables.write(fetch(ask).join(ask, "artist_id", "left_semi").select("artist_id", "genres"))
        self.upsert(got.withColumn("last_fetched_at", as_of))
        return cache.effective(good, got)
