"""A versioned store of ordered lists in one folder: commits are seen whole or not at all, and stale writers are refused.

    rows/<commit>       user_id, playlist_id, position (from 0 within the commit), uri
    entries/<commit>    user_id, playlist_id, replaces, n, snapshot: what the commit does to each list it writes
    log/<version>.json  one line: version, commit, base; a commit exists from the moment this file has its name

A list's snapshot names the version that wrote it last.  A writer first writes rows and entries under a name of its own, then
gives its manifest the next version's name, which fails if another writer has it.  It then looks at the lists again: those that
changed meanwhile are refused, the rows already written stay, and only entries and manifest are made anew.  Rows without an
entry are never read, so whatever a killed writer left behind means nothing.  A base commit (compact) holds all lists, so readers
never go back beyond the last one, and the log that they read is as long as the number of commits since.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm import tables
from tonearm.operators.filters import LIST

STALE = "the list changed since it was read"
VOIDED = "another list of the same group changed since it was read"
#: A commit gives up after so many others took its version.
TRIES = 20

_LOG = "version bigint, commit string, base boolean"


class Lost(Exception):
    """Another writer has the version."""


class ListStore:
    """The store in a folder that all executors reach; user_id and playlist_id are strings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("log").getFileSystem(self._conf)
        self._files.mkdirs(self._at("log"))

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    # ---- reading ----

    def log(self) -> list[tuple[int, str, bool]]:
        """(version, commit, base) of every commit, in order."""
        rows = self.spark.read.schema(_LOG).json(f"{self.path}/log").where("commit is not null")
        return sorted((r["version"], r["commit"], r["base"]) for r in rows.collect())

    def version(self) -> int:
        return max((v for v, _, _ in self.log()), default=0)

    def _since_base(self, version: int | None) -> list[tuple[int, str]]:
        kept = [x for x in self.log() if version is None or x[0] <= version]
        first = max((v for v, _, base in kept if base), default=0)
        return [(v, commit) for v, commit, _ in kept if v >= first]

    def _live(self, version: int | None) -> DataFrame:
        """(user_id, playlist_id, commit, version, n, snapshot, start): the entries that make up each list."""
        kept = self._since_base(version)
        if not kept:
            return self._none("user_id string, playlist_id string, commit string, version bigint, n bigint, snapshot string, start bigint")
        entries = self._numbered("entries", kept)
        own = Window.partitionBy(*LIST)
        last = F.max(F.when(F.col("replaces"), F.col("version"))).over(own)
        live = entries.withColumn("last", last).where(F.col("version") >= F.coalesce("last", F.lit(0)))
        before = F.sum("n").over(own.orderBy("version").rowsBetween(Window.unboundedPreceding, -1))
        named = F.coalesce("snapshot", F.concat(F.lit("v"), "version"))
        return live.select(*LIST, "commit", "version", "n", named.alias("snapshot"), F.coalesce(before, F.lit(0)).alias("start"))

    def _none(self, schema: str) -> DataFrame:
        """No rows, in the plan itself: what is joined with them is not shuffled for it."""
        columns = (c.split() for c in schema.split(", "))
        return self.spark.sql("select " + ", ".join(f"cast(null as {kind}) as {name}" for name, kind in columns) + " where false")

    def _numbered(self, kind: str, kept: list[tuple[int, str]]) -> DataFrame:
        """Rows or entries of some commits with their version, which is short, where the commit's name is long."""
        numbers = tables.inline(self.spark, kept, "version, commit").select(F.col("version").cast("bigint").alias("version"), "commit")
        found = self.spark.read.parquet(*(f"{self.path}/{kind}/{commit}" for _, commit in kept))
        return found.join(F.broadcast(numbers), "commit")  # one row a commit since the base

    def heads(self, version: int | None = None) -> DataFrame:
        """(user_id, playlist_id, snapshot, n_items) of every list as of a version, the latest by default."""
        return self._live(version).groupBy(*LIST).agg(F.max_by("snapshot", "version").alias("snapshot"), F.sum("n").alias("n_items"))

    def items(self, version: int | None = None) -> DataFrame:
        """(user_id, playlist_id, position, uri) of every list as of a version."""
        kept = self._since_base(version)
        if not kept:
            return self._none("user_id string, playlist_id string, position bigint, uri string")
        rows = self._numbered("rows", kept).select(*LIST, "version", "position", "uri")
        live = self._live(version).where("n > 0").select(*LIST, "version", "start")
        return rows.join(live, [*LIST, "version"]).select(*LIST, (F.col("start") + F.col("position")).alias("position"), "uri")

    # ---- writing ----

    def append(self, rows: DataFrame, expected: DataFrame | None = None, together: list[str] | None = None) -> DataFrame:
        """Put rows (user_id, playlist_id, position from 0, uri) behind what their lists hold; a list without rows is not written.

        expected: user_id, playlist_id, expected, and the columns of `together`: the snapshots that the writer has seen, null for
        a list that is not there; without it, those of the latest version.  Of lists that agree in the columns of `together`, one
        changed list keeps all from being written.  Returns (user_id, playlist_id, ok, error, snapshot), one row a list.
        """
        lists = rows.select(*LIST).distinct()
        return self._commit(lists if expected is None else expected.join(lists, LIST, "left_semi"), rows, False, together)

    def replace(self, lists: DataFrame, rows: DataFrame, together: list[str] | None = None) -> DataFrame:
        """Give lists (user_id, playlist_id, maybe expected, and the columns of `together`) new rows; one without rows is cleared."""
        return self._commit(lists, rows, True, together)

    def compact(self) -> int:
        """Write all lists anew as one base commit, their snapshots as they are; returns its version."""
        seen = self.version()
        heads = self.heads(seen)
        commit = uuid.uuid4().hex
        self._write_rows(self.items(seen), commit)
        entries = heads.select(*LIST, F.lit(True).alias("replaces"), F.col("n_items").alias("n"), "snapshot")
        self._write_entries(entries, commit)
        self._publish(seen + 1, commit, base=True)
        return seen + 1

    def _write_rows(self, rows: DataFrame, commit: str) -> None:
        text = [F.col(k).cast("string").alias(k) for k in LIST]
        # put in order before the ids become text, as numbers are compared faster
        kept = rows.select(*LIST, "position", "uri").sortWithinPartitions(*LIST, "position")
        kept.select(*text, F.col("position").cast("bigint").alias("position"), "uri", F.lit(commit).alias("commit")).write.parquet(f"{self.path}/rows/{commit}")

    def _write_entries(self, entries: DataFrame, commit: str) -> None:
        """The entries of a commit; a second try takes the place of the first, which nothing has named yet."""
        out = entries.select(*LIST, "replaces", F.col("n").cast("bigint").alias("n"), F.col("snapshot").cast("string").alias("snapshot"), F.lit(commit).alias("commit"))
        out.write.mode("overwrite").parquet(f"{self.path}/entries/{commit}")

    def _publish(self, version: int, commit: str, base: bool = False) -> None:
        """Name the manifest; the rename fails if the version is there, so of two writers one gets it."""
        gateway = self.spark.sparkContext._gateway
        draft = self._at(f"log/.{commit}.{version}")
        stream = self._files.create(draft, True)
        stream.write(json.dumps({"version": version, "commit": commit, "base": base}).encode() + b"\n")
        stream.close()
        options = getattr(self._hadoop, "Options$Rename")
        never = gateway.new_array(options, 1)
        never[0] = options.NONE
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf) if draft.toUri().getScheme() else self._hadoop.FileContext.getFileContext(self._conf)
        try:
            context.rename(draft, self._at(f"log/{version:020d}.json"), never)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                self._files.delete(draft, False)
                raise Lost(version) from e
            raise

    def _commit(self, lists: DataFrame, rows: DataFrame, replaces: bool, together: list[str] | None) -> DataFrame:
        commit = uuid.uuid4().hex
        self._write_rows(rows, commit)
        text = [F.col(k).cast("string").alias(k) for k in LIST]
        asked = lists.select(*text, *(F.col(k).cast("string").alias(f"__{k}") for k in together or []), *(["expected"] if "expected" in lists.columns else [])).distinct()
        if "expected" not in asked.columns:
            asked = asked.join(self.heads(self.version()).select(*LIST, F.col("snapshot").alias("expected")), LIST, "left")
        held = self.spark.read.parquet(f"{self.path}/rows/{commit}").groupBy(*LIST).agg(F.count("*").alias("n"))
        wanted = asked.join(held, LIST, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        # what the writer has seen is fixed here, before the first look at what is there now
        wanted.write.parquet(f"{self.path}/asked/{commit}")
        wanted = self.spark.read.parquet(f"{self.path}/asked/{commit}")
        for _ in range(TRIES):
            seen = self.version()
            judged = self._judged(wanted, self.heads(seen), together)
            good = judged.where("error is null")
            self._write_entries(good.select(*LIST, F.lit(replaces).alias("replaces"), "n", F.lit(None).cast("string").alias("snapshot")), commit)
            written = self.spark.read.parquet(f"{self.path}/entries/{commit}")
            if not written.isEmpty():
                try:
                    self._publish(seen + 1, commit)
                except Lost:
                    continue
            done = written.select(*LIST, F.lit(f"v{seen + 1}").alias("snapshot"))
            told = judged.select(*LIST, "error").distinct().groupBy(*LIST).agg(F.min("error").alias("error"))
            return told.join(done, LIST, "left").select(*LIST, F.col("error").isNull().alias("ok"), "error", "snapshot")
        raise Lost(f"{TRIES} other commits came first")

    def _judged(self, wanted: DataFrame, heads: DataFrame, together: list[str] | None) -> DataFrame:
        """wanted and error: null for lists that are as the writer has seen them."""
        rows = wanted.join(heads.select(*LIST, F.col("snapshot").alias("actual")), LIST, "left")
        stale = ~F.col("actual").eqNullSafe(F.col("expected"))
        error = F.when(stale, STALE)
        if together:
            group = Window.partitionBy(*(f"__{k}" for k in together))
            error = F.when(stale, STALE).when(F.max(stale).over(group), VOIDED)
        return rows.withColumn("error", error)
