"""What the steps of the larger queries move and work out: each fault told here once made a query outgrow its input."""

import os
import re
import time

from pyspark.sql import functions as F

from tonearm import queries, tables
from tonearm.fixtures import Library
from tonearm.operators import actions, match
from tonearm.sources import chains, store

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_described_after_they_were_joined(spark):
    """Else a join by shuffles carries names, links and artists of every item."""
    plan = _plan(Library(spark, SF).items().groupBy("user_id", "playlist_id").agg(F.max("track.name")))
    assert plan.count("Join Inner") == 1
    assert "track " not in plan.split("Join Inner")[1]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_one_pass_gives_items_and_buckets(spark):
    lib, shared = Library(spark, SF), Library(spark, SF)
    shared.share_classified()
    cols = ["user_id", "playlist_id", "position", "track_id", "uri", "bucket"]
    assert _rows(shared.kept_assigned().select(cols)) == _rows(lib.assigned().select(cols))
    seen = lambda x: x.items().select(*cols[:3], "track.id", "track.uri", "track.is_local", "track.is_playable")
    assert _rows(seen(shared)) == _rows(seen(lib))


def test_matches_are_made_of_scores_above_zero_alone(spark):
    lib = Library(spark, SF)
    parts = lib.buckets(), lib.destinations(), match.genre_profile(lib.assigned())
    assert _rows(match.positive(*parts)) == _rows(match.scores(*parts).where("score > 0"))


def test_pages_with_items_are_shuffled_once(spark):
    schema = "user_id string, playlist_id string, offset long, next string, items array<string>"
    rows = [("u", "a", 0, "n", ["x", "y"]), ("u", "a", 0, "n", ["x", "z"]), ("u", "a", 2, None, ["w"]), ("u", "b", 1, None, ["x"]), ("u", "c", 0, None, [None])]
    pages = spark.createDataFrame(rows, schema)
    got = chains.complete(pages)
    assert sorted((r.playlist_id, r.offset, r["items"]) for r in got.collect()) == [("a", 0, ["x", "z"]), ("a", 2, ["w"]), ("c", 0, [None])]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in "".join(x for x in plan.splitlines() if "items" in x)


def test_a_record_is_read_once(spark):
    raw = spark.createDataFrame([("1", "{}")], "user_id string, raw string")
    assert _plan(actions.parse(raw)).count("parseJson") == 1


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def test_items_of_sources_are_found_without_a_join(spark):
    lib, plain = Library(spark, SF), Library(spark, SF)
    lib.share_classified()
    assert "Join" not in _plan(lib._source_assigned())
    cols = ["user_id", "playlist_id", "position", "track_id", "uri", "bucket"]
    assert _rows(lib.source_assigned().select(cols)) == _rows(plain.source_assigned().select(cols))


def test_what_is_dealt_by_user_is_joined_as_it_lies(spark):
    """Else each join by user, action and list shuffles its sides again, up to six times an undo."""
    lib = Library(spark, SF)
    chosen, places = lib.chosen(), lib.places()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _exchanges(chosen.join(places, actions.ACT_LIST).groupBy(*actions.ACT).count())
        share = _exchanges(match.genre_profile(lib.matched().select("user_id", "playlist_id", "bucket")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == 2 and all("hashpartitioning(user_id" in x for x in found)
    assert len(share) == 1


def test_a_store_brings_no_rows_from_the_driver(spark, tmp_path):
    """Else every read of a store starts Python workers, and an empty one is joined by shuffles."""
    kept = store.ListStore(spark, f"file://{tmp_path}")
    assert "RDD" not in _plan(kept.heads()) and "RDD" not in _plan(kept.items())
    rows = spark.sql("select * from values ('u', 'a', 0L, 'x'), ('u', 'a', 1L, 'y') as t(user_id, playlist_id, position, uri)")
    lists = spark.sql("select 'u' as user_id, 'a' as playlist_id")
    assert "Join" not in _plan(lists.join(kept.heads(), ["user_id", "playlist_id"], "left"))
    kept.replace(lists, rows)
    kept.append(rows)
    assert "RDD" not in _plan(kept.heads()) and "RDD" not in _plan(kept.items())
    assert sorted((r.position, r.uri) for r in kept.items().collect()) == [(0, "x"), (1, "y"), (2, "x"), (3, "y")]


def _shuffles(spark):
    """Numbers of the shuffles that have files."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return set(re.findall(r"shuffle_(\d+)_", blocks))


def test_what_a_write_shuffles_goes_with_it(spark):
    """Else a query of many writes holds the shuffles of all of them until the driver collects its garbage."""
    before, clean = _shuffles(spark), spark.conf.get(tables.CLEAN)
    rows = tables.write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if not _shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert rows.count() == 7 and spark.conf.get(tables.CLEAN) == clean


def test_records_are_made_of_rows_dealt_by_user(spark):
    """Else every join by list or run shuffles baselines and tracks again."""
    lib = Library(spark, SF)
    lib.share_classified()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _exchanges(lib.recorded())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found and all("Reused" in x or "hashpartitioning(user_id#" in x and "REPARTITION_BY_COL" in x for x in found)


def test_undoing_leaves_records_and_their_new_states_on_disk_alone(spark):
    folder = f"{tables.shared_dir(spark).removeprefix('file://')}/tonearm-{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    rows = queries.QUERIES["undo_records"](spark, SF)
    assert len(set(os.listdir(folder)) - before) == 3
    assert rows.count() > 0
