import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tonearm.sources.artists import ArtistTable

DAY = dt.datetime(2024, 1, 31)
SCHEMA = "artist_id string, genres array<string>, last_fetched_at timestamp, other int"


def rows(spark, *some):
    return spark.createDataFrame([(i, g, DAY - dt.timedelta(days=d), 1) for i, g, d in some], SCHEMA)


def ids(spark, *some):
    return spark.createDataFrame([(i, 7) for i in some], "artist_id string, genres int")


def files(path):
    """Files of each part, with their times."""
    return {p: {(f, os.stat(f"{path}/{p}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{p}") if f.endswith(".parquet")} for p in os.listdir(path) if p.startswith("part=")}


def held(table):
    return {r.artist_id: (r.genres, (DAY - r.last_fetched_at).days) for r in table.rows().collect()}


def test_upserts_replace_and_keep(spark, tmp_path):
    table = ArtistTable(spark, str(tmp_path / "a"), 4, 2)
    assert held(table) == {} and table.upsert(rows(spark)) == []
    assert table.upsert(rows(spark, ("", ["x"], 0), (None, ["x"], 0))) == [] and table.found(ids(spark, "1")).count() == 0
    table.upsert(rows(spark, ("1", ["a"], 20), ("1", ["b"], 10), ("1", ["c"], 10), ("2", None, 3), ("3", [], 1)))
    assert held(table) == {"1": (["c"], 10), "2": (None, 3), "3": ([], 1)}
    table.upsert(rows(spark, ("1", ["old"], 30), ("4", ["d"], 0)))  # what is upserted replaces what is there, whatever its age
    again = rows(spark, ("2", ["e"], 2), ("2", ["e"], 2))
    assert table.upsert(again) == table.upsert(again)
    want = {"1": (["old"], 30), "2": (["e"], 2), "3": ([], 1), "4": (["d"], 0)}
    assert held(table) == want and held(ArtistTable(spark, str(tmp_path / "a"), 4, 2)) == want
    table.upsert(table.rows())  # what is put in may come from the table itself
    assert held(table) == want
    # another session's catalog does not know the table: its rows are found in the folder
    spark.sql(f"drop table {table.name}")
    assert held(ArtistTable(spark, str(tmp_path / "a"), 4, 2)) == want


def test_upserts_rewrite_the_parts_of_their_rows_only(spark, tmp_path):
    path = str(tmp_path / "a")
    table = ArtistTable(spark, path, 8, 2)
    assert table.upsert(rows(spark, *((str(i), ["g"], i % 30) for i in range(400)))) == list(range(8))
    before = files(path)
    assert len(before) == 8 and all(len(f) <= 2 for f in before.values())
    touched = table.upsert(rows(spark, ("17", ["new"], 0)))
    after = files(path)
    assert len(touched) == 1 and {p for p in after if after[p] != before[p]} == {f"part={touched[0]}"}
    assert len(held(table)) == 400 and held(table)["17"] == (["new"], 0)


def test_an_upsert_that_dies_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    table = ArtistTable(spark, path, 4, 2)
    table.upsert(rows(spark, *((str(i), ["g"], 1) for i in range(50))))
    before = files(path)
    broken = table.rows().withColumn("part", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table._overwrite(broken)
    assert files(path) == before and len(held(table)) == 50


def test_look_ups_leave_the_table_where_it_lies(spark, tmp_path):
    table = ArtistTable(spark, str(tmp_path / "a"), 8, 4)
    table.upsert(rows(spark, *((str(i), ["g"], i % 30) for i in range(400))))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        found = table.fresh(ids(spark, *(str(i) for i in range(100))), F.lit(DAY))
        plan = found._jdf.queryExecution().executedPlan().toString()
        below = plan[: plan.index("Scan parquet spark_catalog")].splitlines()
        # the first child of the join is the table: nothing between them but sort, filter and project
        assert "Join" in plan and not any("Exchange" in line for line in below) and "Bucketed: true" in plan
        assert {r.artist_id for r in found.collect()} == {str(i) for i in range(100) if i % 30 <= 14}
        one = table.found(ids(spark, "5", "5", "", "none"))
        parts = re.search(r"PartitionFilters: \[[^]]*part#\d+ (IN \(([\d,]+)\)|= (\d+))", one._jdf.queryExecution().executedPlan().toString())
        assert parts and len((parts[2] or parts[3]).split(",")) <= 2 and [r.artist_id for r in one.collect()] == ["5"]
    finally:
        spark.conf.set(name, before)


def test_refresh_asks_for_missing_and_stale_artists_only(spark, tmp_path):
    table = ArtistTable(spark, str(tmp_path / "a"), 4, 2)
    table.upsert(rows(spark, ("fresh", ["f"], 14), ("stale", ["s"], 15), ("gone", ["g"], 15), ("unasked", ["u"], 40)))
    asked = []

    def fetch(ask):
        asked.extend(r.artist_id for r in ask.collect())
        return spark.createDataFrame([("stale", ["s2"]), ("new", ["n"]), ("fresh", ["never"])], "artist_id string, genres array<string>")

    used = table.refresh(ids(spark, "fresh", "stale", "gone", "new", "new", "", None), fetch, F.lit(DAY))
    assert {r.artist_id: r.genres for r in used.collect()} == {"fresh": ["f"], "stale": ["s2"], "new": ["n"]}
    assert sorted(asked) == ["gone", "new", "stale"]
    assert held(table) == {"fresh": (["f"], 14), "stale": (["s2"], 0), "gone": (["g"], 15), "unasked": (["u"], 40), "new": (["n"], 0)}
