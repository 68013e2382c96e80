import json

import pytest
from pyspark.sql import functions as F

from tonearm import schemas
from tonearm.operators import classify, keywords, positions
from tonearm.sources import chains, pages


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_places_in_lists_of_any_length(spark, most):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "long").when(F.col("id") % 10 == 8, F.concat(F.lit("s"), F.col("id") % 70)).alias("list"), F.xxhash64("id").alias("at"), "id").repartition(7)
    got = positions.number(df, ["list"], ["at"], most=most)
    assert got.columns == ["list", "at", "id", "position"]
    lists = {}
    for r in got.collect():
        lists.setdefault(r["list"], []).append((r.position, r.at))
    assert sum(map(len, lists.values())) == 5000 and len(lists["long"]) == 4000 and len(lists[None]) == 500
    for rows in lists.values():
        assert [p for p, _ in sorted(rows)] == list(range(len(rows))) and [a for _, a in sorted(rows)] == sorted(a for _, a in rows)


def test_a_long_list_lies_over_all_tasks(spark):
    df = spark.range(40_000).select(F.lit("one").alias("list"), F.xxhash64("id").alias("at"))
    got = positions._by_chunk(df, ["list"], ["at"], "position")
    assert got.agg(F.max("position"), F.count_distinct("position")).first() == (39_999, 40_000)
    sizes = [r["count"] for r in got.groupBy(F.floor(F.col("position") / 10_000)).count().collect()]
    assert sizes == [10_000] * 4
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < 25_000  # of 40,000 rows, in four tasks


def test_segments(spark):
    df = spark.range(23).select(F.lit("k").alias("k"), "id", F.col("id").alias("position"))
    got = [r["values"] for r in positions.segments(df.repartition(5), ["k"], "id", 10).orderBy("segment").collect()]
    assert [len(x) for x in got] == [10, 10, 3] and sum(got, []) == list(range(23))


def test_keywords_inside_texts(spark):
    texts = ["dream pop", "pop", "p", "", "hip hop", "Übung macht", "aaa", "aaaa", "pop", None]
    words = ["pop", "op", "p", "", "hip hop", "zzz", "üb", "Übung", "aaa", "aaaaa", "m p", None, "pop"]
    a = spark.createDataFrame([(t,) for t in texts], "text string")
    b = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = {(t, w) for t in texts for w in words if t is not None and w is not None and w in t}
    got = [tuple(r) for r in keywords.matches(a, b).collect()]
    assert set(got) == want and len(got) == len(want)
    assert keywords.matches(a.limit(0), b).count() == keywords.matches(a, b.limit(0)).count() == 0


def test_many_keywords_meet_without_a_nested_loop(spark, capsys):
    words = spark.range(100_000).select(F.concat(F.lit("k"), F.lpad(F.conv("id", 10, 36), 5, "0")).alias("keyword"))
    texts = spark.range(300).select(F.concat(F.lit("some "), F.lit("k"), F.lpad(F.conv(F.col("id") * 331, 10, 36), 5, "0"), F.lit(" text")).alias("text"))
    got = keywords.matches(texts, words)
    assert got.count() == 300
    got.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_genres_by_grams_equal_the_plain_join(spark):
    names = [f"{a}{b}" for a in ("", "deep ", "hard", "K-") for b in (*schemas.VOCAB, "ska", "DUB", "pop", "r&b", "xyz")]
    df = spark.createDataFrame([(n,) for n in names], "genre string")
    rules = classify.rules(spark)
    assert sorted(keywords.normalize(df, rules).collect()) == sorted(classify.normalize(df, rules).collect(), key=lambda r: (r.genre, r.bucket))


def page(user="u", name="p", offset=0, n=2, following=None, **more):
    items = [{"item": {"id": f"t{offset + i}"}} if i % 2 == 0 else None for i in range(n)]
    return json.dumps({"user_id": user, "playlist_id": name, "offset": offset, "next": following, "items": items} | more)


CHAINS = {
    "complete": [page(following="x"), page(offset=2)],
    "single": [page()],
    "empty": [page(n=0)],
    "repeated": [page(following="x"), page(offset=2), page(following="x")],
    "gap": [page(following="x"), page(offset=4)],
    "overlap": [page(following="x"), page(offset=1)],
    "open end": [page(following="x")],
    "no first page": [page(offset=2)],
    "both": [page(offset=2, following="x"), page(offset=9)],
}
WANT = {"single": "complete", "empty": "complete", "repeated": "complete", "both": "no first page"}


def test_chains_of_pages(spark):
    lines = [(line.replace('"playlist_id": "p"', f'"playlist_id": "{k}"'),) for k, rows in CHAINS.items() for line in rows]
    broken = [("{cut",), ("",), ("[1]",), (page(user=None),), (page(n=0).replace("\"offset\": 0", "\"offset\": \"x\""),)]
    good, bad = chains.records(spark.createDataFrame(lines + broken, "value string"), schemas.ITEM_PAGE)
    assert bad.count() == len(broken)
    told = {r.playlist_id: r for r in chains.verdicts(good).collect()}
    assert {k: r.verdict for k, r in told.items()} == {k: WANT.get(k, k) for k in CHAINS}
    assert (told["repeated"].n_pages, told["repeated"].n_repeated, told["repeated"].n_items) == (2, 1, 4)
    rows = pages.items_of(chains.complete(good))
    found = sorted((r.playlist_id, r.position, r.track and r.track.id) for r in rows.collect())
    assert found == [(k, i, f"t{i}" if i % 2 == 0 else None) for k in ("complete", "repeated") for i in range(4)] + [("single", i, ["t0", None][i]) for i in range(2)]
