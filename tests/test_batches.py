import pytest
from pyspark.sql import functions as F

from tonearm import tables
from tonearm.operators import batches, upkeep

LISTS = {"p": 7, "q": 3, "r": 0, "s": 6}
NO_RECEIPTS = "user_id string, playlist_id string, batch_no bigint, attempt int, ok boolean, limited boolean, retry_after_ms bigint, snapshot string, error string"


def planned(spark):
    rows = spark.createDataFrame([("u", k, i, f"{k}{i}") for k, n in LISTS.items() for i in range(n)], "user_id string, playlist_id string, position long, uri string")
    return tables.write(batches.cut(rows, spark.createDataFrame([("u", k) for k in LISTS], "user_id string, playlist_id string"), 3))


def written(plan, receipts):
    out = {k: [] for k in LISTS}
    for r in batches.held(plan, receipts).orderBy("playlist_id", "position").collect():
        assert r.position == len(out[r.playlist_id])
        out[r.playlist_id].append(r.uri)
    return out


def send(limited=()):
    """Receipts of what is due; the (list, batch, try)s named are rate-limited."""
    hit = lambda: F.concat_ws(":", "playlist_id", "batch_no", "attempt").isin(list(limited))
    return lambda due: due.select(*batches.BATCH, F.col("attempt").cast("int").alias("attempt"), (~hit()).alias("ok"), hit().alias("limited"), F.lit(None).cast("bigint").alias("retry_after_ms"), F.concat(F.lit("b"), "batch_no").alias("snapshot"), F.when(hit(), "limited").alias("error"))


@pytest.mark.parametrize("broken_after", [1, 2, 3])
def test_a_broken_write_ends_as_an_unbroken_one(spark, broken_after):
    plan, none = planned(spark), spark.createDataFrame([], NO_RECEIPTS)
    some = batches.drive(plan, none, send(["p:1:1"]), tables.write, broken_after)
    rest = batches.drive(plan, some, send(["p:1:1"]), tables.write, 9)
    assert written(plan, rest) == {k: [f"{k}{i}" for i in range(n)] for k, n in LISTS.items()}
    told = {r.playlist_id: (r.n_batches, r.done, r.status, r.snapshot) for r in batches.progress(plan, rest).collect()}
    assert told == {"p": (3, 3, "complete", "b2"), "q": (1, 1, "complete", "b0"), "r": (1, 1, "complete", "b0"), "s": (2, 2, "complete", "b1")}
    assert rest.count() == 7 + 1 and rest.groupBy(*batches.BATCH, "attempt").count().where("count > 1").count() == 0


def test_tries_and_pauses(spark):
    plan, none = planned(spark), spark.createDataFrame([], NO_RECEIPTS)
    limited = [f"p:1:{i}" for i in range(1, 9)]
    seen, receipts = [], none
    for _ in range(6):
        seen += [(r.attempt, r.wait_ms, r.replaces) for r in batches.due(plan, receipts).where("playlist_id = 'p'").collect()]
        receipts = batches.drive(plan, receipts, send(limited), tables.write, 1)
    assert seen == [(1, 0, True), (1, 250, False), (2, 250, False), (3, 500, False), (4, 1000, False)]
    row = batches.progress(plan, receipts).where("playlist_id = 'p'").first()
    assert (row.status, row.done, row.n_written, row.error, row.next_batch) == ("failed", 1, 3, "limited", None)
    # an error of another kind ends the write at once, an asked-for pause is kept
    hard = spark.createDataFrame([("u", "p", 0, 1, False, False, None, None, "gone"), ("u", "q", 0, 1, False, True, 7000, None, "limited")], NO_RECEIPTS)
    told = {r.playlist_id: (r.status, r.attempt, r.wait_ms, r.error) for r in batches.progress(plan, hard).collect()}
    assert told["p"] == ("failed", None, None, "gone") and told["q"] == ("pending", 2, 7000, None)


def test_counts_follow_changes(spark):
    kind = "user_id string, playlist_id string, position long, bucket string"
    rows = lambda *x: spark.createDataFrame([("u", *r) for r in x], kind)
    old = rows(("p", 1, "Pop"), ("p", 2, "Rock"), ("p", 3, "Pop"), ("q", 1, "Jazz"), ("z", 1, "Pop"))
    gone, new = rows(("p", 1, "Pop"), ("q", 1, "Jazz")), rows(("p", 4, "Rock"), ("q", 2, "Folk"), ("n", 0, "Pop"))
    after = old.join(gone, kind.replace(" string", "").replace(" long", "").split(", "), "left_anti").unionByName(new)
    asked = []

    def now(lists):
        asked.extend(r.playlist_id for r in lists.collect())
        return after.join(lists, ["user_id", "playlist_id"], "left_semi")

    got = upkeep.changed(upkeep.counted(old), new, gone, now)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, upkeep.counted(after).collect()))
    assert asked == ["p"]  # only there a bucket lost its first item and has others
