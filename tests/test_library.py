import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonearm import schemas
from tonearm.operators import actions, cache, classify, filters, match, plan, requests
from tonearm.sources import pages

SF = "/root/testdata/sf0.001"
A, NONE = [("a1", "x")], []


def track(i="t", uri="u", local=False, playable=None, artists=A, album=None):
    return (i, "name " + i, uri, local, playable, album, artists, None)


def items(spark, tracks):
    rows = [("u", "p", k, t) for k, t in enumerate(tracks)]
    kind = schemas.T.StructType([schemas.T.StructField("user_id", schemas.T.StringType()), schemas.T.StructField("playlist_id", schemas.T.StringType()), schemas.T.StructField("position", schemas.T.LongType()), schemas.T.StructField("track", schemas.TRACK)])
    return spark.createDataFrame(rows, kind)


GOLDEN = {"dark trap": "Hip Hop", "neo soul": "R&B", "vapor twitch": "Electronic", "bedroom pop": "Indie", "metalcore": "Metal", "dance pop": "Pop", "reggaeton": "Latin", "": "Other", "HIP HOP": "Hip Hop", "dubstep": "Reggae", "skate punk": "Reggae", "hip-hop": "Other", "western swing": "Jazz", "chamber pop": "Classical", "rap metal": "Hip Hop", "alternative metal": "Metal"}


def test_genres(spark):
    got = classify.normalize(spark.createDataFrame([(g,) for g in GOLDEN], "genre string"), classify.rules(spark)).collect()
    assert {r.genre: r.bucket for r in got} == GOLDEN


def test_copyable_keeps_order_and_repeats(spark):
    df = items(spark, [track("1", "t1"), track("2", "t2"), track("3", "t-no", artists=NONE), track("1", "t1"), None, track("4", "l", local=True), track("5", "x", playable=False), track("6", ""), track("7", "n", artists=None)])
    assert filters.copyable_uris(df).first()["uris"] == ["t1", "t2", "t-no", "t1", "n"]
    assert [r.track.id for r in df.where(filters.sortable(F.col("track"))).orderBy("position").collect()] == ["1", "2", "1"]


def test_first_artist_with_a_bucket_wins(spark):
    df = items(spark, [track("1", artists=[("none", ""), ("house", "")]), track("2", artists=[("zzz", "")])])
    genres = spark.createDataFrame([("house", 0, "xyz"), ("house", 1, "deep house"), ("none", 0, "??")], "artist_id string, gpos int, genre string")
    got = classify.classify_library(df, genres, classify.rules(spark))[0]
    assert [r.bucket for r in got.orderBy("position").collect()] == ["Electronic", "Other"]


@pytest.mark.parametrize(("name", "owner", "shared", "reason"), [("", "u", True, "no name"), ("   ", "u", True, "no name"), (" \t\n", "u", True, "no name"), (None, "u", True, "no name"), ("x", "v", False, "not editable"), ("x", "v", True, None), ("x", "u", None, None), ("x", None, None, "not editable")])
def test_validation(spark, name, owner, shared, reason):
    df = spark.createDataFrame([("u", name, owner, shared)], "user_id string, name string, owner_id string, collaborative boolean")
    assert match.validate(df).first()["reason"] == reason


def test_match_ties_and_names(spark):
    b = spark.createDataFrame([("u", "Hip Hop", 1), ("u", "Pop", 2)], "user_id string, bucket string, bucket_ordinal int")
    d = spark.createDataFrame([("u", "p1", 1, "x"), ("u", "p2", 2, "My Hip Hop Mix"), ("u", "p3", 3, "y")], "user_id string, playlist_id string, ordinal int, name string")
    p = spark.createDataFrame([("u", "p1", "Hip Hop", 0.09), ("u", "p1", "Rock", 0.91), ("u", "p3", "Hip Hop", 0.1), ("v", "p2", "Pop", 1.0)], "user_id string, playlist_id string, bucket string, share double")
    got = {r.bucket: r.playlist_id for r in match.best(match.scores(b, d, p)).collect()}
    assert got == {"Hip Hop": "p2"}


def test_replay_safety_of_empty_lists(spark):
    d = spark.createDataFrame([("u", "p"), ("u", "q")], "user_id string, playlist_id string")
    got = {r.playlist_id: r.safe for r in match.replay_safe(d, items(spark, [track(), None])).collect()}
    assert got == {"p": False, "q": True}


def test_freshness_bound_is_inclusive(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [("in", ["a"], now - dt.timedelta(days=14)), ("out", ["b"], now - dt.timedelta(days=14, seconds=60)), ("other", ["c"], now)]
    cached = spark.createDataFrame(rows, "artist_id string, genres array<string>, last_fetched_at timestamp")
    want = spark.createDataFrame([("in",), ("out",)], "artist_id string")
    fresh = cache.fresh(want, cached, F.lit(now))
    assert [r.artist_id for r in fresh.collect()] == ["in"]
    assert [r.artist_id for r in cache.missing(want, fresh).collect()] == ["out"]


def test_batches_join_to_the_input(spark):
    df = spark.range(23).select(F.lit("k").alias("k"), "id")
    got = [r["values"] for r in filters.batches(df, ["k"], ["id"], "id", 10).orderBy("batch_no").collect()]
    assert [len(x) for x in got] == [10, 10, 3] and sum(got, []) == list(range(23))


def test_latest_action_has_no_fallback(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("u", t, "old", t + dt.timedelta(days=9), True), ("u", t + dt.timedelta(hours=1), "new", t + dt.timedelta(days=9), False), ("v", t, "ok", t + dt.timedelta(days=9), True)]
    df = spark.createDataFrame(rows, "user_id string, created_at timestamp, action_id string, expires_at timestamp, valid boolean")
    assert [r.action_id for r in actions.latest(df, F.lit(t + dt.timedelta(days=1))).collect()] == ["ok"]


def test_action_records(spark):
    good = {"id": "1", "userId": "u", "createdAt": "2024-01-01T00:00:00Z", "expiresAt": "2024-01-02T00:00:00Z", "destinations": [], "buckets": []}
    rows = [(json.dumps(good), "u"), ("{broken", "u"), (json.dumps(good), "v"), (json.dumps(good | {"id": ""}), "u"), (json.dumps(good | {"buckets": "x"}), "u"), (None, "u"), (json.dumps({k: v for k, v in good.items() if k != "expiresAt"}), "u")]
    got = actions.parse(spark.createDataFrame(rows, "raw string, user_id string"))
    assert got.count() == 1
    assert json.loads(got.select(F.to_json("action").alias("j")).first()["j"])["id"] == "1"


def test_pages(spark, tmp_path):
    t = {"id": "1", "name": "n", "uri": "u", "artists": [{"id": "a", "name": "x"}]}
    (tmp_path / "b.json").write_text(json.dumps({"user_id": "u", "playlist_id": "p", "offset": 2, "next": None, "items": [{"item": t}]}))
    (tmp_path / "a.json").write_text(json.dumps({"user_id": "u", "playlist_id": "p", "offset": 0, "next": "b", "items": [{"item": None}, {"item": t}]}))
    rows = pages.playlist_items(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.track is None) for r in rows] == [(0, True), (1, False), (2, False)]


def test_replace_clears_and_append_counts(spark):
    have = spark.createDataFrame([("u", "p", 0, "x"), ("u", "q", 0, "y")], "user_id string, playlist_id string, position long, track string")
    gone = spark.createDataFrame([("u", "p"), ("v", "q")], "user_id string, playlist_id string")
    assert [r.playlist_id for r in pages.replace_items(have, gone, have.limit(0)).collect()] == ["q"]
    more = spark.createDataFrame([("u", "p", 0, "z"), ("u", "r", 0, "z")], "user_id string, playlist_id string, rank long, track string")
    assert {(r.playlist_id, r.position) for r in pages.append_items(have, more).collect()} == {("p", 1), ("r", 0)}


def shared(spark):
    """A list that two users hold: two items each, and one more list of the first user."""
    rows = [("u", "liked", 0, track("1", "a")), ("u", "liked", 1, None), ("v", "liked", 0, track("2", "b")), ("v", "liked", 1, track("3", "c")), ("u", "own", 0, track("1", "a"))]
    one = items(spark, [track()])
    return spark.createDataFrame(rows, one.schema)


def test_lists_of_several_users_stay_apart(spark):
    df = shared(spark)
    both = df.select("user_id", "playlist_id").distinct()
    assert {(r.user_id, r.playlist_id): (r.n_copyable, r.n_items) for r in match.replay_safe(both, df).collect()} == {("u", "liked"): (1, 2), ("v", "liked"): (2, 2), ("u", "own"): (1, 1)}
    liked = both.where("playlist_id = 'liked' and user_id = 'u'")
    assert [(r.user_id, r.uri) for r in plan.base_items(liked, df).collect()] == [("u", "a")]
    left = pages.replace_items(df, liked, df.limit(0))
    assert left.where("user_id = 'v'").count() == 2 and left.where("user_id = 'u'").count() == 1
    more = spark.createDataFrame([("u", "own", 0, None), ("v", "liked", 0, None), ("v", "own", 0, None)], "user_id string, playlist_id string, rank long, track string")
    assert {(r.user_id, r.playlist_id): r.position for r in pages.append_items(df, more).collect()} == {("u", "own"): 1, ("v", "liked"): 2, ("v", "own"): 0}
    assigned = spark.createDataFrame([("u", "liked", "Pop"), ("v", "liked", "Rock")], "user_id string, playlist_id string, bucket string")
    assert {(r.user_id, r.bucket): r.share for r in match.genre_profile(assigned).collect()} == {("u", "Pop"): 1.0, ("v", "Rock"): 1.0}


BLANKS = ["\t", "\u00a0", "\u2003\ufeff", " \n"]


def test_undo_gate_trims_all_white_space(spark):
    cases = [(["Pop", "Rock"], True), ([], False), (None, False), (["Pop", None], False), (["Pop", "Pop"], False)] + [([b], False) for b in BLANKS] + [(["Pop", "Pop" + b], False) for b in BLANKS]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, buckets array<string>")
    got = {r.i: r.ok for r in df.select("i", actions.request_ok().alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]


def issues(spark, **given):
    row = {"source_type": "playlist", "output_mode": "sort-into-existing", "write_mode": None, "playlist_id": "p", "editable_playlist_ids": ["d"], "safe_copy_names": None, "create_backup": None} | given
    df = spark.createDataFrame([tuple(row.values())], "source_type string, output_mode string, write_mode string, playlist_id string, editable_playlist_ids array<string>, safe_copy_names map<string,string>, create_backup boolean")
    return [(x.path, x.message) for x in requests.with_issues(df).first().issues]


def test_requests(spark):
    assert issues(spark) == [] and issues(spark, safe_copy_names={"d": "x" * 100}) == []
    assert issues(spark, playlist_id="\u00a0\t") == [("playlistId", "playlistId must not be blank")]
    assert [p for p, _ in issues(spark, editable_playlist_ids=["d", " ", "\ufeff", None])] == [f"editablePlaylistIds.{i}" for i in (1, 2, 3)]
    assert issues(spark, editable_playlist_ids=["d", "p\t"]) == [("editablePlaylistIds", "source playlist cannot be a destination")]
    assert issues(spark, safe_copy_names={"x": "a", "d": "b", "y": "c"}) == [(f"safeCopyNames.{k}", f"safeCopyNames key '{k}' is not in editablePlaylistIds") for k in "xy"]
    assert issues(spark, safe_copy_names={"d": "\u2003"}) == [("safeCopyNames.d", "safe copy name must not be blank")]
    assert len(issues(spark, safe_copy_names={"d": "x" * 100 + " \n"})) == 0 and len(issues(spark, safe_copy_names={"d": "😀" * 51})) == 1
    assert issues(spark, output_mode="x", source_type=None)[0][0] == "sourceType"


def test_records_and_updates(spark):
    now = dt.datetime(2024, 1, 1)
    b = spark.createDataFrame([("u", "r", "q", "Pop", 2, "applied", "name"), ("u", "r", "p", "Rock", 1, "strange", "name"), ("u", "r", "p", "Jazz", 3, "undone", "name"), ("w", "r", "p", "Pop", 1, "applied", "name"), ("u", "again", "q", "Pop", 1, "applied", "name")], "user_id string, run string, playlist_id string, bucket string, bucket_ordinal int, status string, name string")
    h = spark.createDataFrame([("u", "p", "P"), ("u", "q", "Q"), ("w", "p", "W")], "user_id string, playlist_id string, name string")
    base = spark.createDataFrame([("u", "p", 1, "b2"), ("u", "p", 0, "b1"), ("u", "p", 2, "b2")], "user_id string, playlist_id string, position int, uri string")
    cand = spark.createDataFrame([("u", "Rock", 5, "r2", ("2", "n", ["a"], "", "")), ("u", "Rock", 3, "r1", ("1", "n", ["a", "b"], "A", "l")), ("u", "Pop", 4, "x", None)], "user_id string, bucket string, position int, uri string, summary " + actions.TRACKS[6:-1])
    snap = spark.createDataFrame([("u", "p", "s1"), ("u", "q", "s2"), ("w", "p", None)], "user_id string, playlist_id string, actual string")
    record = actions.record(b, h, base, cand, snap, F.lit(now))
    got = {(r.user_id, r.run): r for r in record.collect()}
    a = got["u", "r"].action
    assert [(d.playlistId, d.playlistName, d.baselineUris, d.expectedSnapshotId, d.bucketOrder) for d in a.destinations] == [("p", "P", ["b1", "b2", "b2"], "s1", ["Rock", "Jazz"]), ("q", "Q", [], "s2", ["Pop"])]
    assert [(x.bucket, x.playlistId, x.trackUris, x.status, [t.id for t in x.tracks]) for x in a.buckets] == [("Rock", "p", ["r1", "r2"], "applied", ["1", "2"]), ("Pop", "q", ["x"], "applied", []), ("Jazz", "p", [], "undone", [])]
    assert (a.createdAt, a.expiresAt, a.userId, got["u", "r"].warning) == ("2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z", "u", None)
    assert got["w", "r"].action is None and got["w", "r"].warning.endswith(" p")
    assert got["u", "again"].action.id != a.id and len(got["u", "again"].action.buckets) == 1
    raw = record.where("action is not null and run = 'r'").select("user_id", F.to_json("action").alias("raw"))
    read = actions.parse(raw)
    row = read.select("action_id", "created_at", "expires_at", F.to_json("action").alias("j"), "raw").first()
    assert (row.action_id, row.expires_at - row.created_at) == (a.id, dt.timedelta(hours=24)) and json.loads(row.j) == json.loads(row.raw)
    for later, left in ((1.5, 24 * 3600 - 1), (30 * 3600, 1)):
        assert actions.update(read, F.lit(now + dt.timedelta(seconds=later))).first().seconds_left == left


RECORD = {
    "id": "A",
    "userId": "u",
    "createdAt": "2024-01-01T00:00:00.000Z",
    "expiresAt": "2024-01-02T00:00:00.000Z",
    "client": {"version": [1, 2.5, None]},
    "destinations": [
        {"playlistId": "p", "playlistName": "P", "baselineUris": ["b", "b"], "expectedSnapshotId": "s1", "bucketOrder": ["Rock", "Jazz"], "color": "red"},
        {"playlistId": "q", "playlistName": "Q", "baselineUris": [], "expectedSnapshotId": "s2", "bucketOrder": ["Pop"]},
    ],
    "buckets": [
        {"bucket": "Rock", "playlistId": "p", "playlistName": "P", "trackUris": ["r"], "tracks": [{"id": "1", "artists": ["x"]}], "status": "applied"},
        {"bucket": "Pop", "playlistId": "q", "playlistName": "Q", "trackUris": ["x"], "tracks": [], "status": "applied"},
        {"bucket": "Jazz", "playlistId": "p", "playlistName": "P", "trackUris": ["j"], "status": "applied"},
        {"bucket": "Lost", "playlistId": "gone", "playlistName": "G", "trackUris": ["g"], "status": "applied"},
    ],
}


def undo(spark, requests, records, current={"p": "s1", "q": "s2"}, bad=("q",), as_of="2024-01-01 12:00:00"):  # noqa: B006
    stored = actions.parse(spark.createDataFrame([(r["userId"], json.dumps(r)) for r in records], "user_id string, raw string"))
    asked = spark.createDataFrame(requests, "user_id string, action_id string, buckets array<string>")
    now = spark.createDataFrame([("u", k, v) for k, v in current.items()] + [("w", "p", "other")], "user_id string, playlist_id string, actual string")
    receipts = spark.createDataFrame([("u", k, k not in bad, "n" + k) for k in "pq"] + [("w", "q", True, "n9")], "user_id string, playlist_id string, ok boolean, snapshot string")
    return actions.plan_undo(asked, stored, now, receipts, F.expr(f"timestamp '{as_of}'"))


def told(done):
    return {(r.user_id, r.action_id): r.outcome for r in done["outcomes"].collect()}


def test_undo_keeps_order_snapshots_and_unknown_fields(spark):
    done = undo(spark, [("u", "A", ["Rock", "Pop\t"])], [RECORD])
    assert told(done) == {("u", "A"): "partial"} and done["conflicts"].count() == 0
    assert [(r.playlist_id, r.uri) for r in done["rebuilt"].orderBy("playlist_id", "position").collect()] == [("p", "b"), ("p", "b"), ("p", "j")]
    assert {r.playlist_id for r in done["lists"].collect()} == {"p", "q"}  # q is written empty: it is cleared
    assert {r.bucket: r.status for r in done["buckets"].collect()} == {"Rock": "undone", "Pop": "applied", "Jazz": "applied", "Lost": "applied"}
    want = json.loads(json.dumps(RECORD))
    want["destinations"][0]["expectedSnapshotId"], want["buckets"][0]["status"] = "np", "undone"
    again = done["records"].select("user_id", F.to_json("action").alias("raw"))
    assert json.loads(again.first().raw) == want
    # what was stored again can be undone further, from its own state
    more = undo(spark, [("u", "A", ["Jazz"])], [want], {"p": "np"})
    assert [r.uri for r in more["rebuilt"].orderBy("position").collect()] == ["b", "b"] and told(more) == {("u", "A"): "complete"}
    assert told(undo(spark, [("u", "A", ["Rock"])], [want], {"p": "np"})) == {("u", "A"): "already undone"}


def test_actions_are_undone_one_by_one(spark):
    two = json.loads(json.dumps(RECORD)) | {"id": "B"}
    two["buckets"][0]["status"] = "undone"
    done = undo(spark, [("u", "A", ["Rock"]), ("u", "B", ["Rock"])], [RECORD, two, RECORD | {"userId": "w", "id": "W"}])
    assert told(done) == {("u", "A"): "complete", ("u", "B"): "already undone"}
    assert {(r.action_id, r.bucket) for r in done["chosen"].collect()} == {("A", "Rock")}
    assert {(r.action_id, r.status) for r in done["buckets"].where("bucket = 'Rock'").collect()} == {("A", "undone"), ("B", "undone"), ("W", "applied")}
    # one action in conflict does not keep another from being undone
    other = json.loads(json.dumps(RECORD)) | {"id": "C"}
    other["destinations"][0]["expectedSnapshotId"] = "older"
    done = undo(spark, [("u", "A", ["Pop"]), ("u", "C", ["Rock", "Pop"])], [RECORD, other], bad=())
    assert told(done) == {("u", "A"): "complete", ("u", "C"): "conflict"}
    assert [tuple(r) for r in done["conflicts"].collect()] == [("u", "C", "p", "P", "older", "s1", ["Rock"])]
    assert {(r.action_id, r.playlist_id) for r in done["lists"].collect()} == {("A", "q")}


@pytest.mark.parametrize(
    ("request_", "record", "as_of", "outcome"),
    [
        (("u", "A", ["Rock", "Lost"]), RECORD, "2024-01-01 12:00:00", "missing destination"),
        (("u", "A", ["Rock", "Nope"]), RECORD, "2024-01-01 12:00:00", "unknown bucket"),
        (("u", "A", ["Rock", "Rock "]), RECORD, "2024-01-01 12:00:00", "invalid request"),
        (("u", "A", []), RECORD, "2024-01-01 12:00:00", "invalid request"),
        (("u", "Z", ["Rock"]), RECORD, "2024-01-01 12:00:00", "action not found"),
        (("w", "A", ["Rock"]), RECORD, "2024-01-01 12:00:00", "action not found"),
        (("u", "A", ["Rock"]), RECORD, "2024-01-02 00:00:00", "action not found"),
        (("u", "A", ["Rock"]), RECORD | {"destinations": []}, "2024-01-01 12:00:00", "missing destination"),
    ],
)
def test_undo_writes_nothing_where_it_must_not(spark, request_, record, as_of, outcome):
    done = undo(spark, [request_], [record], as_of=as_of)
    assert told(done) == {request_[:2]: outcome}
    assert done["lists"].count() == done["rebuilt"].count() == done["buckets"].where("status = 'undone'").count() == 0


def test_groups_of_an_action(spark):
    stored = actions.parse(spark.createDataFrame([("u", json.dumps(RECORD))], "user_id string, raw string"))
    found = actions.groups(actions.places_of(stored), actions.buckets_of(stored)).orderBy("group_no", "at").collect()
    assert [(r.group_no, r.place, r.bucket) for r in found] == [(1, "P", "Rock"), (1, "P", "Jazz"), (2, "Q", "Pop"), (3, actions.ORPHANS, "Lost")]


def test_runs_stop_where_they_must(spark):
    asked = spark.createDataFrame([("u", "p"), ("v", "p"), ("w", "x")], "user_id string, playlist_id string")
    headers = spark.createDataFrame([("u", "p", "Mine"), ("v", "p", "Hers")], "user_id string, playlist_id string, name string")
    df = shared(spark).withColumn("playlist_id", F.lit("p")).where("user_id = 'u' or position = 9")
    saved = plan.backup_status(asked, headers, df)
    assert {r.user_id: (r.name, r.tracks_copied, r.status) for r in saved.collect()} == {"u": ("Mine" + plan.BACKUP_SUFFIX, 2, "success"), "v": ("Hers" + plan.BACKUP_SUFFIX, 0, "success"), "w": (None, 0, plan.NO_SOURCE)}
    assigned = spark.createDataFrame([("u", "p", "Pop")], "user_id string, playlist_id string, bucket string")
    going = plan.runs(asked, saved, assigned)
    assert {r.user_id: r.outcome for r in going.collect()} == {"u": "sorted", "v": "empty", "w": "aborted"}
    lists = spark.createDataFrame([("u", "a", 1, "A", "u", False), ("u", "b", 2, "", "u", False), ("u", "c", 3, "C", "z", False), ("u", "p", 4, "Mine", "u", False), ("v", "a", 1, "", "v", False)], "user_id string, playlist_id string, ordinal int, name string, owner_id string, collaborative boolean")
    wish = spark.createDataFrame([("u", i, k) for k, i in enumerate(["gone", "c", "b", "a", "p", "lost"])] + [("v", "a", 0)], "user_id string, playlist_id string, asked int")
    good, bad = match.validate_destinations(wish, lists, asked.withColumnRenamed("playlist_id", "source_id"), going.where("outcome = 'sorted'"))
    assert [r.playlist_id for r in good.collect()] == ["a"]
    assert [(r.playlist_id, r.reason) for r in bad.orderBy("place").collect()] == [("gone", "not found"), ("lost", "not found"), ("b", "no name"), ("c", "not editable")]


def test_all_readers(spark, tmp_path):
    def dump(name, *rows):
        (tmp_path / name).mkdir()
        for k, r in enumerate(rows):
            (tmp_path / name / f"{k}.json").write_text(json.dumps(r))
        return str(tmp_path / name)

    t = {"id": "1", "name": "n", "uri": "u", "artists": [{"id": "a", "name": "x"}]}
    liked = pages.liked_items(spark, dump("liked", {"user_id": "u", "offset": 1, "next": None, "items": [{"track": None}]}, {"user_id": "u", "offset": 0, "next": "x", "items": [{"track": t}]}))
    assert [(r.playlist_id, r.position, r.track and r.track.id) for r in liked.orderBy("position").collect()] == [("liked", 0, "1"), ("liked", 1, None)]
    assert liked.where(filters.sortable(F.col("track"))).count() == 1
    p = {"id": "p", "name": "N", "owner": {"id": "o"}, "collaborative": None, "snapshot_id": "s", "items": None, "tracks": {"total": 7}}
    heads = pages.playlists(spark, dump("heads", {"user_id": "u", "offset": 0, "items": [None, p, p | {"id": "q", "items": {"total": 3}}]}))
    rows = heads.select("*", filters.item_count(heads).alias("n")).orderBy("ordinal").collect()
    assert [(r.playlist_id, r.ordinal, r.owner_id, r.n) for r in rows] == [("p", 1, "o", 7), ("q", 2, "o", 3)]
    assert pages.snapshots(heads).columns == ["user_id", "playlist_id", "actual"]
    found = pages.artists(spark, dump("artists", {"seq": 1, "artists": [{"id": "a", "genres": ["new"]}, None]}, {"seq": 0, "artists": [{"id": "a", "genres": ["old"]}, {"id": "b", "genres": []}]}))
    assert {r.artist_id: r.genres for r in found.collect()} == {"a": ["new"], "b": []}
    assert pages.artists(spark, str(tmp_path / "artists")).where("artist_id is null").count() == 0


def test_refresh(spark):
    now = dt.datetime(2024, 1, 31)
    cached = spark.createDataFrame([("new", ["a"], now), ("stale", ["b"], now - dt.timedelta(days=15)), ("silent", ["c"], now - dt.timedelta(days=15))], "artist_id string, genres array<string>, last_fetched_at timestamp")
    asked = spark.createDataFrame([("new",), ("stale",), ("silent",), ("",), ("stale",), ("fresh",)], "artist_id string")
    fetched = spark.createDataFrame([("stale", ["B"]), ("fresh", ["F"]), ("other", ["O"])], "artist_id string, genres array<string>")
    use, ask, after = cache.refresh(asked, cached, fetched, F.lit(now))
    assert {r.artist_id: r.genres for r in use.collect()} == {"new": ["a"], "stale": ["B"], "fresh": ["F"]}
    assert sorted(r.artist_id for r in ask.collect()) == ["fresh", "silent", "stale"]
    assert {r.artist_id: r.genres for r in after.collect()} == {"new": ["a"], "stale": ["B"], "silent": ["c"], "fresh": ["F"]}


def test_order_of_rows_does_not_matter(spark):
    df = items(spark, [track(str(i), f"u{i}") for i in range(50)])
    one, two = (filters.copyable_uris(x).first()["uris"] for x in (df, df.repartition(7, F.rand(3))))
    assert one == two


def test_profile_mapping_and_names(spark):
    u = spark.sql("select named_struct('id', 'u', 'display_name', cast(null as string), 'images', cast(array() as array<struct<url:string>>)) u")
    assert u.select(filters.profile(F.col("u")).alias("p")).first()["p"].picture_url is None
    lists = spark.sql("select 'p' playlist_id, 'Mix' name, map('p', 'Mine') safe_copy_names union all select 'q', 'Mix', map('p', 'Mine') union all select 'r', 'Mix', null")
    assert [r[0] for r in lists.orderBy("playlist_id").select(plan.copy_name()).collect()] == ["Mine", "Mix" + plan.COPY_SUFFIX, "Mix" + plan.COPY_SUFFIX]


@pytest.mark.parametrize("name", ["bucket_counts", "bucket_map", "best_match", "plan_safe_copy", "result_ledger", "undo_rebuild", "record_action", "direct_ledger", "excluded_playlists", "request_issues", "user_profile_upsert"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = lambda found: sorted(str(tuple(x)) for x in found)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())
