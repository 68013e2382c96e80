import pytest
from pyspark.sql import functions as F

from tonearm.sources import store

KIND = "user_id string, playlist_id string, position long, uri string"


def rows(spark, **lists):
    return spark.createDataFrame([("u", k, i, x) for k, uris in lists.items() for i, x in enumerate(uris.split())], KIND)


def lists(spark, *names, **expected):
    if expected:
        return spark.createDataFrame([("u", k, v) for k, v in expected.items()], "user_id string, playlist_id string, expected string")
    return spark.createDataFrame([("u", k) for k in names], "user_id string, playlist_id string")


def held(kept, version=None):
    out = {r.playlist_id: [] for r in kept.heads(version).collect()}
    for r in kept.items(version).orderBy("playlist_id", "position").collect():
        assert r.position == len(out[r.playlist_id])
        out[r.playlist_id].append(r.uri)
    return {k: " ".join(v) for k, v in out.items()}


def heads(kept, version=None):
    return {r.playlist_id: r.snapshot for r in kept.heads(version).collect()}


def told(receipts):
    return {r.playlist_id: (r.ok, r.error, r.snapshot) for r in receipts.collect()}


@pytest.fixture
def kept(spark, tmp_path):
    s = store.ListStore(spark, str(tmp_path / "lists"))
    s.replace(lists(spark, "p", "q", "r"), rows(spark, p="a b a", q="c"))
    return s


def test_append_replace_and_clear(spark, kept):
    assert held(kept) == {"p": "a b a", "q": "c", "r": ""} and kept.version() == 1
    got = told(kept.append(rows(spark, p="x x", s="new")))
    assert got == {"p": (True, None, "v2"), "s": (True, None, "v2")}
    assert held(kept) == {"p": "a b a x x", "q": "c", "r": "", "s": "new"}
    kept.replace(lists(spark, "p", "q"), rows(spark, p="z"))
    assert held(kept) == {"p": "z", "q": "", "r": "", "s": "new"}
    assert heads(kept) == {"p": "v3", "q": "v3", "r": "v1", "s": "v2"}
    kept.append(rows(spark, q="back", p="more"))
    assert held(kept)["q"] == "back" and held(kept)["p"] == "z more"
    # older versions can still be read
    assert held(kept, 1) == {"p": "a b a", "q": "c", "r": ""} and held(kept, 2)["p"] == "a b a x x"


def test_nothing_to_append_is_no_commit(spark, kept):
    assert told(kept.append(rows(spark))) == {} and kept.version() == 1


def test_stale_snapshots_are_refused(spark, kept):
    kept.append(rows(spark, p="x"))
    got = told(kept.replace(lists(spark, p="v1", q="v1", n=None), rows(spark, p="lost", q="kept", n="made")))
    assert got == {"p": (False, store.STALE, None), "q": (True, None, "v3"), "n": (True, None, "v3")}
    assert held(kept) == {"p": "a b a x", "q": "kept", "r": "", "n": "made"}
    assert told(kept.append(rows(spark, p="y"), lists(spark, p="v1"))) == {"p": (False, store.STALE, None)} and kept.version() == 3


def test_groups_are_written_whole_or_not(spark, kept):
    kept.append(rows(spark, p="x"))
    asked = lists(spark, p="v1", q="v1", r="v1").withColumn("action", F.when(F.col("playlist_id") == "r", 2).otherwise(1))
    got = told(kept.replace(asked, rows(spark, p="1", q="2", r="3"), ["action"]))
    assert {k: v[:2] for k, v in got.items()} == {"p": (False, store.STALE), "q": (False, store.VOIDED), "r": (True, None)}
    assert held(kept) == {"p": "a b a x", "q": "c", "r": "3"}


def test_a_killed_writer_leaves_the_old_version(spark, kept, monkeypatch):
    for step in ("_write_entries", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(store.ListStore, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                kept.replace(lists(spark, "p", "q"), rows(spark, p="half"))
        assert held(kept) == {"p": "a b a", "q": "c", "r": ""} and kept.version() == 1
    kept.append(rows(spark, q="d"))
    assert held(kept)["q"] == "c d"


def test_the_second_of_two_writers_looks_again(spark, kept, monkeypatch):
    """Another commit comes between the look at the lists and the manifest."""
    other, publish, meanwhile = store.ListStore(spark, kept.path), store.ListStore._publish, []

    def late(self, version, commit, base=False):
        if self is kept and not meanwhile:
            meanwhile.append(told(other.append(rows(spark, p="first"))))
        return publish(self, version, commit, base)

    monkeypatch.setattr(store.ListStore, "_publish", late)
    got = told(kept.append(rows(spark, p="second", q="mine")))
    assert meanwhile == [{"p": (True, None, "v2")}] and got == {"p": (False, store.STALE, None), "q": (True, None, "v3")}
    assert held(kept) == {"p": "a b a first", "q": "c mine", "r": ""}


def test_compaction_changes_no_list_and_no_snapshot(spark, kept):
    kept.append(rows(spark, p="x", q="y"))
    kept.replace(lists(spark, "q"), rows(spark))
    before = held(kept), heads(kept)
    assert kept.compact() == 4 and (held(kept), heads(kept)) == before
    assert told(kept.append(rows(spark, p="z"), lists(spark, p="v2"))) == {"p": (True, None, "v5")}
    assert held(kept)["p"] == "a b a x z" and held(kept, 3) == before[0] and len(kept._since_base(None)) == 2


def test_an_empty_store(spark, tmp_path):
    s = store.ListStore(spark, str(tmp_path / "none"))
    assert s.version() == 0 and held(s) == {} and s.items().columns == ["user_id", "playlist_id", "position", "uri"]
    assert told(s.replace(lists(spark, p=None, q="v9"), rows(spark, p="a"))) == {"p": (True, None, "v1"), "q": (False, store.STALE, None)}
