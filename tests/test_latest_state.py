import datetime as dt
import random

from pyspark.sql import functions as F

from tonearm.streaming import latest

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id string, action_id string, created_at timestamp, written_at timestamp, payload string, more int"


def hours(h):
    return START + dt.timedelta(hours=h)


def taken_in(spark, folder, rows, delay="100 hours"):
    """Land rows (user, action, hour made, hour written, payload) as one more file and let the stream run."""
    made = [(u, a, None if c is None else hours(c), None if w is None else hours(w), p, 0) for u, a, c, w, p in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    latest.run(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/out", delay)
    return {r.user_id: (r.action_id, r.payload, r.live) for r in latest.latest(spark, f"{folder}/out").collect()}


def plain(rows):
    """The record made last and its version written last, straight from all rows."""
    out = {}
    for u, a, c, w, p in rows:
        if None not in (u, a, c, w) and w < c + 24 and (u not in out or (c, a, w) > out[u][0]):
            out[u] = ((c, a, w), p)
    return {u: (key[1], p) for u, (key, p) in out.items()}


def test_state_goes_on_from_run_to_run(spark, tmp_path):
    f = str(tmp_path)
    assert taken_in(spark, f, [("u", "a", 0, 0, "first"), ("v", "x", 1, 1, None), (None, "n", 1, 1, "n"), ("w", None, 1, 1, "n"), ("w", "n", None, 1, "n"), ("w", "n", 1, None, "n")]) == {"u": ("a", "first", True), "v": ("x", None, True)}
    # stored again; written after the expiry; an older action that comes later; repeated
    assert taken_in(spark, f, [("u", "a", 0, 3, "second"), ("u", "a", 0, 24, "too late"), ("v", "w", 0, 4, "older"), ("v", "x", 1, 1, None)]) == {"u": ("a", "second", True), "v": ("x", None, True)}
    # made at the same moment: the larger id
    assert taken_in(spark, f, [("v", "y", 1, 1, "tie"), ("u", "b", 2, 2, "newer")]) == {"u": ("b", "newer", True), "v": ("y", "tie", True)}


def test_state_expires_with_the_watermark(spark, tmp_path):
    f = str(tmp_path)
    taken_in(spark, f, [("u", "a", 0, 0, "p"), ("v", "x", 20, 20, "p")], "1 hour")
    # the clock stands at 29: u's action has expired at 24; a change of its payload does not move that
    assert taken_in(spark, f, [("v", "x", 20, 30, "again")], "1 hour") == {"u": ("a", "p", False), "v": ("x", "again", True)}
    # a new action after the expiry, and v's first expiry holds although it was stored again
    assert taken_in(spark, f, [("u", "b", 46, 46, "q")], "1 hour") == {"u": ("b", "q", True), "v": ("x", "again", False)}
    # what is later than the watermark allows is dropped
    assert taken_in(spark, f, [("v", "z", 40, 40, "late"), ("u", "b", 46, 46, "q")], "1 hour") == {"u": ("b", "q", True), "v": ("x", "again", False)}


def test_any_order_and_any_batches_give_the_latest(spark, tmp_path):
    rng = random.Random(5)
    # one user has a third of all rows
    rows = [(f"u{rng.choice([0, *range(3)]) if rng.random() < 0.5 else rng.randrange(3, 20)}", f"a{rng.randrange(5)}", rng.randrange(40), 0, None) for _ in range(3000)]
    rows = [(u, a, c, c + rng.randrange(30), None) for u, a, c, _, _ in rows]
    rows = [(u, a, c, w, f"{a} {c} {w}") for u, a, c, w, _ in rows]
    for i in range(2):
        got = taken_in(spark, str(tmp_path), rows[i::2])
    assert {u: x[:2] for u, x in got.items()} == plain(rows)


def test_an_empty_stream(spark, tmp_path):
    assert taken_in(spark, str(tmp_path), [(None, None, None, None, None)]) == {}


def test_equal_times_of_expiry_count_in_whole_milliseconds(spark, tmp_path):
    f = str(tmp_path)
    taken_in(spark, f, [("u", "a", 0, 0, "p")], "0 seconds")
    taken_in(spark, f, [("v", "x", 23.999, 23.999, "p")], "0 seconds")
    assert taken_in(spark, f, [("v", "x", 24, 24.001, "p")], "0 seconds")["u"] == ("a", "p", False)
    assert latest.latest(spark, f"{f}/out").where("user_id = 'u'").select(F.col("expires_at") == F.lit(hours(24))).first()[0]
