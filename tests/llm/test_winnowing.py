import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonearm.llm import winnowing
from tonearm.llm._common import table

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def plain(docs, items):
    """{(id, text): (n_words, n_hit, n_items, items_sha256, contaminated)} by looking at every window."""
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    met |= windows[found]
        names = ",".join(sorted(str(x) for x in met))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def frame(spark, rows, kind="item_id"):
    full = [(i, t, "en", 0, "x") for i, t in rows]
    return spark.createDataFrame(full, f"{kind} long, text string, id string, th long, window string")


def got(spark, docs, items, **kw):
    benchmark = winnowing.Benchmark(frame(spark, items), **kw)
    return sorted(map(tuple, winnowing.decontaminate(frame(spark, docs, "doc_id"), benchmark).collect()), key=str)


LONG = "w0 W1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
ITEMS = [(1, LONG), (2, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 zz"), (3, LONG), (20, "Some short one"), (21, "short"), (22, "Élan vital"), (23, None), (24, "!? --"), (25, ""), (26, "some SHORT"), (27, "a a a a a a a a a a a a"), (1, LONG)]
DOCS = [
    (1, f"before {LONG.upper()} after"),
    (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8"),
    (3, "w1-w2.w3,w4;w5:w6/w7\tw8\nw9 w10 q q q w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"),
    (4, "some short on"),
    (5, "it is Some, short one! short"),
    (6, "élan vital"),
    (7, "Élan vital éLAN Vital"),
    (8, None),
    (9, ""),
    (10, " \n ..."),
    (11, "a " * 5000),
    (12, "q " * 4000 + LONG + " q" * 4000),
    (13, f"{LONG} {LONG}"),
    (13, f"{LONG} {LONG}"),
    (13, "short"),
    (None, LONG),
    (None, "nothing at all"),
    (14, "x" * 100_000),
]


@pytest.mark.parametrize("most", [0, winnowing.MAX_BROADCAST])
@pytest.mark.parametrize("bits", [3, winnowing.PLACE_BITS])
def test_equals_a_look_at_every_window(spark, monkeypatch, most, bits):
    monkeypatch.setattr(winnowing, "PLACE_BITS", bits)
    assert got(spark, DOCS, ITEMS, max_broadcast=most) == plain(DOCS, ITEMS)


def test_without_short_items(spark):
    items = [x for x in ITEMS if len(words(x[1])) >= 10]
    assert got(spark, DOCS, items) == plain(DOCS, items)


def test_empty_tables(spark):
    assert got(spark, DOCS, []) == plain(DOCS, []) == got(spark, DOCS, [(1, None), (2, "..")])
    assert got(spark, [], ITEMS) == []


def test_null_items_hit_without_a_name(spark):
    rows = got(spark, [(1, LONG)], [(None, LONG)])
    assert [(r[2], r[3], r[5]) for r in rows] == [(13, 0, True)]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab "), max_size=120), min_size=1, max_size=12), st.lists(st.text(st.sampled_from("ab "), max_size=60), min_size=1, max_size=6))
def test_random_texts(spark, docs, items):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    assert got(spark, docs, items) == plain(docs, items)


def test_fingerprints_are_the_smallest_of_each_window(spark):
    """Every window of ten words keeps one, the same in each text, and far from all grams are kept."""
    text = " ".join(f"v{i * 7919 % 1009}" for i in range(700))
    df = spark.createDataFrame([(text,), (" ".join(text.split()[300:310]),)], "text string").select(winnowing.words(F.col("text")).alias("w"))
    whole, window = (set(r["f"]) for r in winnowing._fingerprints(winnowing._hashes(df, "w"), None).select(F.transform("__f", lambda x: F.shiftright(x, winnowing.PLACE_BITS)).alias("f")).collect())
    assert len(window) == 1 and window <= whole and 150 < len(whole) < 260


def test_real_documents(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    rows = winnowing.decontaminate(docs, winnowing.Benchmark(items)).collect()
    assert sorted(map(tuple, rows), key=str) == want and any(r.contaminated for r in rows)
    clean = winnowing.keep_clean(docs, winnowing.Benchmark(items))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(r[0] for r in want if not r[5])
