"""Odd rows of the text operators: ties, repeated rows, nulls in any column, clashing names, long chains, hot groups."""

import math

import pytest
from pyspark.sql import functions as F

from tonearm.llm import chat, ctw, html_tree, lz_fingerprint, packing, quality, sentencepiece_tok, toxicity

ODD = "doc_id long, text string, lang string, source string, ids string, parity int, score double, stratum string, cluster long"


def odd_docs(spark, rows):
    """Documents with null languages and sources, and extra columns named like those that operators make."""
    return spark.createDataFrame([(i, t, None, None, "x", 1, 0.5, "s", 7) for i, t in rows], ODD)


ROWS = [(1, "plain words to read here"), (2, None), (3, ""), (4, "y" * 20_000), (5, "plain words to read here"), (5, "plain words to read here"), (None, "no id")]


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def turns_of(df):
    return {(r.tree, r.branch): [(t.role, t.text) for t in r.turns] for r in df.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}


def test_chat_ties_repeats_and_nulls(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 1.0)]  # equal scores: leaf 2
    rows += [(2, 1, None, "user", "q", 1.0)] * 3 + [(2, 2, 1, "assistant", "a", 1.0)] * 3 + [(2, 2, 1, "assistant", "later", 9.0)]
    rows += [(3, None, None, "user", "no id", 1.0), (4, 1, None, None, None, None), (4, 2, 1, "assistant", None, None)]
    got = turns_of(chat.format_trees(messages(spark, rows).withColumns({"to": F.lit("x"), "n": F.lit("y"), "branch": F.lit("z")}), branches=2))
    assert got == {(1, 1): [("user", "q"), ("assistant", "b")], (1, 2): [("user", "q"), ("assistant", "c")], (2, 1): [("user", "q"), ("assistant", "a")], (4, 1): [("", ""), ("assistant", "")]}


def test_chat_of_one_long_conversation(spark):
    """A chain of 1,000 turns takes ten joins; repeated rows are turns of their own, ties in turn go by role and text."""
    rows = [(7, k // 2, "user", f"t{k % 2}") for k in range(998)] + [(7, 0, "user", "t0"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    got = turns_of(chat.format_trees(chat.from_turns(df), unique=True))
    assert got[None, 1] == [("", "")]
    assert got[7, 1] == [("user", t) for t in ["t0", "t0", "t1"] + [f"t{k % 2}" for k in range(2, 998)]]
    assert chat.format_trees(chat.from_turns(df.limit(0)), unique=True).count() == 0


def test_sentencepiece_with_clashing_columns(spark):
    got = sentencepiece_tok.encode_documents(odd_docs(spark, ROWS)).collect()
    told = {r.doc_id: list(r.ids) for r in got}
    assert len(got) == len(ROWS) and told[2] == told[3] == [] and told[1] == told[5] and len(told[4]) > 0


def test_html_of_null_and_repeated_ids(spark):
    page = "<body><nav>menu</nav><article><p>One story of some length.</p></article></body>"
    rows = [(None, "http://h.example/a", page), (None, None, page), (1, "http://h.example/a", page), (1, "http://h.example/a", page), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "path": F.lit("y"), "low": F.lit(1)})
    got = html_tree.extract(df).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id != 2} == {"One story of some length."}
    assert [(r.text, r.n_chars) for r in got if r.page_id == 2] == [("", 0)]


def test_packing_of_many_rows_without_source(spark):
    """A source or cluster that is null conflicts with nothing, so bins of equal pieces get full."""
    rows = [(i, f"{i} " * 10) for i in range(400)]
    out = packing.pack_documents(odd_docs(spark, rows), capacity=100).toPandas()
    assert len(out) == 400 and out.bin.nunique() <= 42 and out.groupby("bin").tokens.sum().max() == 100


@pytest.fixture(scope="module")
def graded(spark):
    """900 different good texts of no language and 900 of one, with two poor ones of each that the base rules let pass."""
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(30))) for i in range(1800)]
    poor = [(5000 + i, " ".join(f"ab#{'#$%&' * 3}{i}{k}" for k in range(30))) for i in range(4)]
    rows = [(i, t, None if i % 2 else "en", int(i < 5000)) for i, t in good + poor]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    return df.drop("y"), df.select("doc_id", F.col("y").alias("quality"), F.lit(0).alias("toxic"))


def test_quality_of_a_null_stratum_with_cutoffs_in_use(spark, graded):
    docs, labels = graded
    cuts = {r.stratum: r for r in quality.calibrate(quality.measures(docs), labels).collect()}
    assert set(cuts) == {None, "en"} and all(r.cut_0 is not None for r in cuts.values())
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {5000, 5001, 5002, 5003}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, r in got.items() if r.kept}


def test_quality_labels_that_repeat_or_are_odd(spark, graded):
    docs, labels = graded
    more = spark.createDataFrame([(None, 1, 0), (0, None, 0), (2, 7, 0), (0, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    want = sorted((r.doc_id, r.kept) for r in quality.judge(docs, labels).collect())
    assert sorted((r.doc_id, r.kept) for r in quality.judge(docs, labels.unionByName(more)).collect()) == want


def test_phrase_fingerprints_of_odd_rows(spark):
    got = lz_fingerprint.compare_with_edit_and_next(odd_docs(spark, ROWS)).collect()
    told = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and told[2].fingerprint == told[3].fingerprint and told[1].fingerprint == told[5].fingerprint
    assert told[2].n_chars == told[3].n_chars == 0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_scores_of_odd_rows(spark):
    got = ctw.score_documents(odd_docs(spark, ROWS)).collect()
    told = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and told[2].n_tokens == told[3].n_tokens == 1 and math.isclose(told[2].score, told[3].score)
    assert math.isclose(told[1].score, told[5].score) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_toxicity_of_odd_rows(spark):
    """A label of no document, of no class or of no id teaches nothing; equal texts get equal scores."""
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 0), (None, 0, 1), (4, 0, None), (99, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark, ROWS)
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    told = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and told[2].score == told[3].score and told[1].score == told[5].score
    assert all(0 <= r.score <= 1 for r in got)
