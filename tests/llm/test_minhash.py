import random

import pytest
from pyspark.sql import functions as F

from tonearm.llm import _common, minhash


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, band string, label int")


def plain_groups(rows, words):
    """Groups of row numbers by all-pairs Jaccard, and the set of each row."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group, sets


def links_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def shuffled_path(n):
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    return list(zip(ids, ids[1:], strict=False))


@pytest.mark.parametrize(("pairs", "most"), [([(i, i + 1) for i in range(2000)], 15), (shuffled_path(2000), 40), ([(500, i) for i in range(300)], 8), ([(2, 1), (1, 2), (7, 9), (3, 3)], 8)])
def test_components_take_few_rounds(spark, monkeypatch, pairs, most):
    written = []
    monkeypatch.setattr(_common, "materialise", lambda df, f=_common.materialise: written.append(1) or f(df))
    got = {r.node: r.comp for r in minhash.components(links_of(spark, pairs)).collect()}
    comp = {v: v for p in pairs if p[0] != p[1] for v in p}
    if len(pairs) > 5:
        assert set(got) == set(comp) and set(got.values()) == {min(comp)}
    else:
        assert got == {1: 1, 2: 1, 7: 7, 9: 7}
    assert len(written) <= most


def test_short_texts_with_a_common_phrase_do_not_meet(spark, monkeypatch):
    """Each text shares four of its five shingles with all others, too few for the threshold: no pair comes up."""
    found, pairs = [], minhash._rare_pairs

    def counted(*a):
        out = pairs(*a)
        found.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_rare_pairs", counted)
    for n in (300, 30_000):
        texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("one phrase that all of them share "), F.concat(F.lit("w"), "id")).alias("text"))
        assert minhash.near_duplicates(texts, words=4).where("kept").count() == n
    assert found == [0, 0]


def test_sizes_around_the_threshold(spark):
    rng = random.Random(7)
    rows = []
    for size in (4, 5, 8, 9, 10, 17, 30):
        core = [f"c{size}_{i}" for i in range(size)]
        for k in range(25):
            own = [f"o{size}_{k}_{i}" for i in range(rng.randrange(0, 1 + size // 3))]
            rows.append((len(rows), " ".join(core + own if k % 2 else own + core)))
    group, sets = plain_groups(rows, 4)
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, rows), words=4).collect()}
    for (i, _), g, s in zip(rows, group, sets, strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), g, g == i)


BASE = " ".join(f"w{i}" for i in range(100))
NEAR = BASE.replace("w50", "v50")
LARGE = 2**62
CASES = {
    "large ids": [(LARGE + 5, BASE), (LARGE + 6, BASE), (2**63 - 1, NEAR), (-(2**63), "some other text of several words"), (LARGE + 7, "")],
    "null ids": [(None, BASE), (None, BASE), (4, NEAR), (None, "a text that only rows without an id have"), (None, "a text that only rows without an id have"), (None, None)],
    "an id with two texts": [(5, BASE), (5, "another text that is nowhere else at all"), (3, NEAR), (6, ""), (6, "a third text that is nowhere else at all")],
    "repeated rows": [(5, BASE), (5, BASE), (5, BASE.upper()), (7, NEAR)],
    "very long text": [(1, " ".join(f"x{i}" for i in range(60_000))), (2, " ".join(f"x{i}" for i in range(59_000))), (3, "x" * 300_000)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_one_row_of_each_group_stays(spark, name):
    rows = CASES[name]
    group, sets = plain_groups(rows, 5)
    df = documents(spark, rows)
    kept = minhash.keep_one_of_each(df)
    left = kept.collect()
    assert df.columns == kept.columns
    want = []
    for g in sorted(set(group)):
        mine = [r for r, x, s in zip(rows, group, sets, strict=True) if x == g and s]
        want.append(min(((r[0] is None, r[0] or 0) for r in mine), default=None))
    want = sorted([w for w in want if w] + [(r[0] is None, r[0] or 0) for r, s in zip(rows, sets, strict=True) if not s])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == want
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    smallest = {}
    for (i, _), g in zip(rows, group, strict=True):
        smallest[g] = min([x for x in (i, smallest.get(g)) if x is not None], default=None)
    told = [(i, len(s), smallest[g], True if not s or smallest[g] is None else i == smallest[g]) for (i, _), g, s in zip(rows, group, sets, strict=True)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=key) == sorted(told, key=key)


def test_ids_must_be_numbers(spark):
    with pytest.raises(TypeError):
        minhash.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
