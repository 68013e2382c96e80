import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import whitening
from tonearm.llm._common import table

SF = "/root/testdata/sf0.001"


def plain(rows, counted=False):
    """{id: (x, deviation, whitened up to sign)}, n, explained, by numpy over all rows at once."""
    good = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = [x for _, x in good] if counted else sorted({x for _, x in good})
    n, sums = len(distinct), [sum(col) for col in zip(*distinct, strict=True)]
    z = np.array(distinct, float) - np.array([s / n for s in sums])
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:4]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), ((np.array(x) - np.array([s / n for s in sums])) @ vectors[:, order]) / np.sqrt(values[order])) for i, x in good]
    return out, n, values[order] / values.sum()


def check(got, want, n, explained):
    rows = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-9
        rows.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    assert sum(len(x) for k in rows.values() for x in k.values()) == len(want) * len(explained)
    mine = np.array([[rows[i, d][k + 1][0] for k in range(len(explained))] for i, d, _ in want])
    theirs = np.array([z for _, _, z in want])
    sign = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine - theirs * sign).max() < 1e-7


@pytest.mark.parametrize("counted", [False, True])
def test_equals_numpy(spark, counted):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding")
    rows = rows.unionByName(rows.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 10_000))
    plain_rows = [tuple(r) for r in rows.collect()]
    want, n, explained = plain(plain_rows, counted)
    assert n == (len(plain_rows) if counted else 500)
    check(whitening.transform(rows, counted=counted).collect(), want, n, explained)


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6)]) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # a vector that most rows share
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (900, [-0.0, 0.0, -0.001, 0.001, 0.0, 0.0])]
    good = list(rows)
    bad = [(201, None), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [])]
    full = [(*r, "x", 1) for r in rows + bad + [(206, [1.0, 2.0]), (207, [1e300] * 6)]]
    df = spark.createDataFrame(full, "vec_id long, embedding array<double>, key string, rows int").repartition(3)
    want, n, explained = plain(good)
    for shares in (1000, 10):
        monkeypatch.setattr(whitening, "SHARES", shares)
        got = whitening.transform(df).collect()
        check(got, want, n, explained)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(i * 2**36), float(i % 3)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.transform(df, components=1).collect()}
    want = {i: d if d < 2**63 else None for i, d, _ in plain(rows)[0]}
    assert got == want and None in want.values() and not all(v is None for v in want.values())


def test_few_directions(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.transform(spark.createDataFrame([], kind)).collect() == []
    assert whitening.transform(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    assert whitening.transform(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = whitening.transform(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(5)], kind)).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and all(abs(r.explained - 1) < 1e-12 for r in line)
