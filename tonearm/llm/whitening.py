"""Embedding whitening over distinct vectors: a weighted, centred covariance, each vector whitened once and joined back.

Entries become whole numbers x = floor(256 * c), so equal vectors are equal bit by bit.  Rows with one x are grouped; the
fit counts each distinct x once, or as often as it occurs.  Sums are exact, the covariance is a second pass that
centres before it multiplies: each task adds up weighted matrix products of its vectors, and the matrices are summed by
cell.  The eigenvectors of the d x d matrix are found on the driver, which holds nothing that grows with the rows.  Every
distinct x is then projected once, and rows find their result by a 128-bit digest of x.  A vector that many rows share
is joined in as many shares as its count asks for, so no task gets all of its rows.

Defined results: rows whose vector is null, or holds a null or non-finite entry or one whose x leaves 64 bits, are dropped; so
are vectors of another length than most distinct vectors have (the longer on a tie); repeated rows and null ids each
keep their rows; components whose eigenvalue is not above TINY of the largest have no direction to be whitened in and give no
rows, so a table with one distinct vector, or none, gives no rows; a deviation beyond 64 bits is null; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import _common as c

SCALE = 256
COMPONENTS = 4
#: Eigenvalues up to this share of the largest count as zero.
TINY = 1e-12
#: A vector with more than one in SHARES of all rows is joined in shares of that size, so there are at most SHARES such vectors.
SHARES = 1000
#: Up to here sums of a batch fit 64 bits.
SMALL = 2**40
LIMIT = 2**63 - 1


@dataclass
class Fit:
    """What whitening needs: counts and exact sums, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray  # one column each
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # division of whole numbers: correctly rounded


def _vectors(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x): the usable rows of a list column by their length, entries as 64-bit whole numbers."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch), -1))
    for d in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == d)
        flat = batch.take(pa.array(places)).flatten().cast(pa.float64())
        known = np.asarray(flat.is_valid()).reshape(-1, d).all(axis=1)
        with np.errstate(all="ignore"):
            scaled = np.floor(np.asarray(pa.compute.fill_null(flat, 0.0)).reshape(-1, d) * SCALE)
        good = known & (np.isfinite(scaled) & (scaled >= -(2.0**63)) & (scaled < 2.0**63)).all(axis=1)
        yield places[good], scaled[good].astype(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * d, d, dtype=np.int32), pa.array(x.ravel()))


def keyed(rows: DataFrame, id_col: str, vector_col: str, with_vectors: bool) -> DataFrame:
    """(id, key, d, x): the digest of each usable row's x, its length, and x itself where asked for."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = ["id", "key", "d", "x"] if with_vectors else ["id", "key", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _vectors(batch.column(1)):
                key = pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in x], pa.binary())
                cols = [batch.column(0).take(pa.array(places)), key, pa.array(np.full(len(x), x.shape[1], np.int32)), _lists(x)]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names)

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {kind}, key binary, d int" + (", x array<bigint>" if with_vectors else ""))


def distinct_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(key, x, rows): every distinct x of the common length and how many rows have it, as a table."""
    grouped = c.materialise(keyed(rows, id_col, vector_col, True).groupBy("key", "d", "x").agg(F.count("*").alias("rows")))
    common = grouped.groupBy("d").count().agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()["d"]
    return grouped.where(F.col("d") == F.lit(common)).select("key", "x", "rows")


def _array(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _weight(counted: bool):
    return (F.col("rows") if counted else F.lit(1)).cast("bigint").alias("w")


def totals(vectors: DataFrame, counted: bool) -> tuple[int, list[int]]:
    """The fit's size and its exact sums, one for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                w, x = np.asarray(batch.column(0)), _array(batch.column(1))
                exact = np.abs(x.astype(np.float64)).max() * w.sum() < LIMIT / 2
                n += int(w.sum())
                part = (w @ x).tolist() if exact else [sum(a * b for a, b in zip(w.tolist(), col, strict=True)) for col in x.T.tolist()]
                sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if sums is not None:
            cells = [str(v) for v in (n, *sums)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array(cells)], ["dim", "s"])

    cells = vectors.select(_weight(counted), "x").mapInArrow(run, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = [int(r["s"]) for r in cells.orderBy("dim").collect()]  # one number a dimension
    return (found[0], found[1:]) if found else (0, [])


def covariance(vectors: DataFrame, n: int, mean: np.ndarray, counted: bool, column: str = "x") -> np.ndarray:
    """Weighted covariance with divisor n, centred before multiplying."""
    d = len(mean)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                w, z = np.asarray(batch.column(0)), _array(batch.column(1)) - mean
                total += (z * w[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["cell", "v"])

    cells = vectors.select(_weight(counted), column).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in cells.collect():  # one number a cell of the matrix
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        out[i, j] = out[j, i] = r["v"] / n
    return out


def fit(vectors: DataFrame, counted: bool = False) -> Fit | None:
    """The components of distinct vectors (key, x, rows), each counted once, or as often as it occurs."""
    n, sums = totals(vectors, counted)
    if not n:
        return None
    v = covariance(vectors, n, np.array([s / n for s in sums]), counted)
    values, columns = np.linalg.eigh(v)
    order = np.argsort(values)[::-1]
    values, columns = values[order], columns[:, order]
    kept = values > max(TINY * values[0], 0.0)
    columns = columns * np.where(columns[np.abs(columns).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return Fit(n, sums, values[kept], columns[:, kept], float(np.trace(v)))


def whiten(vectors: DataFrame, fitted: Fit, components: int = COMPONENTS) -> DataFrame:
    """(key, rows, deviation, z): each distinct vector once; z holds a number for each component."""
    z_of = fitted.components[:, :components] / np.sqrt(fitted.eigenvalues[:components])
    n, sums, mean = fitted.n, fitted.sums, fitted.mean
    most = max(map(abs, sums))

    def deviations(x: np.ndarray) -> list[int | None]:
        far = float(np.abs(x.astype(np.float64)).max()) * n + most
        if far * far * x.shape[1] < LIMIT / 2:
            return ((x * n - np.array(sums)) ** 2).sum(axis=1).tolist()
        exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
        return [e if e <= LIMIT else None for e in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _array(batch.column(2))
                z = (x - mean) @ z_of
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(deviations(x), pa.int64()), _lists(z)], ["key", "rows", "deviation", "z"])

    return vectors.select("key", "rows", "x").mapInArrow(run, "key binary, rows bigint, deviation bigint, z array<double>")


def identity_error(whitened: DataFrame, n: int, k: int, counted: bool = False) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    w = F.col("rows") if counted else F.lit(1)
    means = whitened.agg(*(F.sum(w * F.get("z", F.lit(i))).alias(f"m{i}") for i in range(k))).first()
    return float(np.abs(covariance(whitened, n, np.array([m / n for m in means]), counted, "z") - np.eye(k)).max())


def transform(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, counted: bool = False) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and each of the first components."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = distinct_vectors(rows, id_col, vector_col)
    fitted = fit(vectors, counted)
    k = min(components, len(fitted.eigenvalues)) if fitted else 0
    if not k:
        return rows.sparkSession.createDataFrame([], names)
    done = c.materialise(whiten(vectors, fitted, k))
    error = identity_error(done, fitted.n, k, counted)
    # a bounded list, as at most SHARES vectors can each have more than one in SHARES of all rows
    all_rows = done.agg(F.sum("rows")).first()[0]
    hot = done.where(F.col("rows") * SHARES > all_rows).select("key", F.ceil(F.col("rows") * SHARES / F.lit(all_rows)).alias("shares"))
    dealt = keyed(rows, id_col, vector_col, False).join(F.broadcast(hot), "key", "left").select("id", "key", F.coalesce(F.monotonically_increasing_id() % F.col("shares"), F.lit(0)).alias("share"))
    shares = F.coalesce(F.col("shares"), F.lit(1))
    ready = done.join(F.broadcast(hot), "key", "left").select("key", "deviation", "z", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("share"))
    found = dealt.join(ready, ["key", "share"]).select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.get(F.array(*(F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues[:k])), F.col("at"))
    return found.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
