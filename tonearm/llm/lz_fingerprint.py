"""Document fingerprints from Lempel-Ziv phrases.

Each text is parsed into LZ78 phrases: the longest phrase seen before plus one character.  The set of phrases
is hashed, and the SIZE smallest hashes are the fingerprint; the likeness of two fingerprints is the share of common
hashes among the smallest of both, an estimate of the Jaccard likeness of the phrase sets (exact for short texts).

Defined results: null text is the empty text with an empty fingerprint; two empty fingerprints have likeness 1, an empty
and another 0; rows are taken in ascending id (nulls first), repeated ids by text; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import _common as c

SIZE = 64
#: Ranges of ids for each shuffle partition; more make partitions more even.
RANGES = 4
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Parser:
    """LZ78 parsing of a text piece by piece, on a tree of the phrases: a node holds its children by character.

    ends: where the phrases end; a phrase that is still open ends with the text.
    """

    def __init__(self) -> None:
        self.root: dict = {}
        self.node, self.at, self.ends = self.root, 0, []

    def feed(self, text: str) -> None:
        root, node, at, ends = self.root, self.node, self.at, self.ends
        for ch in text:
            at += 1
            below = node.get(ch)
            if below is None:
                node[ch] = {}
                node = root
                ends.append(at)
            else:
                node = below
        self.node, self.at = node, at

    def feed_on_trial(self, text: str) -> list[int]:
        """The ends of all phrases if the text went on like this; the parser stays as it is."""
        root, node, at, ends, grown = self.root, self.node, self.at, list(self.ends), []
        for ch in text:
            at += 1
            below = node.get(ch)
            if below is None:
                node[ch] = {}
                grown.append((node, ch))
                node = root
                ends.append(at)
            else:
                node = below
        if node is not root:
            ends.append(at)
        for up, ch in grown:
            del up[ch]
        return ends


def parse(text: str) -> list[int]:
    """Ends of the LZ78 phrases of the text; the last one may have come before."""
    return Parser().feed_on_trial(text)


def _hashes(text: str, ends: np.ndarray) -> np.ndarray:
    """Hashes of the phrases between the ends; they do not depend on what stands before."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(code)
    power, back = _powers(n)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:n], dtype=np.uint64)])
    start = np.concatenate([[0], ends[:-1]])
    h = (run[ends] - run[start]) * back[start] + (ends - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(32)


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to the n-th; kept up to the longest text met."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_R, _R_INVERSE)):
            each = np.full(n + 1, base, np.uint64)
            each[0] = 1
            _POWERS[k] = np.multiply.accumulate(each)
    return _POWERS[0], _POWERS[1]


def _smallest(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:SIZE]


def fingerprint(text: str, ends: list[int] | None = None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint64)
    return _smallest(_hashes(text, np.array(parse(text) if ends is None else ends, np.int64)))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    a, b = set(x.tolist()), set(y.tolist())
    both = a | b
    if len(x) == SIZE or len(y) == SIZE:
        both = set(sorted(both)[:SIZE])
    return len(a & b & both) / len(both)


def to_hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt by ranges of the id and sorted, (range, id, text, last): a range's last row is the first of the next.

    The ranges come from approximate quantiles of the ids; one shuffle of the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    number = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    n = c.shuffle_partitions(spark) * RANGES
    cuts = rows.where("id is not null").select(F.percentile_approx(F.col("id").cast("double"), [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda q: q <= number))
    rows = rows.withColumn("range", place.cast("int"))
    firsts = rows.groupBy("range").agg(F.min(F.struct("id", F.xxhash64("text").alias("h"))).alias("first"), F.count("*").alias("n")).collect()  # one row a range
    if not firsts:
        return rows.withColumn("last", F.lit(False))
    order = sorted(r["range"] for r in firsts)
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    heads = spark.createDataFrame([(r["range"], r["first"]["id"], r["first"]["h"], before[r["range"]]) for r in firsts], T.StructType([T.StructField("range", T.IntegerType()), T.StructField("fid", docs.schema[id_col].dataType), T.StructField("fh", T.LongType()), T.StructField("before", T.IntegerType())]))
    first = rows.join(F.broadcast(heads), "range").where(F.col("id").eqNullSafe(F.col("fid")) & (F.xxhash64("text") == F.col("fh"))).dropDuplicates(["range"])
    again = first.select(F.col("before").alias("range"), "id", "text", F.lit(True).alias("last"))
    both = rows.select("range", "id", "text", F.lit(False).alias("last")).union(again)
    return both.repartition(n, "range").sortWithinPartitions("range", "last", F.col("id").asc_nulls_first(), F.xxhash64("text"))


def compare_with_edit_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(k, t) for k, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # trees of phrases hold no cycles, and looking for some costs a third of the time
        try:
            yield from each(batches)
        finally:  # the worker goes on to other tasks
            if collects:
                gc.enable()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one
        for batch in batches:
            ids, out = [], []
            for at, rid, text, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                work = Parsed(text)
                if held and held[0] == at:
                    ids.append(held[1])
                    out.append(_row(held[2], work))
                held = None if last else (at, rid, work)
            kind = batch.schema.field(1).type
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind)] + [pa.array(x, k) for x, k in zip(cols, arrow, strict=True)], schema.names)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


class Parsed:
    """A text with its parser as it stood where an edit would begin, its phrases and its fingerprint."""

    def __init__(self, text: str):
        self.text, self.parser = text, Parser()
        self.same = len(text) - len(text) // 4
        self.parser.feed(text[: self.same])
        ends = np.array(self.parser.feed_on_trial(text[self.same :]), np.int64)
        self.hashes = _hashes(text, ends) if text else np.zeros(0, np.uint64)
        self.prints = _smallest(self.hashes)


def _row(own: Parsed, following: Parsed) -> tuple:
    new = edited(own.text, following.text)
    if new == own.text:
        changed = own.prints
    else:
        ends = own.parser.feed_on_trial(new[own.same :])
        k = len(own.parser.ends)  # phrases that end in the part that stays
        begin = ends[k - 1] if k else 0
        tail = _hashes(new[begin:], np.array(ends[k:], np.int64) - begin) if len(ends) > k else np.zeros(0, np.uint64)
        changed = _smallest(np.concatenate([own.hashes[:k], tail]))
    return len(own.text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(own.prints), to_hex(changed), likeness(own.prints, changed), likeness(own.prints, following.prints)
