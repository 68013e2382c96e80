"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two fixed permutations of the 32-bit numbers make every signature coordinate: the first scatters the shingles of a
document, the second, shifted circularly by k, gives coordinate k as its minimum.  Documents with equal shingle sets
become one node at once.  Nodes that agree on a band share a bucket.  Pairs are compared on full sets only where they
can still join two groups: first every node with the bucket's leader; then the nodes of buckets that still hold several
groups, by an exact prefix filter on their rarest shingles (see _rare_pairs) and the parities of 1024 hashed
cells, of which every differing shingle turns at most one, so that they may not differ in more cells than the sets may.  Pairs within
one group need no look, and texts with enough words of their own do not meet in a phrase that all share, so large groups cost
rows, not squares of rows.  A 128-bit sketch of one-bit minima drops hopeless pairs before the sets are fetched
(a pair at the threshold fails it about once in 10**9).  With 30 bands of 5, a pair at Jaccard 0.8 shares no band
once in 150,000, at 0.85 once in 5 * 10**7.

Defined results: ids are whole numbers, any that fit 64 bits; texts that are null or hold no word have no shingles and stay
alone; a text with fewer words than a shingle takes is one shingle; rows with equal sets form one group, also if an id repeats,
and rows with one id and different texts are documents of their own; a null id counts as larger than any id, and a group of
null ids only has a null component_id and is kept; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import _common as c

WORDS = 5
SIMILARITY = 80
BANDS, ROWS = 30, 5
#: Differing bits of the 128 that a pair may show before its sets are compared: 12.8 +- 3.4 at Jaccard 0.8.
SKETCH_BITS = 36
#: Ids are broadcast to pick documents only up to this number (16 bytes each).
MAX_BROADCAST_IDS = 2_000_000
BLOCK = 16_384
#: A task keeps the hashes of so many words; beyond that it starts afresh.
WORDS_KEPT = 150_000
#: Parity cells of the exact filter on set differences.
CELLS = 1024

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scatter(x: np.ndarray) -> np.ndarray:
    """First permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _circulate(x: np.ndarray) -> np.ndarray:
    """Second permutation; its argument is shifted circularly for each coordinate."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: bytes, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text; known keeps hashes of words."""
    found = text.lower().split()  # A-Z only, and split at ASCII white space only, as these are bytes
    if not found:
        return np.zeros(0, np.uint64)
    if len(known) > WORDS_KEPT:
        known.clear()
    hashes = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out += h[k : k + n] * _ODD[k % len(_ODD)]
        out = _mix64(out)
    return np.unique(out)


def signature(found: np.ndarray, size: int) -> np.ndarray:
    shift = np.arange(size, dtype=np.uint32)[:, None]
    low = _scatter(found.astype(np.uint32))
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), BLOCK):
        best = np.minimum(best, _circulate(low[None, i : i + BLOCK] + shift).min(axis=1))
    return best


FEATURES = "doc bigint, text_hash bigint, n bigint, key_a bigint, key_b bigint, sketch_a bigint, sketch_b bigint, bands array<bigint>"


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def features(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers; number the rows first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        scale = _ODD[:ROWS]
        for batch in batches:
            rows = []
            for text in c.utf8(batch.column(2)):
                s = shingles(text, words, known)
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                if len(s):
                    sig = signature(s, BANDS * ROWS)
                    bits = np.packbits((sig[:128] & 1).astype(np.uint8)).view(np.int64)
                    mixed = _mix64((sig.reshape(BANDS, ROWS).astype(np.uint64) * scale).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _ODD[7])
                    bands = mixed.view(np.int64)
                else:
                    bits, bands = np.zeros(2, np.int64), np.zeros(0, np.int64)
                rows.append((len(s), int(key[0]), int(key[1]), int(bits[0]), int(bits[1]), bands))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["doc", "text_hash", "n", "key_a", "key_b", "sketch_a", "sketch_b", "bands"])

    return c.in_small_batches(docs.select(F.col(id_col).cast("bigint").alias("doc"), _text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")), run, FEATURES)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of links (a, b): the smallest node that it reaches.

    A round points each node at the smallest node within two links, follows these pointers to their ends by doubling, and
    contracts the links to the ends.  Two ends are more than two links apart, so each has a neighbour that no other end
    has: a round leaves half the nodes at most, and a path of n nodes takes about log2(n) tables in all.
    """
    links = c.materialise(links.select("a", "b").where("a <> b"))
    comp = None
    while comp is None or not links.isEmpty():
        both = links.union(links.select("b", "a"))
        one = c.materialise(both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m")).withColumnRenamed("a", "b"))
        up = c.materialise(both.join(one, "b").groupBy(F.col("a").alias("v")).agg(F.min("m").alias("up")))
        c.discard(one)
        moved = True
        while moved:
            x, y = up.alias("x"), up.alias("y")
            far = c.materialise(x.join(y, F.col("x.up") == F.col("y.v")).select("x.v", "y.up", (F.col("x.up") != F.col("y.up")).alias("moved")))
            c.discard(up)
            moved = not far.where("moved").isEmpty()
            up = far
        up = up.select("v", "up")
        if comp is None:
            comp, kept = up.toDF("node", "comp"), far
        else:
            old, kept = kept, c.materialise(comp.join(up, F.col("comp") == F.col("v"), "left").select("node", F.coalesce("up", "comp").alias("comp")))
            comp = kept
        ends = links.join(up, F.col("a") == F.col("v")).select(F.col("up").alias("a"), "b").join(up, F.col("b") == F.col("v")).select("a", F.col("up").alias("b"))
        fewer = c.materialise(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        c.discard(links)
        if kept is not far:
            c.discard(old, far)
        links = fewer
    c.discard(links)
    return comp


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows (x, ...) and comp: a node without links is a component of its own."""
    return rows.join(comp.toDF("x", "__comp"), "x", "left").withColumn("comp", F.coalesce("__comp", "x")).drop("__comp")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sizes and sketches allow the threshold."""
    some = nodes.select("node", "n", "sa", "sb")
    both = pairs.join(some.toDF("a", "n", "sa", "sb"), "a").join(some.toDF("b", "m", "ta", "tb"), "b")
    return both.where(_alike()).select("a", "b")


def _alike() -> Column:
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("ta"))) + F.bit_count(F.col("sb").bitwiseXOR(F.col("tb")))
    return (F.least("n", "m") * 100 >= F.greatest("n", "m") * SIMILARITY) & (apart <= SKETCH_BITS)


def _rare_pairs(open_: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Candidate pairs (a, b) of different groups among (x, comp, n, sa, sb) that can reach the threshold.

    All shingles are ordered, the rarest first.  A pair at the threshold shares a shingle that is among the first of
    the smaller set's, as many as two sets of its size may each lack and one more, and among the first of the
    larger set's, as many as that set may lack and one more; and what follows it in either set must do for the
    overlap.  So sets with enough shingles of their own do not meet in those that all have in common.
    """
    sets = c.materialise(_sets(texts, open_.select(F.col("x").alias("node")), words).withColumnRenamed("node", "x"))
    each = c.materialise(sets.select("x", F.explode("shingles").alias("shingle")))
    shared = c.materialise(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    # the shingles of one node only are the rarest and meet nobody: they count towards the order and need no row
    bits = [f"p{i}" for i in range(CELLS // 64)]
    cells = sets.select("x", *(F.col("cells")[i].alias(p) for i, p in enumerate(bits)))
    some = each.join(shared, "shingle").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("some"))
    own = F.col("n") - F.size("some")
    probe = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * SIMILARITY) / (100 + SIMILARITY)) + 1
    first = some.join(open_, "x").where(probe > own).select("x", "comp", "n", "sa", "sb", index.alias("index"), own.alias("own"), F.posexplode(F.slice("some", F.lit(1), (probe - own).cast("int"))).alias("at", "s"))
    rare = c.materialise(first.select("x", "comp", "n", "sa", "sb", F.col("s.shingle").alias("shingle"), (F.col("own") + F.col("at")).alias("at"), (F.col("own") + F.col("at") < F.col("index")).alias("early")))
    # each key's largest group; only pairs of different groups are of use
    count = rare.groupBy("shingle", "comp").agg(F.count("*").alias("k"), F.max("early").alias("early"))
    several = c.materialise(count.groupBy("shingle").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("groups"), F.max("early").alias("early")).where("groups > 1 and early").select("shingle", "main"))
    rows = c.materialise(rare.join(several, "shingle").join(cells, "x").withColumn("outside", F.col("comp") != F.col("main")).drop("main"))
    other = {"x": "y", "comp": "other", "n": "m", "sa": "ta", "sb": "tb", "at": "there", "early": "__early", "outside": "__outside"} | {p: f"q{p[1:]}" for p in bits}
    turned = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(other[p]))) for p in bits), F.lit(0))
    most = (F.col("n") + F.col("m")) * (100 - SIMILARITY)
    behind = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("there")) * (100 + SIMILARITY) >= (F.col("n") + F.col("m")) * SIMILARITY
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") < F.col("y")))
    fits = smaller & (F.col("comp") != F.col("other")) & behind & _alike() & (turned * (100 + SIMILARITY) <= most)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.withColumnsRenamed(other), "shingle").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    pairs = met(rows.where("early"), rows.where("outside")).union(met(rows.where("early and outside"), rows.where("not outside")))
    out = c.materialise(pairs.distinct())
    c.discard(sets, each, shared, rare, several, rows)
    return out


def _sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of some nodes: sorted distinct hashes; rows that share an id stand for one node."""
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [shingles(t, words, known) for t in c.utf8(batch.column(1))]
            cells = [np.packbits(np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=CELLS).astype(np.uint8) & 1).view(np.int64) for x in found]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in found], kind), pa.array(cells, kind)], ["node", "shingles", "cells"])

    return c.in_small_batches(texts.join(ids, "node", "left_semi"), run, "node bigint, shingles array<bigint>, cells array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("cells").alias("cells"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those pairs whose full shingle sets reach the threshold."""
    ids = c.materialise(pairs.select("a").union(pairs.select("b")).toDF("node").distinct())
    own = c.materialise(_sets(texts, ids, words).drop("cells"))
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")

    def arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
        flat, at = column.values.to_numpy(), column.offsets.to_numpy()
        return (flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(arrays(batch.column(2)), arrays(batch.column(3)), strict=True):
                inter = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * inter >= SIMILARITY * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = c.materialise(c.in_small_batches(both.select("a", "b", "s", "t"), linked, "a bigint, b bigint"))
    c.discard(ids, own)
    return out


def _grouped(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, n, root, label) of every row: the node that stands for its group and the group's smallest id.

    The root is null for rows without shingles, the label also for groups without any id.
    """
    feats = c.materialise(features(docs, words, id_col, text_col))
    # one node for each distinct set: its smallest id stands for it
    firsts = feats.where("n > 0").groupBy("key_a", "key_b").agg(F.min("doc").alias("least"), F.first("n").alias("n"), F.first("sketch_a").alias("sa"), F.first("sketch_b").alias("sb"), F.first("bands").alias("bands"))
    nodes = c.materialise(firsts.withColumn("node", F.col("least")))
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text"))
    # ids that do not tell sets apart: missing ones and those of several sets
    odd = c.materialise(feats.groupBy("doc").agg(F.min("key_a").alias("low"), F.max("key_a").alias("high")).where("low <> high or doc is null").select("doc"))
    plain = odd.isEmpty()
    if not plain:
        nodes = _renumbered(nodes, odd)
        texts = _with_keys(docs, words, text_col).join(nodes.select("key_a", "key_b", "node"), ["key_a", "key_b"]).select("node", "text")
    # every node with the leader of its bucket, the smallest node
    banded = nodes.select(F.explode("bands").alias("band"), F.col("node").alias("x"))
    leads = c.materialise(banded.groupBy("band").agg(F.min("x").alias("y"), F.count("*").alias("size")).where("size > 1").select("band", "y"))
    members = c.materialise(banded.join(leads, "band"))
    tested = c.materialise(_possible(members.where("x <> y").select(F.col("y").alias("a"), F.col("x").alias("b")).distinct(), nodes))
    links = _verified(tested, texts, words)
    comp = components(links)
    # what is left: nodes of buckets with several groups
    now = c.materialise(_with_component(members.select("band", "x"), comp))
    several = c.materialise(now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band"))
    open_ = c.materialise(now.join(several, "band", "left_semi").select("x", "comp").distinct())
    c.discard(leads, members, now, several)
    if not open_.isEmpty():
        sketched = open_.join(nodes.select(F.col("node").alias("x"), "n", "sa", "sb"), "x")
        found = _rare_pairs(sketched, texts, words)
        pairs = c.materialise(found.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            more = _verified(pairs, texts, words)
            comp = components(links.union(more))
            c.discard(more)
        c.discard(found, pairs)
    c.discard(tested, links, open_)
    place = nodes.select("key_a", "key_b", "node", "least").join(comp, "node", "left").select("key_a", "key_b", "least", F.coalesce("comp", "node").alias("root"))
    if plain:
        place = place.select("key_a", "key_b", "root", F.col("root").alias("label"))
    else:
        place = place.join(place.groupBy("root").agg(F.min("least").alias("label")), "root").select("key_a", "key_b", "root", "label")
    place = c.materialise(place)
    return feats.select("doc", "text_hash", "n", "key_a", "key_b").join(place, ["key_a", "key_b"], "left").select("doc", "text_hash", "n", "root", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc")).alias("label"))


def _renumbered(nodes: DataFrame, odd: DataFrame) -> DataFrame:
    """nodes whose numbers are in odd (doc) get a hash of their set that no other node has."""
    odd = odd.select(F.col("doc").alias("__odd"), F.lit(True).alias("__is"))
    for seed in itertools.count():
        other = F.xxhash64(F.lit(seed), "key_a", "key_b")
        new = c.materialise(nodes.join(odd, F.col("node").eqNullSafe(F.col("__odd")), "left").withColumn("node", F.when(F.col("__is"), other).otherwise(F.col("node"))).drop("__odd", "__is"))
        if new.groupBy("node").count().where("count > 1").isEmpty():
            return new


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: its id, n_shingles, component_id and kept."""
    return _grouped(docs, words, id_col, text_col).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), F.when((F.col("n") == 0) | F.col("label").isNull(), True).otherwise(F.coalesce(F.col("doc") == F.col("label"), F.lit(False))).alias("kept"))


def _with_keys(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """(key_a, key_b, text) of every row with shingles, for tables whose ids do not tell texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [shingles(t, words, known) for t in c.utf8(batch.column(0))]
            keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in found], np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(0)], ["key_a", "key_b", "text"])
            yield out.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    return c.in_small_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "key_a bigint, key_b bigint, text string")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: exactly one row of each group, and all rows without shingles.

    The row with the smallest id stays, null ids last; of rows that share it, the one with the smallest hash of the
    text; of rows that repeat id and text, any one.
    """
    rows = c.materialise(_grouped(docs, words, id_col, text_col).where("n > 0").select("doc", "text_hash", "root"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")).alias("best"), F.count("*").alias("size"))
    best = c.materialise(best.where("size > 1").select("root", F.col("best.doc").alias("best_doc"), F.col("best.text_hash").alias("best_hash")))
    told = c.materialise(rows.join(best, "root").select("doc", "text_hash", (F.col("doc").eqNullSafe(F.col("best_doc")) & (F.col("text_hash") == F.col("best_hash"))).alias("stays")))
    gone = c.materialise(told.where("not stays").select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__gone")).distinct())
    again = c.materialise(told.where("stays").groupBy(F.col("doc").alias("__doc"), F.col("text_hash").alias("__again")).count().where("count > 1").select("__doc", "__again"))
    c.discard(rows, best, told)
    here = F.col(id_col).cast("bigint").eqNullSafe(F.col("__doc"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= MAX_BROADCAST_IDS else df

    left = docs.withColumn("__hash", _text_hash(text_col)).join(small(gone), here & (F.col("__hash") == F.col("__gone")), "left_anti")
    if again.isEmpty():
        return left.drop("__hash")
    twice = here & (F.col("__hash") == F.col("__again"))
    few = small(again)
    one = left.join(few, twice, "left_semi").dropDuplicates([id_col, "__hash"])
    return left.join(few, twice, "left_anti").unionByName(one).drop("__hash")
