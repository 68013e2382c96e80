"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions.  Every context of 0 to DEPTH preceding bytes keeps, for each decision, the
training counts of both bits, which give a Krichevsky-Trofimov estimate; the weighted probability of a node is half its
own estimate plus half the product of its children's, and a bit is predicted by the mixture of all depths that follows from
these weights.  The counts come from all training texts: tasks count byte runs of their rows, Spark adds them up.  Every
counted context takes part and none is dropped: the tree is dealt to tasks by the TOP bytes before the decision, since what lies below such a
context depends on no other one, and the levels above are at most 2**16 contexts in all.  A context that holds one in SPLIT of all distinct runs (so
at most SPLIT of them do) is dealt by one byte more, its own level stands with those above, and then no task meets more than 2**16 runs of one
context.  The tasks work out the chance of each run; runs that
make at least one in MAX_RUNS of all (so at most MAX_RUNS) are broadcast, the others of each text are joined.

Beside it stands the base score, add-half unigram over words.  Words that make at least one in MAX_COMMON of all training
tokens (so at most MAX_COMMON) are broadcast; the others of each text are joined by a shuffle.

Defined results: null text is the empty text, which has the end token and the end byte only; a missing id is the
empty string for the split into training and held-out rows; repeated rows each get their result; without any training
row, every byte costs eight bits and N and V are 0; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import _common as c

DEPTH = 4
MAX_RUNS = 1 << 20
#: Contexts of so many bytes deal the tree to tasks.
TOP = 2
#: Contexts that hold one in so many of all distinct runs are dealt by one byte more.
SPLIT = 1024
#: Runs of a task that are worked on at a time; those of one context stay together.
RUNS_HELD = 100_000
#: Rows of a batch of runs and counts, which are numbers only.
ROWS_SENT = 10_000
MAX_COMMON = 200_000
CHUNK = 2_000_000
WORDS_HELD = 400_000
END = b"\n"  # no word holds a line feed, so it can stand for the end token
_LOG2 = math.log(2)


def runs(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each text and its end byte: the byte and the `depth` bytes before it, as one number."""
    pad = bytes(depth)
    flat = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    code = np.zeros(len(flat) - depth, np.uint64)
    for k in range(depth + 1):
        code = code << np.uint64(8) | flat[k : len(flat) - depth + k]
    keep = np.ones(len(code), bool)
    at = np.cumsum([len(t) + 1 + depth for t in texts])[:-1] - depth
    for k in range(depth):
        keep[at + k] = False  # runs that end in the padding of the next text
    return code[keep]


def count_partial(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, run, n): words and byte runs with their counts in a task's rows; one of the two keys is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        seen, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def held() -> pa.RecordBatch:
            keys = list(words)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.int64()), pa.array([words[k] for k in keys], pa.int64())], ["word", "run", "n"])
            words.clear()
            return out

        for batch in batches:
            texts = [t.lower() for t in c.utf8(batch.column(0))]
            for a, b in c.slices(texts, CHUNK):
                for t in texts[a:b]:
                    words.update(t.split())
                words[END] += b - a
                got, n = np.unique(runs(texts[a:b], DEPTH), return_counts=True)
                seen, at = np.unique(np.concatenate([seen, got]), return_inverse=True)
                often = np.bincount(at, np.concatenate([often, n]), len(seen)).astype(np.int64)
                if len(words) > WORDS_HELD:
                    yield held()
                if len(seen) > 4 * MAX_RUNS:
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.binary()), pa.array(seen.astype(np.int64)), pa.array(often)], ["word", "run", "n"])
                    seen, often = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield held()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.binary()), pa.array(seen.astype(np.int64)), pa.array(often)], ["word", "run", "n"])

    return c.in_small_batches(docs.select(text_col), run, "word binary, run bigint, n bigint")


# ---- the tree ----


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov block probability."""
    def lg(x: np.ndarray) -> np.ndarray:
        some, back = np.unique(x, return_inverse=True)
        return np.array([math.lgamma(v) for v in some.tolist()], float)[back]

    return lg(zeros + 0.5) + lg(ones + 0.5) - lg(zeros + ones + 1.0) - math.log(math.pi)


class Tree:
    """keys[d]: sorted numbers (context of d bytes, decision node); one[d]: chance of bit 1 by the node's own counts;
    own[d]: weight of the node's own estimate against its children's."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]], first: int = 0, below: tuple | None = None):
        """counted[d]: byte runs of length first + d + 1 and their counts.

        below: keys, log weighted probability, zeros and ones of the level under the last, if it has one.
        """
        self.keys, self.one, self.own, self.first = [], [], [], first
        levels = []
        for run, n in counted:
            byte, context = run & 255, run >> 8
            nodes, zero, one = [], [], []
            for k in range(8):
                node = context << 8 | (1 << k | byte >> (8 - k))
                bit = byte >> (7 - k) & 1
                nodes.append(node)
                zero.append(n * (bit == 0))
                one.append(n * (bit == 1))
            key, at = np.unique(np.concatenate(nodes), return_inverse=True)
            levels.append((key, np.bincount(at, np.concatenate(zero), len(key)).astype(float), np.bincount(at, np.concatenate(one), len(key)).astype(float)))
        for depth in range(first + len(levels) - 1, first - 1, -1):
            key, zero, one = levels[depth - first]
            log_own = _kt(zero, one)
            if below is None:
                weighted, share = log_own, np.ones(len(key))
            else:
                # a child's context has one more byte in front: drop it to find the parent
                up = (below[0] >> 8 & ((1 << 8 * depth) - 1)) << 8 | below[0] & 255
                at = np.searchsorted(key, up)
                kids = np.bincount(at, below[1], len(key)).astype(float)
                rest_zero = np.maximum(zero - np.bincount(at, below[2], len(key)), 0)
                rest_one = np.maximum(one - np.bincount(at, below[3], len(key)), 0)
                kids += _kt(rest_zero, rest_one)  # occurrences whose longer context is not in the tree
                weighted = np.logaddexp(log_own, kids) - _LOG2
                share = np.exp(np.minimum(log_own - _LOG2 - weighted, 0))
            below = (key, weighted, zero, one)
            self.keys.insert(0, key)
            self.one.insert(0, (one + 0.5) / (zero + one + 1))
            self.own.insert(0, share)
        self.top = below

    def bits(self, run: np.ndarray, *above: Tree) -> np.ndarray:
        """log10 probability of the last byte of each run, after the bytes before it; above: trees of the levels over the first, from the root on."""
        total = np.zeros(len(run))
        byte = run & 255
        levels = [(t.first + k, t.keys[k], t.one[k], t.own[k]) for t in (*above, self) for k in range(len(t.keys))]
        for k in range(8):
            node = 1 << k | byte >> (8 - k)
            bit = byte >> (7 - k) & 1
            chance = np.full(len(run), 0.5)
            left = np.ones(len(run))  # weight that longer contexts have yet to share out
            mixed = np.zeros(len(run))
            inside = np.ones(len(run), bool)
            for depth, key, one, own in levels:
                if not len(key):
                    break
                want = (run >> 8 & ((1 << 8 * depth) - 1)) << 8 | node
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                inside &= key[at] == want
                chance = np.where(inside, one[at], chance)
                share = np.where(inside, own[at], 0)
                mixed += left * share * chance
                left *= 1 - share
            mixed += left * chance  # beyond the tree, the deepest node's own estimate holds
            total += np.log10(np.maximum(np.where(bit == 1, mixed, 1 - mixed), 1e-12))
        return total


def levels(run: np.ndarray, n: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Byte runs of first + 1 to last + 1 bytes with their counts, from longer ones."""
    out = []
    for depth in range(first, last + 1):
        key, at = np.unique(run & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        out.append((key, np.bincount(at, n, len(key))))
    return out


def _context() -> F.Column:
    return F.shiftright("run", 8).bitwiseAND((1 << 8 * TOP) - 1)


@dataclass
class Deal:
    """How the tree is dealt to tasks: by contexts of TOP bytes, those in `hot` by one byte more."""

    hot: list[int]

    def __post_init__(self) -> None:
        self.split = np.zeros(1 << 8 * TOP, bool)
        self.split[self.hot] = True

    def column(self) -> F.Column:
        more = F.shiftright("run", 8 * (TOP + 1)).bitwiseAND(255) + 1
        return _context() * 257 + F.when(_context().isin(self.hot), more).otherwise(0)

    def keys(self, run: np.ndarray) -> np.ndarray:
        context = run >> 8 & ((1 << 8 * TOP) - 1)
        return context * 257 + np.where(self.split[context], (run >> 8 * (TOP + 1) & 255) + 1, 0)

    def parts(self, run: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Bytes of context that are dealt by, and where in `run` these are."""
        deeper = self.split[run >> 8 & ((1 << 8 * TOP) - 1)]
        for first, at in ((TOP, np.flatnonzero(~deeper)), (TOP + 1, np.flatnonzero(deeper))):
            if len(at):
                yield first, at


def deal(counted: DataFrame) -> Deal:
    """The contexts that hold one in SPLIT of all distinct runs, SPLIT at most, are split."""
    total = counted.count()
    each = counted.groupBy(_context().alias("context")).count()
    return Deal([r["context"] for r in each.where(F.col("count") * SPLIT >= total).collect()])


def _by_context(counted: DataFrame, how: Deal, work: Callable[[np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(run, n) on all runs of some of the contexts dealt at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # run and n in two columns
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
            size += len(held[-1])
            if size >= RUNS_HELD:
                rows = np.concatenate(held)
                key = how.keys(rows[:, 0])
                cut = int(np.searchsorted(key, key[-1]))  # the last context may go on
                if cut:
                    yield from work(rows[:cut, 0], rows[:cut, 1])
                held, size = [rows[cut:]], len(rows) - cut if cut else 0
        if held and len(rows := np.concatenate(held)):
            yield from work(rows[:, 0], rows[:, 1])

    dealt = counted.select("run", "n", how.column().alias("context")).repartition("context").sortWithinPartitions("context")
    return dealt.select("run", "n").mapInArrow(run, schema)


def top_trees(counted: DataFrame, how: Deal) -> tuple[Tree, Tree]:
    """The levels of fewer than TOP bytes, and that of TOP bytes for split contexts, weighted against all that is below them."""

    def work(run: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first, at in how.parts(run):
            key, *values = Tree(levels(run[at], n[at], first, DEPTH), first).top
            up, to = np.unique((key >> 8 & ((1 << 8 * (first - 1)) - 1)) << 8 | key & 255, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(up), first - 1)), pa.array(up)] + [pa.array(np.bincount(to, v, len(up)).astype(float)) for v in values], ["depth", "node", "weighted", "zeros", "ones"])

    each = _by_context(counted, how, work, "depth bigint, node bigint, weighted double, zeros double, ones double").groupBy("depth", "node").agg(F.sum("weighted").alias("weighted"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    rows = c.materialise(each, ROWS_SENT).toPandas()  # at most 2**16 rows and 2**8 a split context

    def below(depth: int) -> tuple[np.ndarray, ...]:
        part = rows[rows["depth"] == depth]
        return (part["node"].to_numpy(np.int64), *(part[k].to_numpy(float) for k in ("weighted", "zeros", "ones")))

    def shorter(some: DataFrame, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
        few = some.groupBy(F.col("run").bitwiseAND((1 << 8 * (last + 1)) - 1).alias("run")).agg(F.sum("n").alias("n")).toPandas()
        return levels(few["run"].to_numpy(np.int64), few["n"].to_numpy(float), first, last)

    split = Tree(shorter(counted.where(_context().isin(how.hot)), TOP, TOP), TOP, below(TOP))
    under = tuple(np.concatenate(x) for x in zip(below(TOP - 1), split.top, strict=True))
    return Tree(shorter(counted, 0, TOP - 1), 0, under), split


def answers(counted: DataFrame, how: Deal, above: Broadcast[tuple[Tree, Tree]]) -> DataFrame:
    """(run, n, chance): log10 probability of the last byte of each run; runs with n = 0 are asked for only."""

    def work(run: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first, at in how.parts(run):
            some, times = run[at], n[at]
            own = Tree(levels(some[times > 0], times[times > 0], first, DEPTH), first)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(times), pa.array(own.bits(some, *above.value[: first - TOP + 1]))], ["run", "n", "chance"])

    return _by_context(counted, how, work, "run bigint, n bigint, chance double")


def known_chances(full: np.ndarray, answer: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
    """Summed log10 probability of the runs of each whole text and its end that are in `full`, and its other runs."""
    code, back = np.unique(runs(texts, DEPTH).astype(np.int64), return_inverse=True)
    at = np.minimum(np.searchsorted(full, code), max(len(full) - 1, 0))
    hit = full[at] == code if len(full) else np.zeros(len(code), bool)
    each = np.where(hit, answer[at], 0.0)[back] if len(full) else np.zeros(len(back))
    other = ~hit[back]
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]]
    offsets = np.r_[0, np.cumsum(np.add.reduceat(other.astype(np.int64), starts))].astype(np.int32)
    return np.add.reduceat(each, starts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[back[other]]))


# ---- the operator ----


def score_documents(docs: DataFrame, parts: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model scores of all documents, learnt from those whose crc32(id) mod `parts` is not `held`."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    train = slim.where(c.remainder(F.col("id"), parts) != held)
    counts = c.materialise(count_partial(train, "text").groupBy("word", "run").agg(F.sum("n").alias("n")))
    words = counts.where("word is not null").select("word", F.col("n").alias("c"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = counts.where("run is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    counted = counts.where("run is not null").select("run", "n")
    how = deal(counted)
    above = spark.sparkContext.broadcast(top_trees(counted, how))
    answered = c.materialise(answers(counted, how, above), ROWS_SENT)
    frequent = answered.where(F.col("n") * MAX_RUNS >= total).select("run", "chance").toPandas().sort_values("run")
    tree = spark.sparkContext.broadcast((frequent["run"].to_numpy(np.int64), frequent["chance"].to_numpy(float)))
    often = words.where(F.col("c") * MAX_COMMON >= n).toPandas()  # at most MAX_COMMON rows
    log_count = dict(zip((bytes(w) for w in often["word"]), np.log10(often["c"].to_numpy(float) + 0.5).tolist(), strict=True))
    common = spark.sparkContext.broadcast(log_count)
    plain = -math.log10(n + 0.5 * (v + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            texts = [t.lower() for t in c.utf8(batch.column(2))]
            for a, b in c.slices(texts, CHUNK):
                chance, other = known_chances(*tree.value, texts[a:b])
                rows = []
                for t in texts[a:b]:
                    found = t.split()
                    found.append(END)
                    logs = [known[w] for w in found if w in known]
                    rare = Counter(w for w in found if w not in known)
                    rows.append((len(found), len(logs), math.fsum(logs), list(rare), list(rare.values())))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.binary())), pa.array(cols[4], pa.list_(pa.int64())), pa.array(chance), other, pa.array([len(t) + 1 for t in texts[a:b]], pa.int64())], schema.names)

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("score", T.DoubleType()), T.StructField("other", T.ArrayType(T.LongType())), T.StructField("n_bytes", T.LongType())])
    first = c.materialise(c.in_small_batches(slim.select(F.monotonically_increasing_id().alias("row"), "id", "text"), score, schema))
    # each word once a row, as the tasks have counted it: one shuffle, by the word
    seldom = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("k"))
    met = seldom.join(words.where(F.col("c") * MAX_COMMON < n), "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - math.log10(0.5))).alias("more"))
    # runs that are not broadcast: each text's own, and the chances of those that no training text has
    other = first.select("row", F.explode("other").alias("run"))
    unseen = c.materialise(other.select("run").distinct().join(answered, "run", "left_anti").select("run", F.lit(0).cast("bigint").alias("n")))
    beside = counted.join(unseen.select(how.column().alias("context")).distinct(), how.column() == F.col("context"), "left_semi")
    new = c.materialise(answers(beside.unionByName(unseen), how, above).where("n = 0"), ROWS_SENT)
    c.discard(unseen)
    chances = answered.where(F.col("n") * MAX_RUNS < total).unionByName(new).select("run", "chance")
    others = other.join(chances, "run").groupBy("row").agg(F.sum("chance").alias("others"))
    out = first.drop("rare", "times", "other").join(met, "row", "left").join(others, "row", "left")
    score_ = F.col("score") + F.coalesce("others", F.lit(0.0))
    known = F.col("n_known") + F.coalesce("known", F.lit(0))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0)) + (F.col("n_tokens") - F.col("n_known")) * math.log10(0.5)
    return out.select(F.col("id").alias(id_col), (c.remainder(F.col("id"), parts) == held).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (logs + F.col("n_tokens") * plain).alias("base_score"), score_.alias("score"), (-score_ / (math.log10(2) * F.col("n_bytes"))).alias("bits_per_byte"))
