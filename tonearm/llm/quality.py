"""Quality rules whose cutoffs carry a guarantee on false rejections.

Each rule rejects documents beyond a cutoff of one measure.  For each stratum (language) and rule, the cutoffs of a fixed
ladder are tested from the most lenient on: a cutoff passes if the exact binomial tail rules out, on labelled good
documents, that it rejects more than RISK of them.  Testing stops at the first failure (fixed sequence), and the level is
shared out over all rules and strata (Bonferroni), so with probability 1 - LEVEL every cutoff in use keeps its promise, and
all rules together reject at most len(LADDERS) * RISK of a stratum's good documents.  The bound takes the labelled documents for
independent draws: equal texts of a stratum count once; near copies count each.  A rule without a passing cutoff rejects nothing.

Defined results: null text has no words and fails the base rules; a null stratum is a stratum of its own; labels that are
null or neither 0 nor 1 are ignored, repeated labels of an id count once (0 wins); without labels only the base rules
reject; repeated rows each get their result; extra columns are ignored by judge() and kept by keep_good().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import _common as c

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent
#: A rule may reject this share of a stratum's good documents.
RISK = 0.01
LEVEL = 0.05
SYMBOLS = b"#*$%&|<>"
#: measure, whether larger is worse, cutoffs from the most lenient to the strictest.
LADDERS = [
    ("symbol_share", True, [0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10]),
    ("dup_line_share", True, [0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20]),
    ("repeat_share", True, [0.95, 0.80, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10]),
    ("mean_word", True, [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
    ("mean_word", False, [1.5, 2.0, 2.5, 3.0, 3.5]),
]
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure(text: bytes) -> tuple[int, ...]:
    """The figures of _MEASURES for a UTF-8 text."""
    words = text.split()  # of bytes: splits at ASCII white space only
    n = len(words)
    solid = b"".join(words)
    chars = len(solid.decode("utf-8", "replace")) if not solid.isascii() else len(solid)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        often = Counter(windows)
        if len(often) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return n, chars, symbols, dup, repeated, lines


def measures(docs: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stratum, text_hash, figures) of every document; no shuffle."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("stratum", T.StringType()), T.StructField("text_hash", T.LongType()), *(T.StructField(m, T.LongType()) for m in _MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(measure, c.utf8(batch.column(3))), strict=True)) or [[]] * len(_MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2)] + [pa.array(x, pa.int64()) for x in cols], schema.names)

    return c.in_small_batches(docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")), run, schema)


def _value(name: str) -> Column:
    """A measure as a double; 0 where it has no meaning."""
    over = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "mean_word": ("word_chars", "n_words")}
    a, b = over[name]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _beyond(name: str, larger: bool, cutoff) -> Column:
    return _value(name) > cutoff if larger else _value(name) < cutoff


def tail(k: int, n: int, p: float) -> float:
    """Exact chance of k or fewer rejections among n if each has probability p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(rejected: list[int], n: int, level: float, risk: float = RISK) -> int | None:
    """Index of the strictest cutoff that passes, testing in order until one fails."""
    best = None
    for i, k in enumerate(rejected):
        if not n or k >= n * risk or tail(k, n, risk) > level:
            break
        best = i
    return best


def calibrate(figures: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, cut_0, cut_1, ...): cutoffs in use, null where a rule rejects nothing.

    Only strata with enough good labels to pass any test are brought to the driver: one row of counts each.
    """
    spark = figures.sparkSession
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    good = figures.where(~base_failed()).join(y.where("y = 1").select("id"), "id", "left_semi").dropDuplicates(["stratum", "text_hash"])
    counts = [F.sum(_beyond(m, larger, cut).cast("long")).alias(f"r{i}_{j}") for i, (m, larger, cuts) in enumerate(LADDERS) for j, cut in enumerate(cuts)]
    least = math.log(level / len(LADDERS)) / math.log1p(-risk)
    rows = good.groupBy("stratum").agg(F.count("*").alias("n"), *counts).where(F.col("n") >= least).collect()
    share = level / (len(LADDERS) * max(1, len(rows)))
    out = []
    for r in rows:
        got = [certified([r[f"r{i}_{j}"] for j in range(len(cuts))], r["n"], share, risk) for i, (_, _, cuts) in enumerate(LADDERS)]
        out.append((r["stratum"], *(None if g is None else LADDERS[i][2][g] for i, g in enumerate(got))))
    schema = T.StructType([T.StructField("stratum", T.StringType()), *(T.StructField(f"cut_{i}", T.DoubleType()) for i in range(len(LADDERS)))])
    return spark.createDataFrame(out, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base figures, base_failed and kept of every document."""
    figures = c.materialise(measures(docs, stratum_col, id_col, text_col))
    cuts = calibrate(figures, labels, id_col)
    rejected = F.lit(False)
    for i, (m, larger, _) in enumerate(LADDERS):
        rejected = rejected | F.coalesce(_beyond(m, larger, F.col(f"cut_{i}")), F.lit(False))
    # as many rows as strata that passed a test: fewer than labels / 500
    joined = figures.alias("f").join(F.broadcast(cuts).alias("t"), F.col("f.stratum").eqNullSafe(F.col("t.stratum")), "left")
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; the texts are not shuffled."""
    known = labels.select(F.col(id_col).alias("__id")).distinct()
    some = docs.join(known, F.col(id_col) == F.col("__id"), "left_semi")
    rows = calibrate(c.materialise(measures(some, stratum_col, id_col, text_col)), labels, id_col).collect()  # one row a stratum
    cuts = {r["stratum"]: [r[f"cut_{i}"] for i in range(len(LADDERS))] for r in rows}

    def bad(figures: tuple[int, ...], stratum: str | None) -> bool:
        n, chars, symbols, dup, repeated, lines = figures
        if n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n:
            return True
        value = {"symbol_share": symbols / chars, "dup_line_share": dup / lines, "repeat_share": repeated / n, "mean_word": chars / n}
        return any(cut is not None and (value[m] > cut if larger else value[m] < cut) for (m, larger, _), cut in zip(LADDERS, cuts.get(stratum, [None] * len(LADDERS)), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = c.utf8(batch.column(batch.schema.get_field_index(text_col)))
            strata = batch.column(batch.schema.get_field_index(stratum_col)).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([not bad(measure(t), s) for t, s in zip(texts, strata, strict=True)], pa.bool_()))

    return c.in_small_batches(docs, run, docs.schema)
