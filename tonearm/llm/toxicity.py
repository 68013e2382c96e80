"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel compares two words by the three-letter subsequences they share, gaps allowed: an occurrence
that spans s letters weighs DECAY**s, so an insult with letters put between still matches; a word with signs inside is also
read without them, so that signs count as no letters however many there are; a mark before
the first letter takes part, and the normalised value is raised to POWER (a polynomial kernel on top).
Every word of a sentence inherits the label of its document (a multiple-instance setting); a squared-hinge
SVM in the Nystroem space of the landmark words separates them.  A logistic model on the largest, the summed and the
counted word margins gives the document's score.  Margins are worked out once for each distinct word a task meets.

Defined results: null text is the empty text, which scores like a text without any insult; a missing id is an id of
its own; repeated rows get equal scores; without labels of both classes all scores are 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import _common as c

DECAY = 0.7
#: An occurrence of a subsequence spans at most this many characters.
SPAN = 6
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: At most so many labelled documents, taken in the order of a hash of their text, fit the model.
MAX_TRAIN_DOCS = 20_000
#: At most so many of their words of either kind fit the model.
MAX_TRAIN_WORDS = 12_000
LANDMARKS = 160
POWER = 4
FLOOR = 0.6
START_WEIGHT = 2.0
LONGEST = 32
WORDS_KEPT = 400_000
CUTOFF = 0.3
CHUNK = 1_000_000
#: Landmarks are gathered into so many groups to rule words out before the kernel is worked out.
GROUPS = 10
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
#: Three or more letters set apart by single spaces form one more word.
APART = re.compile(r"(?<!\S)(?:[^\W_] ){2,}[^\W_](?!\S)")

#: Digits and signs that stand for letters.  Fixed values.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
GAP, START, BREAK = 0, 63, 255


def _classes() -> np.ndarray:
    """Class of each code point below 65536: 1-26 letters, 27-62 hashed other letters, GAP for signs, BREAK for space."""
    out = np.zeros(65536, np.uint8)
    for i in range(65536):
        ch = chr(i)
        low = LOOKALIKES.get(ch, ch).lower()[:1]
        if ch in " \t\n\r\x0b\x0c":
            out[i] = BREAK
        elif "a" <= low <= "z":
            out[i] = ord(low) - 96
        elif low.isalnum():
            out[i] = 27 + (ord(low) * 2654435761 >> 8) % 36
    return out


CLASSES = _classes()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all characters, each word behind SPAN breaks, and where each word starts; breaks end the array."""
    tail = " " * SPAN
    flat = np.frombuffer(("".join(tail + t for t in texts) + tail).encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0] + [len(t) + SPAN for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    return CLASSES[np.minimum(flat, 65535)], np.asarray(starts, np.int64)


def occurrences(cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pattern of offsets: code of the subsequence at every position (0: none) and its weight."""
    n = len(cls)
    stop = cls == BREAK
    letter = np.where(stop, START, cls).astype(np.uint32)
    reach = np.full(n, SPAN, np.uint8)  # characters to the next break, up to SPAN
    for k in range(SPAN - 1, 0, -1):
        reach[: n - k][stop[k:]] = k
    boost = np.where(stop, START_WEIGHT, 1).astype(np.float32)
    for a, b in OFFSETS:
        m = max(0, n - b)
        first, mid, last = letter[:m], letter[a : a + m], letter[b : b + m]
        ok = (first > 0) & (mid > 0) & (last > 0) & (reach[:m] > b)
        yield np.where(ok, first << 12 | mid << 6 | last, 0), boost[:m] * np.float32(DECAY ** (b + 1))


def length_norm(lengths: np.ndarray) -> np.ndarray:
    """Norm of a word's subsequence counts if all its subsequences differ; divides its kernel values."""
    total = np.zeros(len(lengths))
    for _, b in OFFSETS:
        total += (np.maximum(lengths - b, 0) + START_WEIGHT**2 * (lengths >= b)) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(total, DECAY**6))


def without_signs(word: str) -> str:
    """The letters, digits and lookalikes of a word; the word itself if it has none."""
    return "".join(ch for ch in word if CLASSES[min(ord(ch), 65535)] != GAP) or word


def pieces(word: str) -> list[str]:
    """A word, also without the signs inside, or their stretches of LONGEST characters if longer: the best one counts."""
    word = word.strip(EDGES)
    plain = without_signs(word)
    return stretches(word) + (stretches(plain) if plain != word else [])


def stretches(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Landmarks:
    """Subsequence weights of the landmark words, one column each."""

    def __init__(self, marks: list[str]):
        own: dict[int, np.ndarray] = {}
        for j, word in enumerate(marks):
            norm = length_norm(np.array([len(word)]))[0]
            for codes, weight in occurrences(encode([word])[0]):
                for u, v in zip(codes[codes > 0], weight[codes > 0], strict=True):
                    own.setdefault(int(u), np.zeros(len(marks), np.float32))[j] += v / norm
        self.marks = marks
        self.index = np.zeros(1 << 18, np.int32)
        self.rows = np.zeros((len(own) + 1, len(marks)), np.float32)
        for k, (u, row) in enumerate(own.items(), 1):
            self.index[u], self.rows[k] = k, row

    def bound(self, words: list[str], most: np.ndarray) -> np.ndarray:
        """Likeness that no landmark exceeds, from the greatest weight of each row among the landmarks."""
        out = np.zeros(len(words))
        for lo in range(0, len(words), 10_000):
            part = words[lo : lo + 10_000]
            cls, starts = encode(part)
            each = np.zeros(len(cls), np.float32)
            for codes, weight in occurrences(cls):
                each[: len(codes)] += most[self.index[codes]] * weight
            out[lo : lo + 10_000] = np.add.reduceat(each, starts)
        return out / length_norm(np.array([len(w) for w in words]))

    def likeness(self, words: list[str], rows: np.ndarray) -> np.ndarray:
        """Summed weights of a table with one row for each known subsequence, over the norm of each word."""
        out = np.zeros((len(words), rows.shape[1]), np.float32)
        for lo in range(0, len(words), 4000):
            part = words[lo : lo + 4000]
            cls, starts = encode(part)
            where, which, how = [], [], []
            for codes, weight in occurrences(cls):
                at = self.index[codes]
                hit = np.flatnonzero(at)
                where.append(np.searchsorted(starts, hit, "right") - 1)
                which.append(at[hit])
                how.append(weight[hit])
            where, which, how = np.concatenate(where), np.concatenate(which), np.concatenate(how)
            order = np.argsort(where, kind="stable")
            where, which, how = where[order], which[order], how[order]
            if len(where):
                first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
                for f in range(0, len(first), 500):
                    x, y = first[f], first[f + 500] if f + 500 < len(first) else len(where)
                    out[lo + where[first[f : f + 500]]] = np.add.reduceat(rows[which[x:y]] * how[x:y, None], first[f : f + 500] - x, axis=0)
        return out / length_norm(np.array([len(w) for w in words])).astype(np.float32)[:, None]

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of words (rows) against landmarks (columns); a likeness below FLOOR counts as none."""
        out = np.minimum(self.likeness(words, self.rows), np.float32(1.2))
        return np.where(out >= FLOOR, out, np.float32(0)) ** POWER


@dataclass
class Model:
    marks: Landmarks
    alpha: np.ndarray  # weight of each landmark
    bias: float
    scale: np.ndarray  # logistic weights: intercept, largest margin, log sum, log count
    fitted: bool
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, words: list[str]) -> np.ndarray:
        """Of each raw word the margin of its best stretch; a word unlike all landmarks that speak for toxicity has the bias."""
        cut = [pieces(w) for w in words]
        flat = [p for x in cut for p in x]
        got = np.full(len(flat), self.bias)
        toxic = np.flatnonzero(self.alpha > 0)
        if len(toxic):
            groups = [self.marks.rows[:, g].max(axis=1) for g in np.array_split(toxic, min(GROUPS, len(toxic)))]
            near = np.flatnonzero(self.marks.bound(flat, np.max(groups, axis=0)) >= FLOOR)
            grouped = np.stack(groups, axis=1)
            for lo in range(0, len(near), 4000):  # few words at a time: the tables are as wide as the landmarks
                at = near[lo : lo + 4000]
                # the slack covers the rounding of single-precision sums
                at = at[self.marks.likeness([flat[i] for i in at], grouped).max(axis=1) >= FLOOR - 1e-4]
                found = self.marks.kernel([flat[i] for i in at])
                close = found[:, toxic].max(axis=1) > 0
                got[at[close]] += found[close] @ self.alpha
        return np.maximum.reduceat(got, np.cumsum([0] + [len(x) for x in cut[:-1]])) if words else np.zeros(0)

    def features(self, texts: list[str], known: dict[bytes, float]) -> np.ndarray:
        """Largest word margin, log(1 + summed positive margins), log(1 + words with a positive margin) of each text.

        known keeps margins of words between calls; it is emptied when it holds WORDS_KEPT.
        """
        words = [t.encode("utf-8", "replace").split() for t in texts]
        for i, t in enumerate(texts):
            if APART.search(t):
                words[i] += [re.sub(r"\s", "", x).encode() for x in APART.findall(t)]
        if len(known) > WORDS_KEPT:
            known.clear()
        new = sorted({w for x in words for w in x}.difference(known))
        known.update(zip(new, self.margins([w.decode("utf-8", "replace") for w in new]).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for i, x in enumerate(words):
            m = np.array([known[w] for w in x]) if x else np.array([self.bias])
            out[i] = m.max(), np.log1p(m[m > 0].sum()), np.log1p((m > 0).sum())
        return out

    def score(self, texts: list[str], known: dict[bytes, float]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        f = self.features(texts, known)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + f @ self.scale[1:], -30, 30)))


#: Margins that this Python worker has worked out for the model it used last.
_KEPT: dict[str, dict[bytes, float]] = {}


def margins_kept(model: Model) -> dict[bytes, float]:
    if model.name not in _KEPT:
        _KEPT.clear()
    return _KEPT.setdefault(model.name, {})


def scores(model: Model, texts: list[str], known: dict[bytes, float]) -> np.ndarray:
    parts = [model.score(texts[a:b], known) for a, b in c.slices(texts, CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0)


# ---- fitting ----


def _landmarks(words: list[str], pos: np.ndarray, neg: np.ndarray, rate: float) -> list[str]:
    """Words and stems that toxic documents favour most, then the other words most like them, then common words."""
    groups: dict[str, list[float]] = {}
    for w, p, q in zip(words, pos, neg, strict=True):
        for stem in {w, *(w[:k] for k in (4, 5, 6, 7, 8) if len(w) > k)}:
            g = groups.setdefault(stem, [0.0, 0.0])
            g[0] += p
            g[1] += p + q
    z = {w: (p - n * rate) / np.sqrt(n * rate * (1 - rate) + 1) for w, (p, n) in groups.items() if p >= 0.5 * n}
    good = [w for w in sorted(z, key=lambda w: (-z[w], -len(w), w))[: LANDMARKS // 2] if z[w] > 3]
    plain = [words[i] for i in np.argsort(-neg, kind="stable") if neg[i] > 0 and pos[i] <= 2 * rate * (pos[i] + neg[i])]
    if good:
        near = Landmarks(good).kernel(plain).max(axis=1)
        plain = [plain[i] for i in np.argsort(-near, kind="stable")[: LANDMARKS // 2]] + plain
    return list(dict.fromkeys(good + plain))[:LANDMARKS]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ya, wa = x[active], y[active], weight[active] * cost
        new = np.linalg.solve(ridge + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ ya)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(f), 1)), f])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * f.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(ridge + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_words(words: list[str], pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> Model:
    """Model without its logistic part, from each word's count of toxic and other documents.

    Each occurrence has its document's label; as ordinary words fill toxic documents too, a word counts as an
    example of toxicity only as far as toxic documents favour it.
    """
    rate = n_pos / (n_pos + n_neg)
    marks = Landmarks(_landmarks(words, pos, neg, rate))
    values, vectors = np.linalg.eigh(marks.kernel(marks.marks).astype(float) + 1e-2 * np.eye(len(marks.marks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = np.maximum(marks.kernel(words), marks.kernel([without_signs(w) for w in words])) @ root
    favour = np.clip((pos / n_pos) / np.maximum(neg / n_neg, 0.5 / n_neg) / 5 - 1, 0, 1)
    weight = np.concatenate([pos * favour, np.minimum(neg, 20)])
    w = _svm(np.vstack([x, x]), np.repeat([1.0, -1.0], len(words)), weight)
    return Model(marks, root @ w[:-1], float(w[-1]), np.zeros(4), True)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_words: int = MAX_TRAIN_WORDS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows whose crc32(id) mod 4 is not 2; at most max_docs of them, by a hash of the text.

    Rows that repeat both id and text count once.  Of their words of 3 to 40 characters that occur in two documents at least,
    the max_words that toxic documents favour most and the max_words most frequent ones in others are the examples.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)").where(c.remainder(F.col("__id"), 4) != 2).groupBy("__id").agg(F.max("__y").alias("__y"))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # ids and hashes are ranked; the texts of those picked, max_docs at most, come from a second look at the table
    hashed = texts.select("__id", F.xxhash64("__text").alias("__hash")).join(known, "__id").distinct()
    picks = c.materialise(hashed.orderBy("__hash", "__id").limit(max_docs))
    picked_texts = texts.withColumn("__hash", F.xxhash64("__text")).join(F.broadcast(picks), ["__id", "__hash"]).dropDuplicates(["__id", "__hash"])
    train = c.materialise(picked_texts.select("__text", "__y").repartition(c.shuffle_partitions(docs.sparkSession)))
    size = {r["__y"]: r["count"] for r in train.groupBy("__y").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    empty = Model(Landmarks([]), np.zeros(0), -1.0, np.zeros(4), False)
    if not n_pos or not n_neg:
        return empty
    word = F.explode(F.array_distinct(F.split(F.lower("__text"), f"[{c.SPACE}]+"))).alias("word")
    counts = train.select("__y", word).select("__y", F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word")).where(F.length("word").between(3, 40)).groupBy("word").agg(F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg"))
    counts = c.materialise(counts.where("pos + neg > 1"))
    rate = n_pos / (n_pos + n_neg)
    told = F.col("pos") - F.lit(rate) * (F.col("pos") + F.col("neg"))
    picked: dict[str, Row] = {}
    for order in (told.desc(), F.col("neg").desc()):
        picked |= {r["word"]: r for r in counts.orderBy(order, "word").limit(max_words).collect()}
    rows = sorted(picked.values(), key=lambda r: r["word"])
    if not rows:
        return empty
    model = fit_words([r["word"] for r in rows], np.array([r["pos"] for r in rows], float), np.array([r["neg"] for r in rows], float), n_pos, n_neg)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = margins_kept(model)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in c.slices(texts, CHUNK):
                f = model.features(texts[a:b], known)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2]), batch.column(1).slice(a, b - a)], ["a", "b", "c", "y"])

    seen = c.in_small_batches(train, features, "a double, b double, c double, y int").toPandas()
    model.scale = _logistic(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy(float))
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for each document; no shuffle."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = margins_kept(model)
        for batch in batches:
            got = scores(model, [t or "" for t in batch.column(1).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], [id_col, "score"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("score", T.DoubleType())])
    out = c.in_small_batches(docs.select(id_col, text_col), run, schema)
    return out.select(id_col, (c.remainder(F.col(id_col), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that score below the cutoff, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = margins_kept(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(scores(model, texts, known) < CUTOFF))

    return c.in_small_batches(docs, run, docs.schema)
