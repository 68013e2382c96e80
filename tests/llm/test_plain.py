"""Operators against plain versions that follow the definitions step by step."""

import math
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tonearm.llm import ctw, lz_fingerprint, packing, toxicity

# ---- the subsequence kernel ----


def plain_weights(word):
    """Weight of each three-letter subsequence, the mark before the word included."""
    classes = [toxicity.START] + [int(toxicity.CLASSES[min(ord(ch), 65535)]) for ch in word]
    out = defaultdict(float)
    for i, j, k in combinations(range(len(classes)), 3):
        if k - i < toxicity.SPAN and classes[i] and classes[j] and classes[k]:
            out[classes[i], classes[j], classes[k]] += toxicity.DECAY ** (k - i + 1) * (toxicity.START_WEIGHT if i == 0 else 1)
    return out


def plain_norm(n):
    """Norm of a word of n letters whose subsequences all differ."""
    total = sum(toxicity.DECAY ** (2 * (k - i + 1)) * (toxicity.START_WEIGHT**2 if i == 0 else 1) for i, _, k in combinations(range(n + 1), 3) if k - i < toxicity.SPAN)
    return math.sqrt(max(total, toxicity.DECAY**6))


def plain_kernel(a, b):
    x, y = plain_weights(a), plain_weights(b)
    like = min(sum(v * y[u] for u, v in x.items()) / plain_norm(len(a)) / plain_norm(len(b)), 1.2)
    return like**toxicity.POWER if like >= toxicity.FLOOR else 0.0


def test_kernel_equals_the_definition():
    rng = random.Random(3)
    stems = ["idiot", "moron", "stupid", "pathetic", "garden", "lovely", "aaaa", "ab", "über", "x1y2"]
    words = stems + ["".join(rng.sample(w + ".-*xq", len(w))) for w in stems] + [w[:2] + rng.choice(".-xe3") + w[2:] for w in stems] + [w + "s" for w in stems]
    got = toxicity.Landmarks(stems).kernel(words)
    want = np.array([[plain_kernel(w, s) for s in stems] for w in words])
    close = np.array([[abs(plain_kernel(w, s) - 0) < 1e-9 for s in stems] for w in words])
    assert np.abs(got - want).max() < 1e-4 and not close.all() and (want > 0).sum() > len(stems)


def test_margins_equal_the_kernel_expansion():
    words = ["idiot", "idiots", "moron", "table", "chair", "window", "garden", "river"]
    pos, neg = np.array([30.0, 9, 20, 0, 0, 0, 0, 0]), np.array([0.0, 0, 0, 30, 30, 30, 30, 30])
    model = toxicity.fit_words(words, pos, neg, 40, 300)
    for w in ["idiot", "idi0t", "id-iot", "marron", "table", "unlike", "x" * 100]:
        values = []
        for piece in toxicity.pieces(w):
            row = np.array([plain_kernel(piece, m) for m in model.marks.marks])
            near = (row[model.alpha > 0] > 0).any()
            values.append(model.bias + (row @ model.alpha if near else 0.0))
        assert abs(model.margins([w])[0] - max(values)) < 1e-2, w


def plain_scorer(model):
    """Score of a text by the definition, word by word."""
    weights, margins = {}, {}

    def kernel(a, b):
        for w in (a, b):
            if w not in weights:
                weights[w] = plain_weights(w)
        like = min(sum(v * weights[b].get(u, 0) for u, v in weights[a].items()) / plain_norm(len(a)) / plain_norm(len(b)), 1.2)
        return like**toxicity.POWER if like >= toxicity.FLOOR else 0.0

    def margin(word):
        if word not in margins:
            values = []
            for piece in toxicity.pieces(word):
                row = np.array([kernel(piece, m) for m in model.marks.marks])
                values.append(model.bias + (row @ model.alpha if (row[model.alpha > 0] > 0).any() else 0.0))
            margins[word] = max(values)
        return margins[word]

    def score(text):
        m = [margin(w) for w in text.split()] or [model.bias]
        above = [x for x in m if x > 0]
        z = model.scale @ np.array([1, max(m), math.log1p(sum(above)), math.log1p(len(above))])
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    return score


# ---- Lempel-Ziv likeness ----


def phrases(text):
    seen, start = set(), 0
    while start < len(text):
        end = start + 1
        while end < len(text) and text[start:end] in seen:
            end += 1
        seen.add(text[start:end])
        start = end
    return seen


def test_likeness_estimates_the_jaccard_of_phrase_sets():
    rng = random.Random(5)
    for n, exact in ((40, True), (6000, False)):
        for _ in range(25):
            a = "".join(rng.choice("abcdé ") for _ in range(n))
            cut = rng.randrange(n)
            b = a[:cut] + "".join(rng.choice("abcdé ") for _ in range(n - cut))
            x, y = phrases(a), phrases(b)
            want = len(x & y) / len(x | y)
            got = lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b))
            assert got == pytest.approx(want) if exact else abs(got - want) < 0.3
    assert lz_fingerprint.likeness(lz_fingerprint.fingerprint(""), lz_fingerprint.fingerprint("")) == 1
    assert lz_fingerprint.likeness(lz_fingerprint.fingerprint(""), lz_fingerprint.fingerprint("a")) == 0


# ---- context-tree weighting ----


class PlainTree:
    """Counts of all contexts up to DEPTH bytes for each of a byte's decisions."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for context, node, bit in self.decisions(t):
                for d in range(ctw.DEPTH + 1):
                    self.counts[context[len(context) - d :], node][bit] += 1
                    if d:
                        self.kids[context[len(context) - d + 1 :], node].add(context[len(context) - d :])
        self.known = {}

    @staticmethod
    def decisions(text):
        data = bytes(ctw.DEPTH) + text + b"\0"
        for i in range(ctw.DEPTH, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - ctw.DEPTH : i], node, bit
                node = node << 1 | bit

    def own(self, context, node):
        a, b = self.counts[context, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, node):
        if (context, node) not in self.known:
            own = self.own(context, node)
            if len(context) < ctw.DEPTH:
                below = sum(self.weighted(kid, node) for kid in self.kids[context, node])
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def chance(self, context, node, bit, d=0):
        """Chance of the bit under the node of the last d bytes of the context."""
        here = context[len(context) - d :]
        a, b = self.counts[here, node]
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        deeper = context[len(context) - d - 1 :]
        if d == ctw.DEPTH or deeper not in self.kids[here, node]:
            return kt
        share = math.exp(self.own(here, node) - math.log(2) - self.weighted(here, node))
        return share * kt + (1 - share) * self.chance(context, node, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.chance(*x)) for x in self.decisions(text))


def test_scores_equal_plain_context_tree_weighting(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the cat", "sat on", "the mat", "é", "Zz", ""]) for _ in range(rng.randrange(8)))) for i in range(40)] + [(100, None), (101, "quite new\x7f words")]
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode() for i, t in rows}
    tree = PlainTree([t for i, t in low.items() if zlib.crc32(str(i).encode()) % 5 != 1])
    got = ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for r in got:
        want = tree.score(low[r.doc_id])
        assert abs(r.score - want) < 1e-6 * (1 + abs(want))
        assert abs(r.bits_per_byte * (len(low[r.doc_id]) + 1) * math.log10(2) + want) < 1e-6 * (1 + abs(want))


# ---- the pipeline ----

WORDS = ["harbour", "letter", "silver", "meadow", "lantern", "orchard", "winter", "bridge", "copper", "saddle", "velvet", "pillow", "garden", "window", "thunder", "candle", "basket", "timber", "ribbon", "feather"]


def corpus():
    """Documents with planted cases: (id, text, source) and the ids of toxic, poor and copied ones."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(15)) for _ in range(n))
    texts, toxic, poor, copies = {}, set(), set(), {}
    for i in range(160):
        texts[i] = prose(40 + i % 50)
        if i % 4 == 1:
            toxic.add(i)
            texts[i] += " you " + rng.choice(["idiot", "moron"]) + " " + rng.choice(["idiot", "moron"]) + " " + prose(5)
    for i in range(160, 170):
        poor.add(i)
        texts[i] = prose(5) if i % 2 else prose(8) + " one two three four five six seven eight nine" * 6
    for i in range(170, 190):
        copies[i] = of = 4 * (i - 170) // 3 * 2
        while of % 4 == 1 or of in copies.values() and of != copies[i]:
            of += 1
        copies[i] = of
        words = texts[of].split()
        if i % 2:
            words[len(words) // 2] = "changed"
        texts[i] = " ".join(words).upper() if i % 3 == 0 else " ".join(words)
    for i in range(190, 200):
        texts[i] = prose(30) + f" write to a{i}@mail.example.org or call +1 (555) 123-45{i % 100:02d}, host 10.0.0.{i} " + prose(10)
    return [(i, t, "en", f"s{i % 7}", len(t)) for i, t in texts.items()], toxic, poor


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, toxic, poor = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(r[0], int(r[0] not in poor), int(r[0] in toxic)) for r in rows if r[0] < 170], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    text = {r[0]: r[1] for r in rows}

    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = {r.doc_id for r in stage["toxicity"](spark, docs, str(tmp_path)).collect()}
    plain = plain_scorer(model)
    assert kept == {i for i, t in text.items() if plain(t) < toxicity.CUTOFF} == set(text) - toxic
    now = docs.where(docs.doc_id.isin(sorted(kept)))

    # too few labels for any cutoff: the base rules alone reject
    def good(t):
        w = t.split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(inside) <= 30 * len(w)

    left = {r.doc_id for r in stage["quality"](spark, now, str(tmp_path)).collect()}
    assert left == {i for i in kept if good(text[i])} == kept - poor
    now = docs.where(docs.doc_id.isin(sorted(left)))

    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i in left for w in [text[i].lower().split()]}
    group = {i: i for i in left}
    for a, b in combinations(sorted(left), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((group[a], group[b]))
            group = {i: x if g == y else g for i, g in group.items()}
    once = {r.doc_id for r in stage["near_duplicates"](spark, now, str(tmp_path)).collect()}
    assert once == set(group.values()) and len(once) < len(left) - 8
    now = docs.where(docs.doc_id.isin(sorted(once)))

    def masked(t):
        for kind, pattern in (("email", r"\S+@[a-z.]+"), ("phone", r"\+1 \(555\) 123-45\d\d"), ("ip", r"10\.0\.0\.\d+")):
            t = re.sub(pattern, f"<{kind}>", t)
        return t

    clean = stage["pii"](spark, now, str(tmp_path))
    got = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert got == {i: (masked(text[i]), len(masked(text[i]))) for i in once} and sum("<phone>" in t for t, _ in got.values()) == 10

    out = stage["packing"](spark, clean, str(tmp_path)).toPandas()
    sizes = {i: len(t.split()) for i, (t, _) in got.items()}
    assert dict(zip(out.doc_id, out.tokens, strict=True)) == sizes
    order = sorted(sizes, key=lambda i: (-sizes[i], i))
    bins, where = [], {}
    for i in order:  # every source may be in a bin once; no two texts are equal here
        fit = [k for k, b in enumerate(bins) if b[0] >= sizes[i] and i % 7 not in b[1]]
        k = min(fit, key=lambda k: (bins[k][0], k), default=len(bins))
        if k == len(bins):
            bins.append([packing.CAPACITY, set()])
        bins[k][0] -= sizes[i]
        bins[k][1].add(i % 7)
        where[i] = k
    assert {i: int(b.split("-")[1]) for i, b in zip(out.doc_id, out.bin, strict=True)} == where
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(whole.doc_id) == sorted(out.doc_id) and set(whole.columns) == set(out.columns)


def test_tasks_leave_the_collector_as_it_was(spark):
    """Workers go on to other tasks, which may need it."""

    def states(batches):
        for b in batches:
            import gc

            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * len(b))], ["on"])

    docs = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(20)], "doc_id long, text string").repartition(4)
    for _ in range(2):
        assert lz_fingerprint.compare_with_edit_and_next(docs).count() == 20
        assert {r.on for r in docs.mapInArrow(states, "on boolean").collect()} == {True}
