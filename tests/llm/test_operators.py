import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonearm.llm import chat, ctw, html_tree, lz_fingerprint, minhash, packing, pii, quality, queries, sentencepiece_tok, toxicity
from tonearm.llm._common import table

SF = "/root/testdata/sf0.001"
ODD = [(1, "plain words here to read"), (2, None), (3, ""), (4, "x" * 50_000), (5, "plain words here to read"), (5, "plain words here to read"), (None, "no id at all"), (7, " \n\t ")]


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", "s1", len(t or ""), 0.5, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def by_id(df):
    return {r[df.columns[0]]: r for r in df.collect()}


def test_toxicity(spark):
    more = SF.replace("0.001", "0.01")  # the smallest tables hold eleven toxic documents, too few to learn from
    d, y = table(spark, more, "documents"), table(spark, more, "labels")
    model = toxicity.fit(d, y)
    got = toxicity.score_documents(d, model).join(y, "doc_id").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() >= 0.6 * (got.toxic == 1).sum() and ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.03 * len(got)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    odd = toxicity.score_documents(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_documents(docs(spark, ODD), toxicity.fit(docs(spark, ODD), labels(spark))).where("score <> 0").count() == 0
    assert toxicity.keep_clean(docs(spark, []), model).count() == 0


def test_toxicity_tolerates_gaps():
    words = ["idiot", "idiots", "table", "chair", "window", "garden", "river"]
    model = toxicity.fit_words(words, np.array([30.0, 9, 3, 3, 3, 3, 3]), np.array([0.0, 0, 30, 30, 30, 30, 30]), 40, 300)
    clean = model.margins(["table", "garden"]).max()
    assert model.margins(["id.iot", "i-diot", "idi0t", "idxiot"]).min() > clean


def test_toxicity_tolerates_signs_between_all_letters():
    for insult in ("idiot", "moron", "stupid"):
        words = [insult, insult + "s", "table", "chair", "window", "garden", "river"]
        model = toxicity.fit_words(words, np.array([30.0, 9, 3, 3, 3, 3, 3]), np.array([0.0, 0, 30, 30, 30, 30, 30]), 40, 300)
        gapped = [f"{insult[:2]}.{insult[2]}.{insult[3:]}"] + [sign.join(insult) for sign in (".", "-", "..", "*_", ".....")]
        assert np.allclose(model.margins(gapped), model.margins([insult]))
        assert np.allclose(model.margins(["t.a.b.l.e", "g--a--r--d--e--n"]), model.margins(["table", "garden"]))


def plain_best_fit(rows, capacity):
    """Bins of (size, source, cluster), each put by a look at all bins."""
    bins, out = [], []
    for size, source, cluster in rows:
        fit = [k for k, b in enumerate(bins) if b["room"] >= size and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        k = min(fit, key=lambda k: (bins[k]["room"], k), default=len(bins))
        if k == len(bins):
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
        bins[k]["room"] -= size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_look_at_all_bins(seed):
    rng = np.random.default_rng(seed)
    rows = [(int(n), None if s == 0 else int(s), None if k == 0 else int(k)) for n, s, k in zip(rng.integers(1, 100, 400), rng.integers(0, 12, 400), rng.integers(0, 60, 400), strict=True)]
    for some in (rows, sorted(rows, key=lambda r: -r[0])):
        assert packing.best_fit(*map(list, zip(*some, strict=True)), 100) == plain_best_fit(some, 100)


def test_packing_does_not_depend_on_files(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 64)
    rows = [(i % 400, " ".join(["w"] * (i % 90)) + f" {i % 500}") for i in range(600)] + [(7, "the same row"), (7, "the same row"), (None, None), (9, "long " * 250), (9, "long " * 250)]
    df = docs(spark, rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 9))
    one, two = (sorted(map(str, packing.pack_documents(x, capacity=100).collect())) for x in (df.coalesce(1), df.repartition(7, F.rand(2))))
    assert one == two
    out = packing.pack_documents(df, capacity=100).toPandas()
    assert len({b.split("-")[0] for b in out.bin.dropna() if not b.startswith("full")}) > 3
    full = out[out.bin.fillna("").str.startswith("full")]
    assert (full.groupby("bin").tokens.agg(["sum", "count"]) == [100, 1]).all(axis=None) and len(full) >= 4


def test_packing(spark):
    rows = [(i, " ".join(["w"] * (i % 40)) + f" {i}") for i in range(300)] + ODD + [(1000, "a b " * 3000)]
    out = packing.pack_documents(docs(spark, rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5)), capacity=100).toPandas()
    assert out.tokens.sum() == sum(len((t or "").split()) for _, t in rows)
    packed = out[out.bin.notna()]
    for _, g in packed.groupby("bin"):
        assert g.tokens.sum() <= 100
        for col in ("source", "cluster"):
            seen = g[col].dropna()
            assert seen.is_unique
    assert (out[out.bin.isna()].tokens == 0).all()
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    got = packing.best_fit([60, 50, 40, 30, 10], ["a", "b", "a", "c", "d"], [None] * 5, 100)
    assert got == [0, 1, 1, 0, 0]  # 40 of a may not join 60 of a; 30 joins 60, the tighter of the two with room


def test_chat_branches_and_round_trip(spark):
    texts = ["</s>[INST] \\ <\\ [", "", None, "a\n\nb", "[/INST]<s>"]
    rows = [(1, 1, None, "user", texts[0], 0.0), (1, 2, 1, "assistant", texts[1], 1.0), (1, 3, 1, "assistant", texts[3], 5.0), (1, 4, 3, "us\ner", texts[4], 1.0), (2, 1, None, None, texts[2], 0.0), (2, 9, 77, "user", "root without parent", -1.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, 1, "assistant", "own tree", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_trees(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_mask")))
    got = {r.tree: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", texts[0]), ("assistant", texts[3]), ("us\ner", texts[4])]
    assert got[1].loss == texts[3] and got[None].loss == "own tree" and 3 not in got
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")]
    assert chat.format_trees(df, branches=2).where("tree = 1").count() == 2
    assert chat.format_trees(df.limit(0)).count() == 0


def test_sentencepiece(spark):
    got = sentencepiece_tok.encode_documents(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.n_ids == len(r.ids) for r in got)
    use = sentencepiece_tok.Codec(open(sentencepiece_tok.MODEL_PATH, "rb").read())
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    whole = sentencepiece_tok.encode_documents(table(spark, SF, "documents")).collect()
    assert len(whole) == len(texts)
    for r in whole:
        assert list(r.ids) == use.other.encode(texts[r.doc_id]) and r.exact == (use.other.decode(list(r.ids)) == texts[r.doc_id])
    assert {r.parity for r in whole} == {None, True}


def field(number, value):
    """A protobuf field: bytes, an int, or a float."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def unigram_model(fallback):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256 * fallback)]
    pieces += [("▁", -2.5, 1), ("▁the", -2.0, 1), ("▁cat", -3.5, 1), ("▁sat", -3.6, 1), ("s", -3.1, 1), ("at", -3.0, 1), ("unused", -1.0, 5)] + [(ch, -5.0 - k / 8, 1) for k, ch in enumerate("abcdehiotué")]
    trainer = field(3, 1) + field(4, len(pieces)) + field(35, int(fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1)
    return b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in pieces) + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))


@pytest.mark.parametrize("fallback", [True, False])
def test_sentencepiece_unigram_models(spark, tmp_path, fallback):
    data = unigram_model(fallback)
    use = sentencepiece_tok.Codec(data)
    texts = ["the cat sat", "  the   the ", "that hat", "écoute", "", "cats at the sea", "unused <s> the </s>", "日 the 本", "z"]
    for t, ids in zip(texts, use.encode(texts), strict=True):
        assert ids == use.other.encode(t), t
        if fallback:
            assert use.decode([ids])[0] == use.other.decode(ids), t
    if fallback:
        (tmp_path / "m.model").write_bytes(data)
        got = by_id(sentencepiece_tok.encode_documents(docs(spark, list(enumerate(texts))), str(tmp_path / "m.model")))
        assert [list(got[i].ids) for i in range(len(texts))] == [use.other.encode(t) for t in texts]


def test_sentencepiece_query_holds_every_row_against_the_library(spark):
    got = queries.op4_sentencepiece(spark, SF).collect()
    assert len(got) > sentencepiece_tok.CHECK_EVERY / 2 and all(r.parity is True for r in got)


def test_sentencepiece_tells_each_row_that_differs():
    use = sentencepiece_tok.Codec(open(sentencepiece_tok.MODEL_PATH, "rb").read())
    texts = ["one text", "", "two\nlines", "日本語 three"]
    ids = use.encode(texts)
    back = use.decode(ids)
    assert back == texts and use.parity(texts, ids, back) == [True] * 4 and use.parity([], [], []) == []
    assert use.parity(texts, ids[:2] + ids[:1] + ids[3:], back) == [True, True, False, True]
    assert use.parity(texts, ids, back[:3] + [""]) == [True, True, True, False]
    spelled = [[ids[0][0], *(use.tokenizer.token_to_id(f"<0x{b:02X}>") for b in "▁".encode()), ids[0][-1]]]  # a mark by bytes stays one
    assert use.decode(spelled) == use.other.decode(spelled) and "▁" in use.decode(spelled)[0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><header>Site</header><article><header><h1>Head &amp; line</h1></header><p><b>One <i>two</i>.<br><p>Three\n  four&nbsp;five</p><ul><li>six<li>seven</ul>
<aside>Side</aside><div class="comments"><p>First!</p></div><form><input>Go</form></article><div class=ad>Buy</div><footer>Foot</footer>"""


def test_html(spark):
    assert html_tree.main_text(PAGE) == "Head & line\nOne two.\nThree four five\nsix\nseven"
    shared = [(i, f"http://h.example/{i}", f"<body><div class='x1'>same everywhere</div><div class='story'>text number {i} of all</div></body>") for i in range(20)]
    rows = shared + [(100, None, None), (101, "odd", ""), (102, "http://one.example/", "<p>just a < b & c"), (102, "http://one.example/", "<p>just a < b & c"), (103, "http://q.example/", "<div a='x>unclosed" + "<b>" * 3000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = by_id(html_tree.extract(df))
    assert len(html_tree.extract(df).collect()) == len(rows)
    assert all(got[i].text == f"text number {i} of all" for i in range(20))  # the tree drops what every page repeats
    assert got[100].text == "" and got[101].n_chars == 0 and got[102].text == "just a < b & c"
    assert html_tree.extract(df.limit(0)).count() == 0


def extracted(spark, bodies):
    """Texts of pages of one host, by page."""
    rows = [(i, f"http://h.example/{i}", b) for i, b in enumerate(bodies)]
    got = by_id(html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    return [got[i].text for i in range(len(rows))]


def test_html_tree_judges_branches_inside_articles(spark):
    page = "<body><article><h1>Head {i}</h1><p>text number {i}</p><div class='x1'><p>Get our app</p><b>now</b></div></article></body>"
    assert extracted(spark, [page.format(i=i) for i in range(20)]) == [f"Head {i}\ntext number {i}" for i in range(20)]
    few = [page.format(i=i) for i in range(6)]
    assert all("Get our app" in t for t in extracted(spark, few))


def test_html_tree_keeps_important_children_and_copies(spark):
    bare = "<body>Skip to content<div class='c'>Share this<div class='story'>text number {i}</div></div></body>"
    assert extracted(spark, [bare.format(i=i) for i in range(20)]) == [f"text number {i}" for i in range(20)]
    # one page under many urls, with another advert each time
    copies = ["<body><div class='story'>the only text</div><div class='ad'>%s</div></body>" % ("buy " * i) for i in range(20)]
    assert set(extracted(spark, copies)) == {"the only text"}
    copied = ["<article><p>the only text</p></article>"] * 20
    assert set(extracted(spark, copied)) == {"the only text"}


def plain_importances(rows):
    """Of each (host, path): pages, and the mean of content and presentation importance, straight from their definitions."""
    seen = {}
    for url, text in rows:
        blocks = html_tree.blocks(text or "")
        kept = [b for b in blocks if not b[1]]
        main = [b for b in kept if b[2]] or kept
        page = tuple((b[0], b[3]) for b in main)
        host = seen.setdefault((re.match(r"\w+://([^/]+)", url or "") or ["", ""])[1], {})
        texts, children = {}, {}
        for path, _, _, words in kept:
            texts.setdefault(path, []).append(words)
        for path, _, _, _ in kept:
            parts = path.split("/")[1:]
            for k in range(len(parts)):
                up = "".join("/" + x for x in parts[:k])
                if up in texts and children.setdefault(up, [""])[-1] != parts[k]:
                    children[up].append(parts[k])
        host[page] = {p: (tuple(x), tuple(children.get(p, ()))) for p, x in texts.items()}
    out = {}
    for host, pages in seen.items():
        for path in {p for x in pages.values() for p in x}:
            shown = [x[path] for x in pages.values() if path in x]
            m = len(shown)
            if m > 1:
                entropy = lambda xs: -sum(k / m * math.log(k / m, m) for k in Counter(xs).values())  # noqa: E731, B023
                content, presentation = entropy([x for x, _ in shown]), entropy([y for _, y in shown])
                out[host, path] = (m, (content + presentation) / 2 if any(y for _, y in shown) else content)
    return out


def test_html_tree_equals_plain_entropies(spark):
    rows = [(r.url, r.html) for r in table(spark, SF.replace("0.001", "0.01"), "pages").collect()]
    box = "<body>menu<div class='box'>words {a}{b}</div><div class='story'>text {c}<p>{d}</p></div><div class='x1'>same</div></body>"
    rows += [(f"http://mixed.example/{i}", box.format(a=i % 3, b="<p>x</p>" * (i % 4) + "<ul><li>y</ul>" * (i % 2), c=i % 7, d=i)) for i in range(23)] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {(r.host, r.path): r for r in html_tree.importances(df).collect()}
    want = plain_importances(rows)
    assert set(got) == set(want) and ("mixed.example", "/body/div.box") in want
    for key, (m, importance) in want.items():
        assert got[key].m == m and abs(got[key].importance - importance) < 1e-9
        held = ((m - 1) * importance + html_tree.PRIOR * html_tree.PRIOR_PAGES) / (m - 1 + html_tree.PRIOR_PAGES)
        assert abs(got[key].weighed - held * (html_tree.MAIN_WEIGHT if got[key].main else 1)) < 1e-9


def test_html_names_are_no_veto(spark):
    assert html_tree.main_text("<article><p class='social'>Prose of the story</p><div class='banner-story'>More</div><div class='form-guide'>Still more</div></article>") == "Prose of the story\nMore\nStill more"
    assert html_tree.main_text("<article><p>Prose</p><p class='ad'>Buy</p><div class='story-banner'>Buy</div><div class='comment-body'>First!</div></article>") == "Prose"


def test_html_tree_takes_the_trunk(spark):
    page = "<body><div class='k1'><a href='/{i}'>go {i}</a></div><div class='k2'>word{i} of{i}</div><h1>Story {i}</h1><div class='k3'><p>{text}</p><div>end {i}</div></div><div class='k4'>{more}</div><p class='k5'>small{i}</p></body>"
    texts = [f"text number {i} " * 20 for i in range(12)]
    pages = [page.format(i=i, text=t, more="") for i, t in enumerate(texts)]
    assert extracted(spark, pages) == [f"Story {i}\n{t.strip()}\nend {i}" for i, t in enumerate(texts)]
    # what is long enough beside the trunk stays
    pages = [page.format(i=i, text=t, more=t[:120]) for i, t in enumerate(texts)]
    assert extracted(spark, pages) == [f"Story {i}\n{t.strip()}\nend {i}\n{t[:120].strip()}" for i, t in enumerate(texts)]
    # also beside an article; a page without the trunk falls back on its own text, and so does one whose article lies elsewhere
    page = "<body><div class='k2'>word{i}</div><article><p>{text}</p></article><div class='k4'>{more}</div></body>"
    pages = [page.format(i=i, text=t, more=t[:120]) for i, t in enumerate(texts)] + ["<body><div class='k2'>only this</div></body>", "<body><div class='k2'>bits</div><main><p>all of it</p></main></body>"]
    assert extracted(spark, pages) == [f"{t.strip()}\n{t[:120].strip()}" for t in texts] + ["only this", "all of it"]


def test_html_tree_without_names_nearly_equals_the_names(spark):
    df = table(spark, SF.replace("0.001", "0.01"), "pages")
    named, got = {r.page_id: html_tree.main_text(r.html) for r in df.collect()}, by_id(html_tree.extract(df, names=False))
    assert sum(got[i].text == t for i, t in named.items()) >= 0.95 * len(named)  # about four pages a host
    assert {i: r.text for i, r in by_id(html_tree.extract(df)).items()} == named


def plain_trunk(pages):
    """The trunk and its minor branches of one host, straight from their definitions; pages are lists of (path, text)."""
    held, seen, inner = Counter(), Counter(), set()
    for page in pages:
        for path in {"/".join(b[0].split("/")[: i + 1]) for b in page for i in range(b[0].count("/") + 1)}:
            inside = [t for p, t in page if p == path or p.startswith(path + "/")]
            held[path] += sum(map(len, inside))
            seen[path] += 1
            if any(p.startswith(path + "/") for p, _ in page):
                inner.add(path)
    trunk = max((p for p in inner if seen[p] > 1 and held[p] >= html_tree.TRUNK * held[""]), key=len)
    beside = {p for p in held if seen[p] > 1 and p and (trunk + "/").startswith(p.rpartition("/")[0] + "/") and p.rpartition("/")[0] != trunk and not (trunk + "/").startswith(p + "/")}
    return trunk, {p for p in beside if held[p] < html_tree.MINOR * held[trunk]}


def test_html_tree_equals_plain_trunks(spark):
    page = "<body><div class='a'>{x}</div><div class='box'><div class='b'>{y}</div><div class='c'><div>{z}</div><p>end {i}</p></div></div></body>"
    bodies = [page.format(i=i, x="ab" * (i % 3), y="cd" * (i % 7 * 9 + 1), z=f"words {i} " * (i % 5 * 9 + 1)) for i in range(25)]
    tree = html_tree.site_tree(spark.createDataFrame([("http://h.example/", b) for b in bodies], "url string, html string")).first()
    trunk, minor = plain_trunk([[(p, t) for p, _, _, t in html_tree.blocks(b)] for b in bodies])
    assert (tree.trunk, set(tree.minor)) == (trunk, minor) and trunk == "/body/div.box/div.c" and minor == {"/body/div.a"}


def test_html_of_very_long_pages():
    assert html_tree.main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("word") == 50_000
    assert html_tree.main_text("<div>" * 20_000 + "deep") == "deep"


def test_html_tree_takes_the_mean_of_both_entropies(spark):
    def page(i, children):
        return f"<body><div class='box'>same words{children}</div><div class='story'>text number {i}</div></body>"

    varied = [page(i, "".join(f"<div class='k{int(d)}'>word {i}</div>" for d in f"{i:05b}")) for i in range(20)]
    assert all("same words" in t for t in extracted(spark, varied))
    fixed = [page(i, f"<div class='k0'>word {i}</div>") for i in range(20)]
    assert not any("same words" in t for t in extracted(spark, fixed))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def ok(kind, m):
        digits = [int(x) for x in m if x.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_pii(spark):
    texts = ["a@b.c_d@e.f mail x@y", "1.2.3.4.5 and 300.1.1.1 001.02.3.255", "4111 1111-1111 1111 and 4111111111111112 0000 0000 0000 00", "call +1 (555) 123-4567. or +12345", "é😀 me@x.org 😀 10.0.0.1", "1" * 40_000, "a" * 40_000 + "@", "1 " * 20_000, "+" * 1000 + "1-2", "", None, "IBAN GB82 WEST 1234 5698 7654 32 ssn 078-05-1120", "x.@-.-.@a..b@c.d"]
    real = [r.text for r in table(spark, SF, "documents").collect()]
    rows = list(enumerate(texts + real))
    found = pii.find(docs(spark, rows))
    for r in found.collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.finish}" for s in r.pii if s.kind in BASE)
        assert got == plain_spans(rows[r.doc_id][1] or ""), rows[r.doc_id][1][:80]
    kinds = {s.kind for r in found.where("doc_id = 11").collect() for s in r.pii}
    assert {"iban", "ssn"} <= kinds
    masked = by_id(pii.mask(docs(spark, rows)))
    assert masked[4].text == "é😀 <email> 😀 <ip>" and masked[4].n_chars == len(masked[4].text) and masked[10].text is None
    assert pii.mask(docs(spark, [])).count() == 0


def test_pii_of_a_list_of_addresses(spark):
    """Many valid matches in one text, over several levels of the running sums; the masked text is put together in their order."""
    n = pii.CHUNK * pii.CHUNK + 3 * pii.CHUNK + 5
    text = " ".join(f"é{i} a{i}@b.org 😀 1.2.3.{i % 256}" if i % 5 else f"a{i}@b.org" for i in range(n))
    short = [" ".join(f"x{i}@y.zz" for i in range(k)) for k in (1, pii.CHUNK - 1, pii.CHUNK, pii.CHUNK + 1)]
    rows = list(enumerate([text, *short, "x" * 3000 + "1.2.3.4@5.6.7.8", "b@" + "c" * 3000 + ".d 1.2.3.4"]))
    found = by_id(pii.find(docs(spark, rows)))
    masked = by_id(pii.mask(docs(spark, rows)))
    for i, t in rows:
        assert ",".join(f"{s.kind}:{s.start}:{s.finish}" for s in found[i].pii if s.kind in BASE) == plain_spans(t)
        at, out = 0, []
        for s in found[i].pii:
            if s.start >= at:
                out += [t[at : s.start], f"<{s.kind}>"]
            at = max(at, s.finish)
        assert masked[i].text == "".join(out) + t[at:] and masked[i].n_chars == len(masked[i].text)


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + [(10_000 + k, t) for k, (_, t) in enumerate(ODD)] + [(20_000, "a b c d e f g h " * 9 + "z"), (20_001, "é #  x\n\nl\nl\n l\n")]
    got = by_id(quality.judge(docs(spark, rows), table(spark, SF, "labels")))
    for i, t in rows:
        want = plain_quality(t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert quality.judge(docs(spark, []), labels(spark)).count() == 0
    assert quality.keep_good(docs(spark, ODD), labels(spark)).count() == 0


def test_quality_cutoffs_are_certified():
    assert abs(quality.tail(0, 10, 0.1) - 0.9**10) < 1e-12
    assert abs(quality.tail(2, 20, 0.3) - sum(math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(3))) < 1e-12
    assert quality.certified([0, 0, 3, 500], 2000, 0.01) == 2
    assert quality.certified([0], 50, 0.01) is None


def plain_lz(text):
    seen, ends, start = set(), [], 0
    while start < len(text):
        end = start + 1
        while end < len(text) and text[start:end] in seen:
            end += 1
        seen.add(text[start:end])
        ends.append(end)
        start = end
    return ends


def test_lz(spark):
    real = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    for _, t in [*real[:60], (0, "a" * 999), (0, "ab" * 500)]:
        assert lz_fingerprint.parse(t) == plain_lz(t)
    rows = [(i, t) for i, t in real] + [(9_000, None), (9_001, ""), (9_002, "😀é")]
    got = by_id(lz_fingerprint.compare_with_edit_and_next(docs(spark, rows)))
    order = sorted(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        new = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        f, g = lz_fingerprint.fingerprint(t), lz_fingerprint.fingerprint(new)
        assert r.fingerprint == lz_fingerprint.to_hex(f) and r.edited_fingerprint == lz_fingerprint.to_hex(g)
        assert r.near_edited == lz_fingerprint.likeness(f, g) and r.near_next == lz_fingerprint.likeness(f, lz_fingerprint.fingerprint(nxt))
    assert lz_fingerprint.compare_with_edit_and_next(docs(spark, ODD)).count() == len(ODD)
    assert lz_fingerprint.compare_with_edit_and_next(docs(spark, [])).count() == 0


def test_minhash(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = [(k, base.replace(f" w{7 * k} ", f" v{k} ")) for k in range(1, 20)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = near + [(100 + k, passage + " " + " ".join(f"q{k}_{i}" for i in range(40))) for k in range(30)] + [(300, base.upper()), (301, "two words"), (302, "TWO words"), (303, None), (304, ""), (None, "lone text of several words"), (305, base), (305, base)]
    got = minhash.near_duplicates(docs(spark, rows), words=4).collect()
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a is not None and b is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == comp[r.doc_id]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_ctw(spark):
    d = table(spark, SF, "documents")
    got = by_id(ctw.score_documents(d))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w, r = words(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * len(w)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > -0.301 * 8 * sum(len(t.encode()) for i, t in rows if got[i].held_out) / 2  # under 4 bits a byte
    assert ctw.score_documents(docs(spark, ODD)).count() == len(ODD)
    assert ctw.score_documents(docs(spark, [])).count() == 0


def test_ctw_bits_are_a_distribution():
    texts = [b"abracadabra", b"abba", b"cab"]
    levels = []
    code = ctw.runs(texts, ctw.DEPTH).astype(np.int64)
    for d in range(ctw.DEPTH + 1):
        levels.append(np.unique(code & ((1 << 8 * (d + 1)) - 1), return_counts=True))
    tree = ctw.Tree(levels)
    for context in (b"\0\0\0\0", b"dabr", b"zzzz"):
        high = int.from_bytes(context[-ctw.DEPTH :], "big") << 8
        assert abs(sum(10 ** tree.bits(np.arange(256) + high)) - 1) < 1e-6


def test_ctw_splits_hot_contexts(spark):
    """A context with a third of all runs is dealt in shares of at most 2**16 runs; what numpy and Spark deal by is the same."""
    low = ((np.arange(30_000) % 200 + 1) << 32 | (np.arange(30_000) // 200 + 1) << 24 | 0x6572 << 8 | 65).tolist()
    rest = [(i * 2654435761 % (1 << 40), 1) for i in range(60_000)]
    counted = spark.createDataFrame([(r, 1) for r in low] + rest, "run long, n long")
    how = ctw.deal(counted)
    assert 0x6572 in how.hot and len(how.hot) <= ctw.SPLIT
    rows = counted.select("run", how.column().alias("key")).toPandas()
    assert (how.keys(rows["run"].to_numpy()) == rows["key"].to_numpy()).all()
    assert rows["key"].value_counts().max() < 400


def test_ctw_scores_with_all_contexts(spark, monkeypatch):
    """However few runs are broadcast and whichever contexts are split, scores are those of the one tree of all contexts."""
    d = table(spark, SF, "documents").limit(60).union(table(spark, SF, "documents").where("doc_id is null")).select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "")[:3000]) for r in d.collect()] + [(900_000, "only \u4e2d here \x7f"), (900_001, None)]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode() for _, t in rows]
    train = [t for (i, _), t in zip(rows, low, strict=True) if zlib.crc32(str(i).encode()) % 5 != 1]
    code = ctw.runs(train, ctw.DEPTH).astype(np.int64)
    tree = ctw.Tree([np.unique(code & ((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ctw.DEPTH + 1)])
    want = {i: tree.bits(ctw.runs([t], ctw.DEPTH).astype(np.int64)).sum() for (i, _), t in zip(rows, low, strict=True)}
    given = docs(spark, rows)
    for most, split in ((8, 0), (8, 60), (1 << 20, 1 << 30)):  # no context, some and all are dealt by one byte more
        monkeypatch.setattr(ctw, "MAX_RUNS", most)
        monkeypatch.setattr(ctw, "SPLIT", split)
        for r in ctw.score_documents(given).collect():
            n = len(low[[i for i, _ in rows].index(r.doc_id)]) + 1
            assert abs(r.score - want[r.doc_id]) < 1e-6 * n
            assert abs(r.bits_per_byte + want[r.doc_id] / math.log10(2) / n) < 1e-6


@pytest.mark.parametrize("kind", ["real", "odd", "empty"])
def test_pipeline_stages(spark, kind):
    rows = {"real": None, "odd": ODD, "empty": []}[kind]
    d = table(spark, SF, "documents") if rows is None else docs(spark, rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        new = corpus_pipeline.materialise(stage(spark, d, SF))
        if k < 4:
            assert new.columns == d.columns
        if name == "near_duplicates":
            kept = minhash.near_duplicates(d).where("kept").select("doc_id").distinct()
            assert new.count() == d.where("doc_id is null").count() + d.join(kept, "doc_id").count()
        if name == "pii":
            assert new.count() == d.count() and pii.find(new).where("size(pii) > 0").count() <= pii.find(d).where("size(pii) > 0").count()
        d = new
    assert kind != "real" or d.count() > 50
