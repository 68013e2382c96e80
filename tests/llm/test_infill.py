import hashlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tonearm.llm import infill
from tonearm.llm._common import table

SF = "/root/testdata/sf0.001"


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slicing the text."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    text = text or ""
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.text(st.sampled_from("<PSM> aé漢𝄞\n"), max_size=60), st.integers(1, 9))
def test_frames_equal_slices(doc_id, text, units):
    frames = infill.Frames(units)
    n, form, prefix, middle, out = infill.rewrite(doc_id, text, frames)
    joined = b"".join(frames.stream(out)).decode()
    assert (n, form, prefix, middle, joined) == plain(doc_id, text)
    assert b"".join(infill.restore(form, out, frames)).decode() == text
    assert [u for u, _ in out] == sorted(u for u, _ in out) and (out[-1][0] if out else 0) == len(joined)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aé漢𝄞"), max_size=80), st.integers(1, 9), st.data())
def test_selections_equal_slices_and_keep_whole_frames(text, units, data):
    frames = infill.Frames(units)
    stored = frames.store(text)
    start = data.draw(st.integers(0, len(text)))
    end = data.draw(st.integers(start, len(text)))
    part = frames.select(stored, start, end)
    assert b"".join(frames.stream(part)).decode() == text[start:end]
    inner = [d for (u, d), below in zip(stored, [0, *(u for u, _ in stored)]) if start <= below and u <= end]
    assert [d for _, d in part if d in inner] == inner


def test_only_cut_frames_are_decompressed(monkeypatch):
    frames, opened = infill.Frames(10), []
    stored = frames.store("x" * 1000)
    read = infill.Frames.data
    monkeypatch.setattr(infill.Frames, "data", lambda self, f: opened.append(f[0]) or read(self, f))
    frames.select(stored, 105, 907)
    assert opened == [110, 910]


def test_outputs_are_valid_streams():
    frames = infill.Frames(7)
    _, _, _, _, out = infill.rewrite(3, "many words here " * 9, frames)
    whole = b"".join(d for _, d in out)
    got = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(whole)
    assert got.decode() == plain(3, "many words here " * 9)[4]


ODD = [(1, "plain words"), (2, None), (3, ""), (4, "ab" * 60_000), (5, "twice"), (5, "twice"), (None, "no id at all"), (7, "has <S> inside"), (8, "ends in <"), (9, "<" * 50), (10, "é漢𝄞" * 5000)]


@pytest.mark.parametrize("units", [3000, infill.FRAME_UNITS])
def test_odd_rows(spark, units):
    full = [(i, t, "en", 0, "x", b"y") for i, t in ODD]
    df = spark.createDataFrame(full, "doc_id long, text string, form string, n long, output string, middle_chars binary")
    got = sorted(map(tuple, infill.digests(infill.transform(df, frame_units=units)).collect()), key=str)
    want = [(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in ODD]
    assert got == sorted(want, key=str)
    assert infill.digests(infill.transform(df.limit(0))).count() == 0


def test_texts_come_back(spark):
    docs = table(spark, SF, "documents")
    rows = infill.texts(infill.transform(docs)).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(r.restored_text == (r.text or "") and r.output_text == plain(r.doc_id, r.text)[4] for r in rows)


def test_ids_need_not_be_numbers(spark):
    df = spark.createDataFrame([("a", "some text here")], "doc_id string, text string")
    assert infill.texts(infill.transform(df)).first()["output_text"] == plain("a", "some text here")[4]
