"""Fill-in-the-middle rewriting over seekable compressed text: independent zstandard frames with cumulative unit counts.

A text is stored as frames of at most FRAME_UNITS code points, each compressed on its own, with the count of units up to
its end.  Two cuts drawn from the id's hash part a text into prefix, middle and suffix.  A binary search on the counts
finds the frames that hold a cut; only these are decompressed and cut, all others move to their new place as they are.  The
result is again such a list of frames: joined, they are one valid zstandard stream of the output text.  Digests and the
way back to the text stream over the frames in order, one decompressed frame at a time.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text itself.  A text with a
marker in it stays plain, so the first marker of each kind in an output is the one put there, and the text comes back
from output and form alone (a marker starts with the only < it has, so none can arise across a cut).

Defined results: null text is the empty text; an empty text is plain; a null id draws as the empty id does; repeated rows each
get the same result; bytes that are not UTF-8 count as one unit each and come back unchanged; columns of the input
other than id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import _common as c

#: Units (code points) of a frame at most: what a cut decompresses.
FRAME_UNITS = 8192
LEVEL = 1
SEED = 1
PLAIN_PERCENT, SPM_PERCENT = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Order of the parts after the first marker, by form.
LAYOUT = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

FRAMES = "array<struct<units:bigint,data:binary>>"
_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("data", pa.binary())]))

Frame = tuple[int, bytes]  # units up to the frame's end, compressed UTF-8


class Frames:
    """Makes and reads lists of frames; one for each task, as it keeps its compressor."""

    def __init__(self, frame_units: int = FRAME_UNITS):
        self.most = frame_units
        self._pack, self._unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def _bytes(self, text: str) -> bytes:
        return text.encode("utf-8", "surrogateescape")

    def data(self, frame: Frame) -> bytes:
        return self._unpack.decompress(frame[1])

    def store(self, text: str) -> list[Frame]:
        ends = [*range(self.most, len(text), self.most), len(text)] if text else []
        return [(e, self._pack.compress(self._bytes(text[s:e]))) for s, e in zip([0, *ends], ends, strict=False)]

    def select(self, frames: list[Frame], start: int, end: int) -> list[Frame]:
        """The units start..end, counted anew: inner frames as they are, cut frames decompressed and cut."""
        out, done = [], 0
        k = bisect_left(frames, start + 1, key=lambda f: f[0])
        while start < end:
            below = frames[k - 1][0] if k else 0
            stop = min(end, frames[k][0])
            data = frames[k][1]
            if (start, stop) != (below, frames[k][0]):
                text = self.data(frames[k]).decode("utf-8", "surrogateescape")
                data = self._pack.compress(self._bytes(text[start - below : stop - below]))
            done += stop - start
            out.append((done, data))
            start, k = stop, k + 1
        return out

    def joined(self, *parts: list[Frame]) -> list[Frame]:
        out, before = [], 0
        for part in parts:
            out += [(before + units, data) for units, data in part]
            before = out[-1][0] if out else 0
        return out

    def stream(self, frames: list[Frame]) -> Iterator[bytes]:
        return (self.data(f) for f in frames)

    def find(self, frames: list[Frame], marker: str, after: int = 0) -> int:
        """The byte where the marker stands first, from `after` on; -1 if nowhere.  It may lie across frames."""
        mark, tail, at = marker.encode(), b"", 0
        for data in self.stream(frames):
            seen = tail + data
            hit = seen.find(mark, max(0, after - (at - len(tail))))
            if hit >= 0:
                return at - len(tail) + hit
            at += len(data)
            tail = seen[-(len(mark) - 1) :]
        return -1

    def span(self, frames: list[Frame], start: int, end: int | None = None) -> Iterator[bytes]:
        """The bytes start..end, frame by frame."""
        at = 0
        for data in self.stream(frames):
            if end is not None and at >= end:
                return
            if at + len(data) > start:
                yield data[max(0, start - at) : None if end is None else end - at]
            at += len(data)


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """The first four groups of eight hex digits of the hash of seed and id, as numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rewrite(doc_id: object, text: str, frames: Frames) -> tuple[int, str, int | None, int | None, list[Frame]]:
    """(units, form, units of the prefix, of the middle, frames of the output) of one text."""
    n, stored = len(text), frames.store(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_PERCENT:
        return n, "plain", None, None, stored
    form = "spm" if h4 % 100 < SPM_PERCENT else "psm"
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    part = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, n)}
    pieces = [x for m in LAYOUT[form] for x in (frames.store(m), frames.select(stored, *part[m]))]
    return n, form, low, high - low, frames.joined(*pieces)


def restore(form: str, output: list[Frame], frames: Frames) -> Iterator[bytes]:
    """The bytes of the original text, streamed from output and form."""
    if form == "plain":
        yield from frames.stream(output)
        return
    at, bounds = 0, {}
    for m, following in zip(LAYOUT[form], (*LAYOUT[form][1:], None), strict=True):
        start = at + len(m)
        at = frames.find(output, following, start) if following else None
        bounds[m] = (start, at)
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from frames.span(output, *bounds[m])


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_units: int = FRAME_UNITS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; output is a list of frames.  No shuffle."""
    ids = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("__drawn"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(frame_units)
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), c.utf8(batch.column(2))
            for start, end in c.slices(texts, 4_000_000):
                rows = [rewrite(k, _text(t), frames) for k, t in zip(keys[start:end], texts[start:end], strict=True)]
                n, form, prefix, middle, out = zip(*rows, strict=True)
                out = pa.array([[{"units": u, "data": d} for u, d in x] for x in out], _FRAMES)
                whole = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], whole[0], pa.array(form, pa.string()), *whole[1:], out], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return c.in_small_batches(ids, run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output {FRAMES}")


def _over_output(rewritten: DataFrame, new: str, kind: pa.DataType, sql: str, make: Callable[[Frames, str, list[Frame]], list]) -> DataFrame:
    """rewritten without its output, with columns worked out from form and output of each row."""
    kept = [x for x in rewritten.columns if x != "output"]
    names = new.split(",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames()
        for batch in batches:
            forms, outputs = batch.column("form").to_pylist(), batch.column("output")
            rows = [make(frames, f, [(x["units"], x["data"]) for x in outputs[k].as_py() or ()]) for k, f in enumerate(forms)]
            made = [pa.array([r[j] for r in rows], kind) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in kept] + made, kept + names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rewritten.schema if f.name in kept]
    return c.in_small_batches(rewritten, run, ", ".join(fields + [f"{x} {sql}" for x in names]))


def digests(rewritten: DataFrame) -> DataFrame:
    """What transform() gave, with output_sha256 and restored_sha256 in place of the output: hashed frame by frame."""

    def made(frames: Frames, form: str, output: list[Frame]) -> list[str]:
        found = []
        for parts in (frames.stream(output), restore(form, output, frames)):
            h = hashlib.sha256()
            for data in parts:
                h.update(data)
            found.append(h.hexdigest())
        return found

    return _over_output(rewritten, "output_sha256,restored_sha256", pa.string(), "string", made)


def texts(rewritten: DataFrame) -> DataFrame:
    """What transform() gave, with the columns output_text and restored_text in place of the frames."""

    def made(frames: Frames, form: str, output: list[Frame]) -> list[str]:
        return [b"".join(p).decode("utf-8", "replace") for p in (frames.stream(output), restore(form, output, frames))]

    return _over_output(rewritten, "output_text,restored_text", pa.string(), "string", made)
