"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (pieces, scores, kinds, normaliser settings) and rebuilt as a tokenizers pipeline: the
normaliser (precompiled map, blank handling), the metaspace marker, the unigram scores or, for a merge model, the merges
that the scores imply, and byte fallback.  Batches are encoded by the library's own threads.  Before a job starts, the driver
holds the model against the sentencepiece library on a set of probe texts and refuses it if they differ; each task does so on
its own rows, all of them or a share, and reports what it finds in a column.  Every text is decoded again.  Control and unused pieces match no text; user-defined pieces and the names
of byte pieces are matched like ordinary ones, which the sentencepiece library does not do.

Defined results: null text is the empty text, with no ids; rows pass one by one, so repeated and null ids need no care;
extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from tonearm.llm import _common as c

MARK = "▁"
#: Default place of a public model; every function takes another.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Unless a caller says otherwise, the first row of a slice and every CHECK_EVERY-th one are held against the sentencepiece library.
CHECK_EVERY = 200
#: Kinds of pieces, as the model file numbers them.
CONTROL, UNUSED, BYTE = 3, 5, 6
#: The byte in the middle of a mark, as its piece is named.
MARK_BYTE = f"<0x{MARK.encode()[1]:02X}>"
PROBES = ["", " ", "Hello world", "  two  blanks ", "line\nbreak\tand tab", "naïve café", "日本語 text", "🙂 emoji", "a" * 300, "▁ marked", "x  y   z", " nbsp", "Ünïcödé ́"]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = 1  # 1 unigram, 2 merges
    unk: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_blanks: bool = True


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message; 32- and 64-bit values come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            value: int | bytes = varint()
        else:
            n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    """Field numbers are those of the public sentencepiece_model.proto."""
    m = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, 1
            for k, v in fields(value):
                if k == 1:
                    text = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for k, v in fields(value):
                if k == 3:
                    m.kind = v
                elif k == 35:
                    m.byte_fallback = bool(v)
                elif k == 40:
                    m.unk = v
        elif number == 3:
            for k, v in fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.dummy_prefix = bool(v)
                elif k == 4:
                    m.fold_blanks = bool(v)
    return m


def _blanks_in_front(m: Model) -> int:
    """How many blanks decoding takes away in front: all of them where blanks are folded."""
    return 2**30 if m.fold_blanks else int(m.dummy_prefix)


def _decoder(m: Model, at_once: bool = False) -> decoders.Decoder:
    """at_once: marks become blanks in the whole text and not piece by piece, which is faster, but blanks a mark that bytes spell too."""
    blanks, rest = decoders.Replace(MARK, " "), [decoders.ByteFallback(), decoders.Fuse()]
    front = _blanks_in_front(m)
    return decoders.Sequence(([*rest, blanks] if at_once else [blanks, *rest]) + ([decoders.Strip(" ", front, 0)] if front else []))


def build(m: Model) -> Tokenizer:
    ids = {text: i for i, (text, _, _) in enumerate(m.pieces)}
    if m.kind == 1:
        # an id needs a place in the list even if no text may give it
        core = models.Unigram([(f"\U0010ffff{i}" if kind in (CONTROL, UNUSED) else t, s) for i, (t, s, kind) in enumerate(m.pieces)], unk_id=m.unk, byte_fallback=m.byte_fallback)
    else:
        # a merge model joins the pair whose piece scores best
        usable = {t: s for t, s, kind in m.pieces if kind in (1, 4)}
        merges = [(-s, ids[t], t[:k], t[k:]) for t, s in usable.items() for k in range(1, len(t)) if t[:k] in usable and t[k:] in usable]
        merges.sort()
        core = models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    out = Tokenizer(core)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.fold_blanks:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Replace(Regex(r"\A(?=[\s\S])"), " "))
    steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    # no piece holds a mark behind another character, so texts may be cut before each run of marks
    if not any(MARK in t.lstrip(MARK) for t, _, kind in m.pieces if kind in (1, 4)):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    out.decoder = _decoder(m)
    return out


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, data: bytes):
        model = parse(data)
        self.tokenizer = build(model)
        self.at_once = Tokenizer(self.tokenizer.model)
        self.at_once.decoder = _decoder(model, at_once=True)
        self.mark_byte = next((i for i, (t, _, kind) in enumerate(model.pieces) if kind == BYTE and t == MARK_BYTE), None)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        out = self.at_once.decode_batch(ids, skip_special_tokens=False)
        if self.mark_byte is not None:
            for k, x in enumerate(ids):
                if self.mark_byte in x:
                    out[k] = self.tokenizer.decode(x, skip_special_tokens=False)
        return out

    def parity(self, texts: list[str], ids: list[list[int]], back: list[str], threads: int = 1) -> list[bool]:
        """Whether the sentencepiece library gives the same ids for each text and the same text back for the ids."""
        if not texts:
            return []
        theirs = zip(self.other.encode(texts, num_threads=threads), self.other.decode(ids, num_threads=threads), strict=True)
        return [pair == (x, y) for pair, x, y in zip(theirs, ids, back, strict=True)]

    def verify(self, texts: list[str]) -> None:
        ids = self.encode(texts)
        for text, good in zip(texts, self.parity(texts, ids, self.decode(ids)), strict=True):
            if not good:
                raise ValueError(f"the model does not agree with the sentencepiece library on {text[:80]!r}")


_CODECS: dict[bytes, Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    if data not in _CODECS:
        _CODECS.clear()
        _CODECS[data] = Codec(data)
    return _CODECS[data]


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, threads: int | None = None, id_col: str = "doc_id", text_col: str = "text", check_every: int = CHECK_EVERY) -> DataFrame:
    """(id, ids, n_ids, exact, parity): ids of each whole text; exact tells whether decoding them gives the text back.

    parity tells of the rows that were held against the sentencepiece library whether it agrees; it is null for the others, of
    which there are none if check_every is 1.
    The driver reads the model file (under 1 MB) and sends it to the tasks; threads is spark.task.cpus, the cores that a task
    owns, if not given: more threads than cores only wait for each other.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    Codec(data).verify(PROBES)
    spark = docs.sparkSession
    data_sent = spark.sparkContext.broadcast(data)
    threads = threads or int(spark.sparkContext.getConf().get("spark.task.cpus", "1"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("exact", T.BooleanType()), T.StructField("parity", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(data_sent.value, threads)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in c.slices(texts, 1_000_000):
                ids = use.encode(texts[a:b])
                back = use.decode(ids)
                exact = [x == y for x, y in zip(back, texts[a:b], strict=True)]
                parity: list[bool | None] = [None] * (b - a)
                parity[::check_every] = use.parity(texts[a:b:check_every], ids[::check_every], back[::check_every], threads)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(exact), pa.array(parity, pa.bool_())], schema.names)

    return c.in_small_batches(docs.select(id_col, F.col(text_col).cast("string").alias(f"__{text_col}")), run, schema)
