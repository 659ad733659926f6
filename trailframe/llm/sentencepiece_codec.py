"""Operator 4: SentencePiece models on the tokenizers library.

The model file (a protobuf message) is read field by field; from it the
normaliser, the metaspace marker, the merges (BPE) or the log
probabilities (unigram) and the byte fallback are rebuilt as a tokenizers
pipeline, which encodes batches on several threads and decodes.

For models whose pieces never hold the marker after another character, no
piece crosses a word start, so texts are cut at single spaces and every
worker keeps the ids of words it has met; each new word is encoded by the
rebuilt pipeline and by the sentencepiece library and decoded again, and a
document's ``parity`` and ``round_trip`` say whether that held for all its
words (both steps work word by word, so it then holds for the text).  Other
models, and texts with runs of spaces, are handled whole.

Cases: null and empty texts have no ids and decode to the empty string; a
null ``doc_id`` stays null; repeated rows are encoded each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.segments import slices

MARK = "▁"
#: piece kinds of the model format (fixed values)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: model kinds of the model format (fixed values)
UNIGRAM, BPE, WORD, CHAR = 1, 2, 3, 4
MAX_WORDS = 500_000


def _fields(buf: bytes):
    """``(number, value)`` of a protobuf message: int, bytes or raw 4/8 bytes."""
    i, n = 0, len(buf)

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, buf[i:i + size]
        i += size


def parse_model(buf: bytes) -> dict:
    """Pieces ``(text, score, kind)``, trainer and normaliser settings."""
    out = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "unk": 0, "charsmap": b"",
           "dummy_prefix": True, "collapse": True, "escape": True, "suffix": False}
    for number, value in _fields(buf):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out["pieces"].append((text, score, kind))
        elif number == 2:
            names = {3: "kind", 24: "suffix", 35: "byte_fallback", 40: "unk"}
            for k, v in _fields(value):
                if k in names:
                    out[names[k]] = bool(v) if names[k] in ("byte_fallback", "suffix") else v
        elif number == 3:
            names = {3: "dummy_prefix", 4: "collapse", 5: "escape"}
            for k, v in _fields(value):
                if k == 2:
                    out["charsmap"] = v
                elif k in names:
                    out[names[k]] = bool(v)
    return out


def merges_of(pieces: list) -> list[tuple[str, str]]:
    """BPE merges: every split of a piece into two pieces, best score first
    (ties as the pieces come)."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for i, (p, score, kind) in enumerate(pieces):
        if kind not in (NORMAL, USER, UNUSED):
            continue
        for k in range(1, len(p)):
            a, b = ids.get(p[:k]), ids.get(p[k:])
            if a is not None and b is not None:
                found.append((-score, i, a, b, p[:k], p[k:]))
    found.sort()
    return [(x[4], x[5]) for x in found]


def build(model: dict, whole: bool = True):
    """The tokenizers pipeline of a parsed model.  ``whole=False`` leaves out
    the normaliser: the input is then already normalised and marked."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unk = pieces[model["unk"]][0]
    if model["kind"] == BPE:
        tok = Tokenizer(models.BPE(vocab={p: i for i, (p, _, _) in enumerate(pieces)}, merges=merges_of(pieces),
                                   unk_token=unk, fuse_unk=True, byte_fallback=model["byte_fallback"]))
    elif model["kind"] == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unk_id=model["unk"],
                                       byte_fallback=model["byte_fallback"]))
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["collapse"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if whole and steps:
        tok.normalizer = normalizers.Sequence(steps)
    user = [AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER]
    if user:
        tok.add_tokens(user)
    last = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return tok


def word_wise(model: dict) -> bool:
    """Whether encoding may be cut before each run of markers: no piece has
    the marker after another character, nothing is normalised away."""
    return (not model["charsmap"] and not model["collapse"] and model["dummy_prefix"] and model["escape"]
            and not model["suffix"] and model["byte_fallback"]
            and not any(kind == USER for _, _, kind in model["pieces"])
            and not any(MARK in p.lstrip(MARK) for p, _, kind in model["pieces"] if kind == NORMAL))


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, buf: bytes, threads: int = 1, parity: bool = True):
        if threads > 1:
            os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.model = parse_model(buf)
        self.tok = build(self.model)
        self.by_word = word_wise(self.model)
        self.word_tok = build(self.model, whole=False) if self.by_word else None
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=buf) if parity else None
        self.threads = threads
        self.words: dict[str, tuple[bytes, bool, bool]] = {}

    def _judge(self, texts: list[str], marked: list[str] | None = None) -> list[tuple[bytes, bool, bool]]:
        """``(ids, parity, round trip)`` of texts, or of their marked words."""
        if not texts:
            return []
        tok = self.tok if marked is None else self.word_tok
        got = [e.ids for e in tok.encode_batch_fast(texts if marked is None else marked, add_special_tokens=False)]
        back = self.tok.decode_batch(got, skip_special_tokens=False)
        same = [True] * len(got)
        if self.sp is not None:
            same = [a == b for a, b in zip(got, self.sp.encode(texts, num_threads=self.threads))]
        want = texts if self.tok.normalizer is None or marked is not None else map(self.normalized, texts)
        return [(np.asarray(g, dtype="<u4").tobytes(), p, d == w) for g, p, d, w in zip(got, same, back, want)]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """``(ids as little-endian 32-bit, parity, round trip)`` of each text."""
        out: list = [(b"", True, True)] * len(texts)
        whole, cut, pieces, at = [], [], [], [0]
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_word or MARK in t or "  " in t or t[0] == " " or t[-1] == " ":
                whole.append(i)  # runs of markers, or the marker itself
            else:
                pieces += t.split(" ")
                at.append(len(pieces))
                cut.append(i)
        for i, v in zip(whole, self._judge([texts[i] for i in whole])):
            out[i] = v
        got = list(map(self.words.get, pieces))
        if None in got:
            lost = [k for k, v in enumerate(got) if v is None]
            new = list(dict.fromkeys(pieces[k] for k in lost))
            if len(self.words) + len(new) > MAX_WORDS:
                self.words.clear()
            fresh: dict = {}
            for a in range(0, len(new), 4096):
                part = new[a:a + 4096]
                fresh.update(zip(part, self._judge(part, [MARK + w for w in part])))
            if len(fresh) <= MAX_WORDS:
                self.words.update(fresh)
            for k in lost:
                got[k] = fresh[pieces[k]]
        for k, i in enumerate(cut):
            ids, parity, back = zip(*got[at[k]:at[k + 1]])
            out[i] = (b"".join(ids), all(parity), all(back))
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tok.decode_batch([np.frombuffer(b, dtype="<u4").tolist() for b in ids], skip_special_tokens=False)

    def normalized(self, t: str | None) -> str:
        """What decoding should give back."""
        if not t:
            return ""
        if self.tok.normalizer is None:
            return t
        s = self.tok.normalizer.normalize_str(t).replace(MARK, " ")
        return s[1:] if self.model["dummy_prefix"] and s[:1] == " " else s


_CODECS: dict[str, Codec] = {}


def worker_codec(key: str, buf: bytes, threads: int, parity: bool) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(buf, threads, parity)
    return _CODECS[key]


def read_model(path: str | None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: str | None = None, threads: int = 1, parity: bool = True,
                  id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_ids, ids_crc32`` (unsigned, little-endian 32-bit ids),
    ``parity`` (the rebuilt pipeline agreed with the sentencepiece library)
    and ``round_trip`` (decoding gives the normalised text back) for every
    whole text; with ``with_ids`` also ``ids`` and ``decoded``.  ``threads``
    is for each Spark task; leave it at 1 where tasks fill the cores."""
    spark = docs.sparkSession
    buf = spark.sparkContext.broadcast(read_model(model))
    key = f"{zlib.crc32(buf.value)}:{threads}:{parity}"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(it):
        codec = worker_codec(key, buf.value, threads, parity)
        for batch in it:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, part in slices(texts):
                got = codec.encode(part)
                cols = [doc_ids.slice(first, len(part)), pa.array([len(g[0]) // 4 for g in got], pa.int64()),
                        pa.array([zlib.crc32(g[0]) for g in got], pa.int64()),
                        pa.array([g[1] for g in got], pa.bool_()),
                        pa.array([g[2] for g in got], pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    cols += [pa.array([np.frombuffer(g[0], dtype="<u4").astype(np.int32) for g in got],
                                      pa.list_(pa.int32())),
                             pa.array(codec.decode([g[0] for g in got]), pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)
