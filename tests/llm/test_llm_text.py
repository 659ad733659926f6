"""Token counts, SentencePiece, packing, chat formatting against the
libraries and plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailframe.llm import chat, packing, queries, segments, sentencepiece_codec, token_counts
from trailframe.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b", "x\n y", "x \n\n  y ", "a b c", "don't we'll 12 34,5 !! ?", "<|endoftext|> a",
       "x\n <|endoftext|>", "日本語 текст 🎉🎉", "tab\tand\x1cfs", "long " * 5000, "▁ ▁a", "　 　x", "é" * 300]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", 2), (3, ODD[3], "again", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, sequence_id int")


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(tok, t):
    return tok.encode(t or "", add_special_tokens=False).ids


alphabet = st.sampled_from(list("ab .,'s\n\t12é日  \x1c") + ["<|endoftext|>", "  ", "'ll"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(alphabet, max_size=12).map("".join), max_size=5))
def test_segments_give_the_library_ids(texts):
    spec = segments.read_tokenizer(None, "byte_bpe_50k.json")
    if not hasattr(test_segments_give_the_library_ids, "enc"):
        test_segments_give_the_library_ids.enc = segments.SegmentEncoder(spec, max_entries=50)
        test_segments_give_the_library_ids.tok = Tokenizer.from_str(spec)
    enc, tok = test_segments_give_the_library_ids.enc, test_segments_give_the_library_ids.tok
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == [ids_of(tok, t) for t in texts]


def test_token_counts(spark, odd, bpe):
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in
           token_counts.token_counts(odd, sample_rows=5, table_size=3).collect()]
    want = [(r.doc_id, len((r.text or "").encode()), len(ids_of(bpe, r.text)), len(ids_of(bpe, r.text)) > 1024)
            for r in odd.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_token_count_query(spark, bpe):
    want = {r.doc_id: len(ids_of(bpe, r.text)) for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, SF).collect()}
    assert got == want


def test_packing(spark, odd, bpe):
    got = packing.pack(odd, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for t in odd.collect():
        ids = ids_of(bpe, t.text) + [0]
        n = 2 if t.doc_id == 3 else 1  # the repeated row
        rows = sorted(by[(t.doc_id, len(ids))], key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in rows) == n * len(ids)
        assert sorted(i for r in rows for i in r.ids) == sorted(ids * n)
        for r in rows:
            part = ids[r.start:r.start + r.length]
            assert r.ids == part and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
            assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.length == 1 << r.bucket
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.pack(odd.limit(0)).count() == 0


def test_piece_lengths():
    for n in range(1, 3000, 7):
        p = packing.piece_lengths(n)
        assert sum(p) == n and p == sorted(p, reverse=True)
        assert len(p) == n // 1024 + bin(n % 1024).count("1")


def test_packing_query_covers_every_document(spark, bpe):
    rows = queries.op8_packing(spark, SF).groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    want = {r.doc_id: len(ids_of(bpe, r.text)) + 1 for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.n for r in rows} == want == {r.doc_id: r.t for r in rows}


def test_sentencepiece(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r, t in zip(sentencepiece_codec.encode_decode(odd, with_ids=True).collect(), odd.collect()):
        assert r.doc_id == t.doc_id and r.parity
        assert list(r.ids) == sp.encode(t.text or "") and r.n_ids == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        if "▁" not in (t.text or ""):
            assert r.round_trip and r.decoded == (t.text or "")
    assert sentencepiece_codec.encode_decode(odd.limit(0)).count() == 0


def test_sentencepiece_query_has_parity(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {r.doc_id: sp.encode(r.text) for r in table(spark, SF, "documents").collect()}
    for r in queries.op4_sentencepiece(spark, SF).collect():
        assert r.parity and r.round_trip
        assert r.ids_crc32 == zlib.crc32(np.asarray(want[r.doc_id], "<u4").tobytes())


def field(number, value):
    """One protobuf field (strings and messages, floats, numbers)."""
    import struct

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def test_unigram_model_scores_and_fallback():
    """A small unigram model written field by field: parity with the library."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -float(k + 1) / 2, 1) for k, p in enumerate(
        ["▁the", "▁", "the", "t", "h", "e", "▁a", "a", "b", "ab", "▁ab", "c", "abc"])]
    buf = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    buf += field(2, field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1))
    buf += field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    codec = sentencepiece_codec.Codec(buf)
    assert codec.model["kind"] == sentencepiece_codec.UNIGRAM and not codec.by_word
    got = codec.encode(["the abc", "ab  the ", "the é ab", ""])
    assert all(g[1] for g in got) and all(g[2] for g in got)


def test_ids_without_and_with_the_library():
    """Ranks read off the tokenizer file give the library's ids; a vocabulary
    whose ids do not follow its merges is left to the library."""
    import json

    spec = segments.read_tokenizer(None, "byte_bpe_50k.json")
    tok = Tokenizer.from_str(spec)
    texts = [t for t in ODD if t] + [" " * 5000 + "x", "a" * 3000, "1\u20092", "\x85\x1c \x85"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    enc = segments.IdEncoder(spec)
    assert enc.fast is not None and enc.encode(texts) == want and enc.encode([None, ""]) == [b"", b""]
    other = json.loads(spec)
    a, b = (t for t, i in other["model"]["vocab"].items() if i in (300, 9000))
    v = other["model"]["vocab"]
    v[a], v[b] = v[b], v[a]
    enc = segments.IdEncoder(json.dumps(other))
    tok = Tokenizer.from_str(json.dumps(other))
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.fast is None and enc.encode(texts) == want


def brute_chat(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), h("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"),
                h("".join(b for a, b in t if a == "assistant"))) for c, t in out.items()}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "<|part|>b\\"), (1, 3, "user", None),
            (2, 5, None, "[INST] <\\|end|> <\\\\|end|> </s>"), (2, None, "assistant", ""), (3, 0, "assistant", "é🎉"),
            (3, 0, "assistant", "é🎉"), (None, 1, "user", "x"), (4, 0, "<|text|>\nrole", "y"),
            (5, 0, "assistant", "z" * 100_000)] + [(6, k, "assistant" if k % 3 else "user", f"t{k}<|turn|>") for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df).collect()}
    assert got == brute_chat(rows)
    assert chat.digests(df.limit(0)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "|", "turn", "|>", "/s>", "s>", "INST]", "/", "end|>", "x", "|part|>"]),
                max_size=14).map("".join))
def test_chat_escape_is_reversible(text):
    import re

    spelled = re.sub(chat._OUT, r"\1\2\\\3", text)
    assert re.sub(chat._BACK, r"\1\2\3", spelled) == text
    for c in (chat.TURN, chat.TEXT, chat.PART, chat.END, "</s>", "[INST]"):
        assert c not in spelled


def test_chat_merges_adjacent_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")],
                               "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|turn|>user<|text|>a<|part|>b<|end|><|turn|>assistant<|text|>c<|end|>"
    assert sum(r.loss_runs) + r.end_chars == len(r.formatted)
    assert under_mask(r) == ["c"]


def under_mask(r):
    """Non-empty pieces of the string that the run lengths count."""
    out, at = [], 0
    for k, n in enumerate(r.loss_runs):
        if k % 2 and n:
            out.append(r.formatted[at:at + n])
        at += n
    assert at + r.end_chars == len(r.formatted)
    return out


def test_chat_loss_mask_covers_the_assistant_texts(spark):
    rng = random.Random(4)
    parts = ["HELLO", "<|end|>", "é", "\U0001f600", "", "[INST]", "\\", " x", "<|part|>"]
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "HELLO"), (0, 2, "user", "b"), (0, 3, "assistant", "WORLD")]
    rows += [(c, k, rng.choice(["user", "assistant", "assistant", "system", None]),
              "".join(rng.choice(parts) for _ in range(rng.randrange(0, 5))))
             for c in range(1, 60) for k in range(rng.choice([1, 2, 7, 300]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = {r.conv_id: r for r in chat.format_chats(df).collect()}
    back = {r.c: r.x for r in chat.format_chats(df).select(
        F.col("conv_id").alias("c"), chat.masked_texts(F.col("formatted"), F.col("loss_runs")).alias("x")).collect()}
    for c, r in formatted.items():
        want = [t for i, _, role, t in rows if i == c and role == "assistant" and t]
        assert [re.sub(chat._BACK, r"\1\2\3", x) for x in under_mask(r)] == want
        assert back[c] == want
    assert under_mask(formatted[0]) == ["HELLO", "WORLD"]


def test_chat_ties_follow_the_raw_text(spark):
    """``<|end|>`` and ``<|enda``: escaping would change their order."""
    rows = [(1, 0, "user", "<|end|>"), (1, 0, "user", "<z"), (1, 0, "assistant", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.parse_chats(chat.format_chats(df)).first()
    assert [(t.role, t.text) for t in r.turns] == sorted((a, b) for _, _, a, b in rows)


def test_chat_plan_is_native(spark):
    plan = queries.op5_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
