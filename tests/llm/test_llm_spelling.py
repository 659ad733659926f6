"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trailframe.llm import queries, spelling
from trailframe.llm.common import table

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every=97):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = low(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    by_len = {}
    for w in n:
        by_len.setdefault(len(w), []).append(w)
    out = {}
    for w, k in n.items():
        close = [v for d in (-1, 0, 1) for v in by_len.get(len(w) + d, []) if v != w and near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * k else None
        out[w] = [form, None, k, len(close), n[form] if form else None]
    for w in out:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        out[w][1] = r
    return {w: tuple(v) for w, v in out.items()}


def got(df):
    rows = df.select(*COLS).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got(queries.op13_spelling_variants(spark, SF)) == brute(rows)


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    words = []
    for w in base:
        for _ in range(rng.choice([1, 3, 9, 30])):
            c = list(w)
            kind = rng.random()
            if kind < 0.25:
                c[rng.randrange(len(c))] = rng.choice("abcdeÿ")
            elif kind < 0.4:
                c.insert(rng.randrange(len(c) + 1), rng.choice("abcde"))
            elif kind < 0.55:
                del c[rng.randrange(len(c))]
            words += ["".join(c)] * rng.choice([1, 2, 3])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "中", "9", "\U0001f600 "]).join(words[i::7]).swapcase()) for i in range(7)]
    return [*rows, (7, None), (8, ""), (None, " ".join(base * 3)), (3, rows[3][1]), (9, "x" * 400 + " " + "x" * 401)] * 2


@pytest.mark.parametrize("seed,block", [(1, spelling.BLOCK), (2, 16), (3, 4)])
def test_made_words(spark, seed, block):
    """Also with tiny blocks, so every bucket is cut."""
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = brute(rows, every=5)
    assert len(want) > 50 and sum(v[3] for v in want.values()) > 50
    assert got(spelling.variants(df, every=5, block=block)) == want


@pytest.mark.parametrize("k", range(1, len(spelling.GROUPS) + 1))
def test_every_depth_finds_each_pair_once(spark, k):
    rng = random.Random(k)
    words = sorted({"".join(rng.choice("aenrtslo") for _ in range(rng.randrange(2, 6))).encode() for _ in range(300)})
    c = spelling.group_counts(words)
    df = spark.createDataFrame([(bytearray(w), i, len(w), r.tolist()) for i, (w, r) in enumerate(zip(words, c))],
                               "word binary, n long, len int, c array<int>")
    found = Counter()
    for r in spelling.near_words(spelling.blocks(spelling.deal(df, k), 64)).collect():
        found[bytes(r.word)] += r.near
    text = {w: w.decode("latin-1") for w in words}
    assert dict(found) == {w: m for w in words if (m := sum(near(text[w], text[v]) for v in words if v != w))}


def test_trie_search_equals_pairs():
    rng = np.random.default_rng(5)
    index = sorted({bytes(rng.integers(97, 101, 6).astype(np.uint8)) for _ in range(900)})
    seekers = index + sorted({bytes(rng.integers(97, 101, 7).astype(np.uint8)) for _ in range(900)})
    s, i = spelling.search(index, seekers)
    want = {(a, b) for a, x in enumerate(seekers) for b, y in enumerate(index) if x != y and near(x.decode(), y.decode())}
    assert len(s) == len(want) and set(zip(s.tolist(), i.tolist())) == want


def test_empty_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).columns == COLS and spelling.variants(empty).count() == 0
    long = "lorem ipsum dolorem " * 200_000  # several slices
    rows = [(1, long), (2, "dolorem dolores dolores dolores")]
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
