"""Ranked lexical search against brute force, and its sharing graph."""

import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from trailframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, top):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t, Counter(t)) for i, t in docs if t]
    n_docs, n_all = len(docs), sum(len(t) for _, t, _ in docs)
    df = Counter(w for _, _, c in docs for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, t, c in docs:
            m = 100 - 50 + (50 * len(t) * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
                    for w in set(terms(text)) if w in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(40)] + ["é", "中文", "Ab", "x_y"]
    docs = [(i, rng.choice([" ", ", ", "\n", "\x00"]).join(rng.choice(voc) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    docs += [(3, docs[3][1]), (500, docs[4][1]), (None, docs[5][1]), (600, None), (601, ""), (602, "?! "), (603, "w1 " * 400_000)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.randrange(1, 25)))) for k in range(30)]
    items += [(30, items[2][1]), (2, items[2][1]), (31, None), (32, ""), (33, "nothing"), (34, "w1 W1 w1")]
    return docs, items


def test_rank(spark):
    docs, items = made(1)
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, score int").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for block_bytes in (lexical.BLOCK_BYTES, 200):  # one block, and many
        got = lexical.rank(d, q, top=9, block_bytes=block_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, 9)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank(d.filter("false"), q).count() == 0
    assert lexical.rank(d, q.filter("false")).count() == 0
    assert lexical.rank(spark.createDataFrame([(1, None)], "doc_id long, text string"), q).count() == 0


def expand(merges, n_terms, node):
    if node < n_terms:
        return [node]
    a, b = merges[node - n_terms]
    return expand(merges, n_terms, a) + expand(merges, n_terms, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=9), max_size=12), st.sampled_from([2, 5, 96]))
def test_sharing_graph_keeps_every_item(sets, mined):
    items = [sorted(s) for s in sets]
    merges, nodes = lexical.share(items, 15, mined)
    for own, want in zip(nodes, items):
        assert sorted(t for x in own for t in expand(merges, 15, x)) == want  # each term once
    assert all(a < 15 + j and b < 15 + j for j, (a, b) in enumerate(merges))
    # a shared node costs one addition and saves one in two items or more
    assert len(merges) + sum(map(len, nodes)) <= sum(map(len, items))


def test_common_sets_are_found():
    merges, nodes = lexical.share([[0, 1, 2, 3, 9], [0, 1, 2, 3, 8], [0, 1, 7]], 10)
    assert sorted(expand(merges, 10, max(nodes[0]))) == [0, 1, 2, 3] and len(merges) == 3
    assert max(nodes[0]) == max(nodes[1]) and len(nodes[2]) == 2
