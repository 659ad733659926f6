"""N-gram Jaccard join, substring dedup, near-duplicate vectors and nearest
neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.llm import ann, common, jaccard, neardup, queries, substring, words
from trailframe.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = WORD.findall(lower(t or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def near_copies(seed=1):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(300)]
    passage = [rng.choice(voc) for _ in range(60)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(voc) for _ in range(rng.choice([3, 5, 8, 40, 120, 200]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 1, 3, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(voc)
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(t)))
            n += 1
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "É é"), (n + 6, "É é")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_groups(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, None)],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (0, 0, 0)], key=str)
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_jaccard_null_id_copy_before_a_near_copy(spark):
    base = [f"w{k}" for k in range(100)]
    near = base[:50] + ["x"] + base[51:]
    df = spark.createDataFrame([(None, " ".join(base)), (1, " ".join(base)), (2, " ".join(near))],
                               "doc_id long, text string").coalesce(1)
    groups = jaccard.jaccard_groups(df)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in groups.collect()), key=str)
    assert got == sorted([(None, 96, None), (1, 96, 1), (2, 96, 1)], key=str)
    assert sorted((r.doc_id for r in jaccard.keep_one(df, groups).collect()), key=str) == [1, None]


def test_jaccard_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_jaccard(spark, SF).collect()}
    assert got == brute_jaccard(rows)


def test_large_group_of_near_copies_is_linear(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = {r.component_id for r in jaccard.jaccard_groups(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {0}


def test_hot_lists_of_sets_around_the_threshold(spark):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(140)]
    rows = []

    def edited(words, edits):
        t = list(words)
        for _ in range(edits):
            k = rng.randrange(len(t))
            t[k:k + 1] = rng.choice([[], [f"x{rng.randrange(10 ** 6)}"], [t[k], f"y{rng.randrange(10 ** 6)}"]])
        return t

    for _ in range(120):  # some are alike to the base, some only to each other
        t = edited(base[:rng.choice([100, 120, 140])], rng.randrange(1, 9))
        rows.append(t)
        if rng.random() < 0.4:
            rows.append(edited(t, rng.randrange(1, 5)))
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_jaccard(rows)
    assert got == want
    assert 10 < len({c for _, c in want.values()}) < len(rows) - 10


def brute_substring(rows, w=50):
    first = {}
    docs = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(docs):
        for k in range(len(docs[i]) - w + 1):
            first.setdefault(tuple(docs[i][k:k + w]), i)
    out = {}
    for i, x in docs.items():
        gone = set()
        for k in range(len(x) - w + 1):
            if first[tuple(x[k:k + w])] < i:
                gone.update(range(k, k + w))
        kept = " ".join(x[k] for k in range(len(x)) if k not in gone)
        out[i] = (len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def repeats(seed):
    rng = random.Random(seed)
    voc = [f"é{k}" if k % 9 == 0 else f"v{k}" for k in range(5 if seed == 9 else 2000)]
    word = lambda n: [rng.choice(voc) for _ in range(n)]
    passages = [word(n) for n in (49, 50, 51, 60, 75, 130, 300)]
    rows = []
    for i in range(60):
        t = word(rng.choice([0, 3, 30, 49, 80, 200]))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = rng.choice(passages)
            a = rng.choice([0, 0, 0, rng.randrange(len(p))])
            t += p[a:] + word(rng.choice([0, 0, 1, 7, 30]))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(t)))
    rows += [(60, rows[7][1]), (61, rows[7][1]), (62, None), (63, ""), (64, " ".join(["same"] * 200)),
             (65, " ".join(["same"] * 120))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 9])
def test_substring_dedup(spark, seed):
    rows = repeats(seed)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_words int").repartition(4)
    out = substring.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_substring(rows)
    for r in out:  # the cleaned text holds exactly the kept words
        kept = " ".join(WORD.findall(r.text or ""))
        assert hashlib.sha256(kept.encode()).hexdigest() == r.kept_sha256
        if not r.n_removed:
            assert r.text == dict(rows)[r.doc_id]


def test_substring_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(substring, "MAX_BITS", 10)
    rows = repeats(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df).collect()}
    assert got == brute_substring(rows)


def test_substring_edge_cases(spark):
    t = " ".join(f"a{k}" for k in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t), (3, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 60, 0), (1, 60, 0), (None, 60, 0), (2, 60, 60), (3, 1, 0)], key=str)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_substring_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in queries.op10_substring_dedup(spark, SF).collect()}
    assert got == brute_substring(rows)


def test_numpy_form_of_the_row_hash(spark):
    df = spark.createDataFrame([(k * 7919 - 5_000_000_000, k - 3) for k in range(50)], "r long, a int")
    got = df.select("r", "a", F.xxhash64("r", "a").alias("h")).toPandas()
    mine = substring.xxhash64_pair(got.r.to_numpy(), got.a.to_numpy().astype(np.int32)).view(np.int64)
    assert (mine == got.h.to_numpy()).all()


def test_words_are_cut_like_the_pattern():
    texts = ["", " a  b\x0bc\x1cd ", "É é x", "one", "\n"]
    data, start, end, h, bounds = words.batch_words([t.encode() for t in texts])
    for i, t in enumerate(texts):
        got = [data[a:b].decode() for a, b in zip(start[bounds[i]:bounds[i + 1]], end[bounds[i]:bounds[i + 1]])]
        assert got == WORD.findall(t)
    _, _, _, h, _ = words.batch_words([b"Ab aB ab", b"zab"], lower=True)
    assert h[0] == h[1] == h[2] != h[3]
    assert (words.windows(h, 2)[:2][0] == words.windows(h, 2)[1])


def test_bloom_never_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bits = common.bloom_words(keys, "k", 16)
    k = keys.toPandas().k.to_numpy().view(np.uint64)
    assert common.bloom_hits(bits, k).all()
    assert common.bloom_hits(bits, k * np.uint64(3) + np.uint64(1)).mean() < 0.3


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    got = {r.node: r.component for r in common.connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in components({x for l in links for x in l}, links).items() if n in nodes}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, t=0.98):
    ok = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if (x != 0).any():
            ok[i] = (lab, x / np.sqrt(x @ x))
    ids = sorted(ok)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
            if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= t]


def clustered(n=600, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(60)] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [float("nan")] * dim, 1),
             (n + 4, [None] * dim, 1), (n + 5, rows[0][1], None), (n + 6, rows[0][1], rows[0][2]), (n + 7, [1.0, 2.0], 1)]
    return rows


@pytest.mark.parametrize("max_shard", [2048, 64])
def test_near_duplicates(spark, max_shard):
    rows = clustered()
    df = spark.createDataFrame([(*r, 0) for r in rows],
                               "vec_id long, embedding array<float>, label int, n_links int").repartition(3)
    true = brute_links(rows)
    got = neardup.near_duplicates(df, shard=128, max_shard=max_shard).collect()
    assert len(got) == len(rows)
    found = neardup.links_of(neardup.prepared(df, "vec_id", "embedding", "label"), shard=128, max_shard=max_shard)
    pairs = {(r.a, r.b) for r in found.collect()}
    assert pairs <= set(true) and len(pairs) >= 0.97 * len(true)
    degree = {i: 0 for i, *_ in rows}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    comp = components([r[0] for r in rows], pairs)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == \
        {i: (degree[i], comp[i], comp[i] == i) for i in degree}
    assert neardup.recall(df, found, queries=200) >= 0.95


def test_near_duplicates_raise_the_overlap(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):  # pairs just above the threshold, over many shards
        x, y = rng.normal(size=(2, 16))
        x /= np.sqrt(x @ x)
        y -= (y @ x) * x
        y /= np.sqrt(y @ y)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (0.982 * x + np.sqrt(1 - 0.982 ** 2) * y).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    true = set(brute_links(rows))
    vectors = neardup.prepared(df, "vec_id", "embedding", "label")
    once = neardup.searched(vectors, 0.98, 1, 8, neardup.MAX_SHARD, neardup.MAX_CENTROIDS, neardup.SAMPLE, neardup.BEAM)
    assert once.count() < neardup.RECALL * len(true)
    got = neardup.near_duplicates(df, overlap=1, shard=8).collect()
    assert neardup.RECALL * len(true) <= sum(r.n_links for r in got) / 2 <= len(true)
    counts = {r.vec_id: r.n for r in neardup.true_degrees(vectors, 0.98, 10_000).collect()}
    assert counts == {i: sum(i in p for p in true) for i in {x for p in true for x in p}}


def test_near_duplicates_of_many_equal_vectors(spark):
    rng = np.random.default_rng(6)
    one, two = rng.normal(size=16), rng.normal(size=16)
    near = one + 0.01 * rng.normal(size=16)
    rows = [(i, one.tolist(), 1) for i in range(3000)] + [(3000 + i, near.tolist(), 1) for i in range(50)]
    rows += [(4000, two.tolist(), 1), (4001, one.tolist(), 2), (4002, [-0.0, 1.0], 3), (4003, [0.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (3049, 0) for i in range(3050))
    assert got[4000] == (0, 4000) and got[4001] == (0, 4001)
    assert got[4002] == got[4003] == (1, 4002)


def test_near_duplicates_of_almost_equal_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=16) + 1e-7 * rng.normal(size=(500, 16))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>, label int").repartition(4)
    got = [(r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect()]
    assert got == [(499, 0)] * 500


def test_near_duplicates_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [2.0, 0.0], 0)], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 1, 1, False)], key=str)


def test_near_duplicate_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    true = brute_links(rows)
    got = {r.vec_id: r.n_links for r in queries.op2_near_duplicates(spark, SF).collect()}
    assert sum(got.values()) >= 2 * 0.97 * len(true) and sum(got.values()) <= 2 * len(true)


def brute_nearest(rows, is_query, k):
    ok = {i: np.array(v, dtype=np.float64) for i, v, *_ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if is_query(q):
            s = sorted(((-float(ok[q] @ x), i) for i, x in ok.items() if i != q and len(x) == len(ok[q])))[:k]
            out[q] = [(i, -v) for v, i in s]
    return out


def test_nearest(spark):
    rows = [r for r in clustered(900, seed=5) if not (r[1] and len(r[1]) == 2)]
    df = spark.createDataFrame([(r[0], r[1], 0) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    true = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, bucket=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(true)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true)
    assert hit >= 0.9 * sum(len(v) for v in true.values())
    vec = {r[0]: np.array(r[1], dtype=np.float64) for r in rows if r[1]}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, s in found:
            assert abs(s - vec[q] @ vec[i]) < 1e-9


def test_nearest_few_rows_and_ties(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(None, [1.0, 0.0]), (40, None)], schema)
    got = [(r.query_id, r.rank, r.vec_id) for r in
           ann.nearest(df, F.col("vec_id").isin(0, 5)).orderBy("query_id", "rank").collect()]
    for q in (0, 5):
        assert [x[2] for x in got if x[0] == q] == [i for i in range(30) if i != q][:20]
    assert ann.nearest(df, F.lit(False)).count() == 0


def test_hilbert_neighbours_touch():
    g = np.array([(a, b) for a in range(16) for b in range(16)])
    key = ann.hilbert(g, 4)
    assert sorted(key) == list(range(256))
    path = g[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_nearest_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    true = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in queries.op9_nearest(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in true[q]}) for q in true) >= 0.9 * sum(len(v) for v in true.values())


def test_winnowed_blocks_cover_every_window():
    """Each window with a shared block keeps one, the same in every text."""
    rng = random.Random(6)
    passage = [rng.choice("abc") + str(rng.randrange(9)) for _ in range(140)]
    texts = [" ".join([f"x{rng.random()}" for _ in range(k)] + passage + [f"y{rng.random()}" for _ in range(60 - k)])
             for k in range(0, 60, 7)] + ["short text", " ".join(["w"] * 200)]
    r = substring.Rolled([t.encode() for t in texts], 50, 25)
    all_at = r.at.copy()
    r.keep(r.key % np.uint64(3) == 0)
    kept = set(r.at.tolist())
    r.winnow()
    left = r.at.tolist()
    assert set(left) < kept <= set(all_at.tolist())
    for s in all_at.tolist():
        if s + 50 <= r.doc.size and r.doc[s] == r.doc[s + 49] and kept & set(range(s, s + 26)):
            assert set(left) & set(range(s, s + 26))
    inner = []
    for k, a in enumerate(r.bounds[:9].tolist()):
        first = a + 7 * k  # where the passage starts; blocks whose windows all lie inside it
        inner.append([p - first for p in left if first + 25 <= p <= first + 140 - 50])
    assert all(x == inner[0] for x in inner) and 0 < len(inner[0]) < 20
