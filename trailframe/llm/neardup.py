"""Operator 2: embedding near-duplicates on robust-pruned flat graphs.

Within each label (and dimension), vectors are dealt to the ``overlap``
nearest of a bounded number of centroids, so shards overlap.  In each shard
a flat graph is built: near and a few random candidates per vector, thinned
by robust pruning (a candidate goes if a kept neighbour is closer to it by
the factor ``alpha`` than the vector is).  The adjacency lists of a vector
from all its shards are united.  Then every vector is searched in its shards
over the united lists: a greedy beam search from the shard's medoid and the
vector's own list finds the neighbourhood, and the range is expanded through
all vectors inside it until no new one turns up.  Pairs found are verified
by the cosine of the original vectors in double precision.

Shards of more than ``max_shard`` vectors are cut into blocks, and every two
blocks are a task, so no task holds more than two blocks and no pair of the
shard is left out.

Equal vectors of a label are one class, which its smallest id stands for in
the graphs; a class of m members gives each of them m - 1 links and a row of
the classes it is linked to, so copies are never expanded into pairs.

Two vectors without a common shard are never compared, so the result is
audited: the links of a bounded sample (``AUDIT`` vectors) are counted
against all rows, and until ``RECALL`` of them is found, the overlap (then
the beam) is doubled and the links found are united.  At the end every vector
is in every shard of its label and the search opens all it can reach; a
recall still below raises.  ``recall`` gives the figure of any links.

Cases: null labels, null, empty or zero vectors and vectors with null or
non-finite numbers link with nothing; equal vectors are always linked;
rows that share an id are one vector (the smallest by label and numbers) and
each get its result; a null ``vec_id`` keeps its row, with no links and a
null component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import connected_components, hash_sample, materialize
from trailframe.llm.vectors import matrix, usable

THRESHOLD = 0.98
OVERLAP = 2
SHARD = 512
MAX_SHARD = 2048
MAX_CENTROIDS = 2048
SAMPLE = 20_000
NEAR, FAR, ALPHA = 16, 8, 1.2
BEAM = 24
#: how far below the threshold the search still walks
SLACK = 0.02
#: share of the audited links to be found, and the number of audited vectors
RECALL = 0.99
AUDIT = 1000
#: sums of rounding errors in a cosine are far below this
CLOSE = 1e-9

LOG = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        near = (sample @ c.T).argmax(axis=1)
        for j in range(len(c)):
            s = sample[near == j].sum(axis=0)
            if np.abs(s).sum() > 0:
                c[j] = s / np.sqrt(s @ s)
    return c


def build(v: np.ndarray, near: int = NEAR, far: int = FAR, alpha: float = ALPHA, seed: int = 1) -> np.ndarray:
    """Adjacency (rows of local numbers, -1 pads) of a shard of unit vectors."""
    m = len(v)
    rng = np.random.default_rng(seed)
    v = v.astype(np.float32)
    out = []
    for a in range(0, m, 512):
        b = min(m, a + 512)
        sim = v[a:b] @ v.T
        sim[np.arange(b - a), np.arange(a, b)] = -np.inf
        c = min(3 * near, m)
        cand = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sim, cand, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, axis=1), np.take_along_axis(s, order, axis=1)
        part = [robust_prune(v, cand, s, near, alpha)]
        rand = rng.integers(0, m, size=(b - a, 2 * far))
        s = np.take_along_axis(sim, rand, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        part.append(robust_prune(v, np.take_along_axis(rand, order, axis=1),
                                 np.take_along_axis(s, order, axis=1), far, alpha))
        out.append(np.concatenate(part, axis=1))
    return np.concatenate(out) if out else np.zeros((0, near + far), dtype=np.int64)


def robust_prune(v: np.ndarray, cand: np.ndarray, sim: np.ndarray, keep: int, alpha: float) -> np.ndarray:
    """Neighbours kept of each row's candidates (nearest first); -1 pads."""
    d = np.sqrt(np.maximum(0, 2 - 2 * sim))
    alive = np.isfinite(sim)
    rows = np.arange(len(cand))
    out = np.full((len(cand), keep), -1, dtype=np.int64)
    at = v[cand]
    for r in range(keep):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, r] = cand[rows, pick][some]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("mcd,md->mc", at, at[rows, pick])))
        alive &= ~((alpha * between <= d) & some[:, None])
        alive[rows, pick] = False
    return out


def opened(at: np.ndarray, flat: np.ndarray, front: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The unseen neighbours of ``front``, each once; the list of row ``i`` is
    ``flat[at[i]:at[i + 1]]``."""
    n = at[front + 1] - at[front]
    new = flat[np.repeat(at[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return np.unique(new[~seen[new]])


def range_search(v: np.ndarray, at: np.ndarray, flat: np.ndarray, q: int, start: np.ndarray, reach: float,
                 beam: int) -> np.ndarray:
    """Local numbers of the vectors found with similarity ``reach`` or more
    to vector ``q``: greedy beam first, then expansion through the range."""
    seen = np.zeros(len(v), dtype=bool)
    x = v[q]
    found, sims = start, v[start] @ x
    seen[start] = True
    spent = np.zeros(len(start), dtype=bool)
    while True:  # each step opens the unopened vectors of the beam
        top = np.argsort(-sims, kind="stable")[:beam]
        fresh = top[~spent[top]]
        if not fresh.size:
            break
        spent[fresh] = True
        new = opened(at, flat, found[fresh], seen)
        if new.size:
            seen[new] = True
            found = np.concatenate((found, new))
            sims = np.concatenate((sims, v[new] @ x))
            spent = np.concatenate((spent, np.zeros(new.size, dtype=bool)))
    inside = sims >= reach
    front = found[inside & ~spent]
    out = [found[inside]]
    while front.size:
        new = opened(at, flat, front, seen)
        seen[new] = True
        front = new[v[new] @ x >= reach]
        out.append(front)
    return np.concatenate(out)


def deal(rows: DataFrame, overlap: int, shard: int, max_shard: int, max_centroids: int, sample_rows: int,
         seed: int = 3) -> DataFrame:
    """``(vec_id, v, label, task)``: each vector in the tasks it takes part in."""
    spark = rows.sparkSession
    counts = {(r["label"], r["dim"]): r["count"] for r in rows.groupBy("label", "dim").count().collect()}
    picked: dict = {}
    for r in hash_sample(rows, "vec_id", sample_rows).toArrow().to_pylist():
        picked.setdefault((r["label"], r["dim"]), []).append((r["vec_id"], r["v"]))
    total = max(1, sum(counts.values()))
    cents = {}
    for key, n in counts.items():
        some = np.array([x for _, x in sorted(picked.get(key, []))], dtype=np.float64)
        k = max(1, min(-(-n // shard), max(1, max_centroids * n // total), len(some)))
        cents[key] = centroids(unit(some), k) if len(some) and k > 1 else None
    shared = spark.sparkContext.broadcast(cents)
    names = {key: i for i, key in enumerate(sorted(cents, key=str))}

    def run(it):
        by = shared.value
        for batch in it:
            label, dim = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys = list(zip(label, dim))
            where: dict = {}
            for i, k in enumerate(keys):
                where.setdefault(k, []).append(i)
            for k, at in where.items():
                at = np.array(at)
                part = batch.take(pa.array(at))
                c = by.get(k)
                if c is None:
                    near = np.zeros((len(at), 1), dtype=np.int64)
                else:
                    near = np.argsort(-(unit(matrix(part.column(3))) @ c.T), axis=1, kind="stable")[:, :overlap]
                pos = np.repeat(np.arange(len(at)), near.shape[1])
                out = part.take(pa.array(pos))
                yield pa.RecordBatch.from_arrays(
                    [out.column(0), out.column(3), pa.array(np.full(len(pos), names.get(k, -1)), pa.int32()),
                     pa.array(near.ravel(), pa.int32())], names=["vec_id", "v", "part", "shard"])

    dealt = materialize(rows.select("vec_id", "label", "dim", "v").mapInArrow(
        run, "vec_id long, v array<double>, part int, shard int"), "dealt")
    sizes = dealt.groupBy("part", "shard").agg(F.ceil(F.count(F.lit(1)) / max_shard).cast("int").alias("nb"))
    # one row per shard: the number of blocks (left to the planner to send)
    return (dealt.join(sizes, ["part", "shard"])
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.expr(
                "case when nb = 1 then array(0) else filter(sequence(0, nb - 1), x -> x <> block) end")))
            .select("vec_id", "v", F.struct("part", "shard", F.least("block", "other").alias("i"),
                                            F.greatest("block", "other").alias("j")).alias("task")))


def links_of(rows: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, shard: int = SHARD,
             max_shard: int = MAX_SHARD, max_centroids: int = MAX_CENTROIDS, sample_rows: int = SAMPLE,
             beam: int = BEAM, target: float = RECALL, audit: int = AUDIT) -> DataFrame:
    """Verified links ``(a, b, cosine)``, ``a < b``, of rows ``(vec_id,
    label, dim, v)`` with one row per id; at least ``target`` of the links of
    about ``audit`` sampled vectors are among them."""
    true = materialize(true_degrees(rows, threshold, audit), "audit")
    most = min(max_centroids, -(-rows.count() // shard))
    links = None
    while True:
        new = searched(rows, threshold, overlap, shard, max_shard, max_centroids, sample_rows, beam)
        links = new if links is None else materialize(
            links.union(new).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "links")
        share = audited(true, links)
        LOG.info("near duplicates: %.4f of the audited links found at overlap %d, beam %d", share, overlap, beam)
        if share >= target:
            return links
        if overlap >= most and beam >= 2 * max_shard:
            raise RuntimeError(f"near duplicates: {share:.4f} of the audited links found, {target} demanded")
        if overlap < most:
            overlap *= 2
        else:
            beam *= 2


def true_degrees(rows: DataFrame, threshold: float, audit: int) -> DataFrame:
    """``(vec_id, n)``: the links of at most about ``audit`` sampled vectors
    among all rows, of those that have any; only counts leave a task."""
    by: dict = {}
    for r in hash_sample(rows, "vec_id", audit).toArrow().to_pylist():
        by.setdefault((r["label"], r["dim"]), []).append((r["vec_id"], r["v"]))
    shared = rows.sparkSession.sparkContext.broadcast(
        {k: (np.array([i for i, _ in x]), np.array([v for _, v in x], dtype=np.float64)) for k, x in by.items()})

    def run(it):
        some = shared.value
        total = {k: np.zeros(len(ids), dtype=np.int64) for k, (ids, _) in some.items()}
        for batch in it:
            where: dict = {}
            for i, k in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if k in some:
                    where.setdefault(k, []).append(i)
            for k, at in where.items():
                part = batch.take(pa.array(at))
                ids, own = part.column(0).to_numpy(), matrix(part.column(3))
                qid, q = some[k]
                norm, qnorm = (np.sqrt((x * x).sum(axis=1)) for x in (own, q))
                c = unit(own) @ unit(q).T
                a, b = np.nonzero(np.abs(c - threshold) <= CLOSE)  # decided by the formula of the search
                c[a, b] = np.einsum("nd,nd->n", own[a], q[b]) / (norm[a] * qnorm[b])
                total[k] += ((c >= threshold) & (ids[:, None] != qid[None])).sum(axis=0)
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *(ids for ids, _ in some.values())])
        n = np.concatenate([np.zeros(0, dtype=np.int64), *(total[k] for k in some)])
        yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["vec_id", "n"])

    return (rows.select("vec_id", "label", "dim", "v").mapInArrow(run, "vec_id long, n long")
            .groupBy("vec_id").agg(F.sum("n").alias("n")))


def audited(true: DataFrame, links: DataFrame) -> float:
    """Share of the links counted in ``true`` that ``links`` holds: over all
    of them or as the mean over vectors, whichever is less (large groups
    weigh most in the first)."""
    ends = links.select(F.explode(F.array("a", "b")).alias("vec_id"))
    found = ends.join(F.broadcast(true.select("vec_id")), "vec_id").groupBy("vec_id").agg(F.count(F.lit(1)).alias("f"))
    got = F.coalesce("f", F.lit(0))
    r = true.join(found, "vec_id", "left").agg(F.sum(got) / F.sum("n"), F.avg(got / F.col("n"))).first()
    return 1.0 if r[0] is None else float(min(r[0], r[1]))


def searched(rows: DataFrame, threshold: float, overlap: int, shard: int, max_shard: int, max_centroids: int,
             sample_rows: int, beam: int) -> DataFrame:
    """The links of one round of dealing, building and searching."""
    dealt = materialize(deal(rows, overlap, shard, max_shard, max_centroids, sample_rows), "tasks")

    def build_task(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids = t.column("vec_id").to_numpy()
        adj = build(unit(matrix(t.column("v"))))
        a = np.repeat(ids, adj.shape[1])
        flat = adj.ravel()
        ok = flat >= 0
        a, b = a[ok], ids[flat[ok]]
        # near edges serve both ways
        return pa.table({"vec_id": np.concatenate((a, b)), "nbr": np.concatenate((b, a))})

    edges = dealt.groupBy("task").applyInArrow(build_task, "vec_id long, nbr long").distinct()
    lists = edges.groupBy("vec_id").agg(F.collect_list("nbr").alias("nbrs"))
    whole = dealt.join(lists, "vec_id", "left")

    def search_task(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids = t.column("vec_id").to_numpy()
        raw = matrix(t.column("v"))
        v = unit(raw).astype(np.float32)
        local = t.column("nbrs").to_pylist()
        lists_ = []
        for x in local:
            x = np.array(x or [], dtype=np.int64)
            near = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            lists_.append(near[ids[near] == x] if x.size else x)
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists_]))).astype(np.int64)
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *lists_])
        medoid = int((v @ v.mean(axis=0)).argmax())
        norm = np.sqrt((raw * raw).sum(axis=1))
        m = len(ids)
        met = []
        for q in range(m):
            start = np.unique(np.append(lists_[q], (medoid, q)))
            got = range_search(v, at, flat, q, start, threshold - SLACK, beam)
            got = got[got != q]
            met.append(np.minimum(got, q) * m + np.maximum(got, q))
        code = np.unique(np.concatenate(met)) if met else np.zeros(0, dtype=np.int64)
        parts = []
        for k in range(0, len(code), 1 << 16):  # verification in double precision
            a, b = np.divmod(code[k:k + (1 << 16)], m)
            c = np.einsum("nd,nd->n", raw[a], raw[b]) / (norm[a] * norm[b])
            ok = c >= threshold
            parts.append((ids[a[ok]], ids[b[ok]], c[ok]))
        if not parts:
            parts = [(ids[:0], ids[:0], np.zeros(0))]
        return pa.table({n: np.concatenate([x[i] for x in parts]) for i, n in enumerate(("a", "b", "cosine"))})

    found = whole.groupBy("task").applyInArrow(search_task, "a long, b long, cosine double")
    return materialize(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "links")


def prepared(embeddings: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    return (usable(embeddings.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), vec_col)
            .groupBy(F.col(id_col).cast("long").alias("vec_id"))
            .agg(F.min(F.struct(F.col(label_col).alias("label"),
                                F.col(vec_col).cast("array<double>").alias("v"))).alias("r"))
            .select("vec_id", "r.label", F.size("r.v").alias("dim"), "r.v"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    vectors = materialize(prepared(embeddings, id_col, vec_col, label_col), "vectors")
    classes = materialize(vectors.groupBy("label", "dim", "v").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    links = links_of(classes.select(F.col("rep").alias("vec_id"), "label", "dim", "v"), threshold, **options)
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("rep", "other")
    degree = (ends.join(classes.select(F.col("rep").alias("other"), "members"), "other")
              .groupBy("rep").agg(F.sum("members").alias("linked")))
    comp = connected_components(links.select("a", "b")).withColumnsRenamed({"node": "rep"})
    named = materialize(
        classes.join(degree, "rep", "left").join(comp, "rep", "left")
        .select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component")), "named")
    found = vectors.join(named, ["label", "v"]).select("vec_id", "n_links", "component")
    out = embeddings.select(F.col(id_col).cast("long").alias("vec_id")).join(found, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def recall(embeddings: DataFrame, links: DataFrame, threshold: float = THRESHOLD, queries: int = 500,
           id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> float:
    """Share of the true links of at most about ``queries`` sampled vectors
    that were found (the sample is compared with all rows, block by block)."""
    rows = prepared(embeddings, id_col, vec_col, label_col)
    some = hash_sample(rows, "vec_id", queries).toArrow().to_pylist()
    shared = embeddings.sparkSession.sparkContext.broadcast(
        [(r["vec_id"], r["label"], r["dim"], np.array(r["v"])) for r in some])

    def run(it):
        for batch in it:
            ids, label, dim = (batch.column(i).to_pylist() for i in range(3))
            by: dict = {}
            for i, k in enumerate(zip(label, dim)):
                by.setdefault(k, []).append(i)
            for k, at in by.items():
                mine = unit(matrix(batch.take(pa.array(at)).column(3)))
                for q, ql, qd, x in shared.value:
                    if (ql, qd) == k:
                        c = mine @ (x / np.sqrt(x @ x))
                        hit = [ids[at[j]] for j in np.flatnonzero(c >= threshold) if ids[at[j]] != q]
                        if hit:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([min(q, h) for h in hit]), pa.array([max(q, h) for h in hit])],
                                names=["a", "b"])

    true = rows.mapInArrow(run, "a long, b long").distinct()
    n = true.count()
    return 1.0 if not n else true.join(links, ["a", "b"], "left_semi").count() / n
