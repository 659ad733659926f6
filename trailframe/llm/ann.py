"""Operator 9: nearest neighbours by largest inner product, over shifted
space-filling curves.

The inner product is turned into an angle (each row gets one more
coordinate that gives all rows one length, queries get 0 there).  Each of
``orderings`` random projections to ``dims`` coordinates is cut into cells
by quantiles, shifted, and run through along a Hilbert curve.  Spark sorts
rows and queries along every curve by range partitions; positions are the
ranks, so a bucket, a run of positions, has a bounded number of rows however
many keys are equal.  A query takes the buckets within ``window`` positions
of its own on every curve, each bucket gives its best ``k``, and these are
merged and ranked by the exact inner product of the original vectors.
Buckets are as long as the window, between ``MIN_BUCKET`` and
``MAX_BUCKET`` rows, so a query meets about three per curve; the queries that
meet a bucket come in chunks of ``CHUNK`` buckets' positions, so a task's
group is bounded on both sides.

The window is measured, not guessed: for a bounded sample of audit queries
the exact neighbours are found by brute force in blocks, and the window is
the least one that holds ``target`` of them on some curve.  Where vectors
have no structure (independent directions) that window is a fixed share of
the rows, and no ordering can make it smaller.

Cases: null, empty or zero vectors, vectors with null or non-finite numbers
and null ids take no part; rows that share an id are one vector (the
smallest by numbers); ties go to the smaller id; fewer than ``k`` candidates
are all returned; an empty table or no query gives no rows; vectors of
another dimension than the most frequent one take no part; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import hash_sample, materialize
from trailframe.llm.vectors import matrix, usable

K = 20
ORDERINGS = 8
DIMS = 4
BITS = 8
MIN_BUCKET, MAX_BUCKET = 2048, 65_536
CHUNK = 4
SAMPLE = 20_000
AUDIT = 200
TARGET = 0.96


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of unsigned integers below ``2**bits``) along
    the Hilbert curve through the cube (transposed Gray-code form)."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    n = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            hit = (x[i] & np.uint64(q)) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | (((x[i] ^ t) >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """Projections, quantile cuts and shifts, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, longest: float, orderings: int, dims: int, bits: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.longest, self.bits = longest, bits
        width = sample.shape[1] + 1
        dims = min(dims, width)
        self.axes = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(orderings)]
        self.shift = [rng.integers(0, 1 << bits, size=dims) for _ in range(orderings)]
        lifted = self.lift(sample, False)
        at = np.arange(1, 1 << bits) / (1 << bits)
        self.cuts = [[np.quantile(lifted @ a[:, j], at) for j in range(dims)] for a in self.axes]

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        sq = (v * v).sum(axis=1)
        if query:
            return np.concatenate((v / np.sqrt(sq)[:, None], np.zeros((len(v), 1))), axis=1)
        rest = np.sqrt(np.maximum(0, self.longest ** 2 - sq))
        return np.concatenate((v, rest[:, None]), axis=1) / self.longest

    def keys(self, v: np.ndarray, query: bool) -> list[np.ndarray]:
        x = self.lift(v, query)
        out = []
        for a, shift, cuts in zip(self.axes, self.shift, self.cuts):
            y = x @ a
            cells = np.stack([np.searchsorted(c, y[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
            out.append(hilbert((cells + shift) % (1 << self.bits), self.bits))
        return out


def positions(rows: DataFrame, curves: Curves, orderings: int) -> DataFrame:
    """``(o, vec_id, query, pos)``: rank of every row, and of every query
    beside it, along each curve."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(curves)

    def place(it):
        c = shared.value
        for batch in it:
            v = matrix(batch.column(1))
            is_query = np.asarray(batch.column(2))
            for query, at in ((False, np.arange(len(v))), (True, np.flatnonzero(is_query))):
                if not at.size:
                    continue
                ids = batch.column(0).take(pa.array(at))
                for o, key in enumerate(c.keys(v[at], query)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(at.size, o, dtype=np.int32)), pa.array(key), ids,
                         pa.array(np.full(at.size, query))], names=["o", "key", "vec_id", "query"])

    placed = rows.select("vec_id", "v", "query").mapInArrow(place, "o int, key long, vec_id long, query boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(it):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in it:
            o = batch.column(0).to_numpy()
            i = np.zeros(len(o), dtype=np.int64)
            for x in np.unique(o):  # sorted by curve, so each is one run
                at = np.flatnonzero(o == x)
                i[at] = seen.get(int(x), 0) + np.arange(at.size)
                seen[int(x)] = seen.get(int(x), 0) + at.size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(np.full(len(o), pid, dtype=np.int32)),
                 pa.array(i)], names=["o", "vec_id", "query", "pid", "i"])

    order = ["o", "key", "vec_id", "query"]
    ranked = materialize(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        number, "o int, vec_id long, query boolean, pid int, i long"), "ranked")
    # one row per curve and range partition
    sizes = ranked.groupBy("o", "pid").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("o", "pid", (F.sum("n").over(Window.partitionBy("o").orderBy("pid")) - F.col("n")).alias("base"))
    return ranked.join(base, ["o", "pid"]).select("o", "vec_id", "query", (F.col("base") + F.col("i")).alias("pos"))


def _best(q_ids, q, ids, v, k):
    """Best ``k`` of the rows ``v`` for each query, ties to the smaller id."""
    out_q, out_v, out_s = [], [], []
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    for a in range(0, len(q), 256):
        s = q[a:a + 256] @ v.T
        s[q_ids[a:a + 256, None] == ids[None, :]] = -np.inf
        for j in range(len(s)):
            row = s[j]
            if k < row.size:
                at = np.flatnonzero(row >= np.partition(row, row.size - k)[row.size - k])
            else:
                at = np.arange(row.size)
            at = at[row[at] > -np.inf]
            at = at[np.lexsort((ids[at], -row[at]))][:k]
            out_q.append(np.full(at.size, q_ids[a + j]))
            out_v.append(ids[at])
            out_s.append(row[at])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def exact_neighbours(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """Brute force for a bounded list of ``(id, vector)``: the list is sent
    to the rows, each batch gives its best ``k``."""
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.array([i for i, _ in queries], dtype=np.int64), np.array([x for _, x in queries], dtype=np.float64)))

    def run(it):
        qi, q = shared.value
        for batch in it:
            if batch.num_rows and len(qi):
                a, b, s = _best(qi, q, batch.column(0).to_numpy(), matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)],
                                                 names=["query_id", "vec_id", "score"])

    return _top(rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def measured_window(rows: DataFrame, ranks: DataFrame, k: int, audit: int, target: float) -> int:
    """Least distance along some curve that holds ``target`` of the true
    neighbours of the audit queries."""
    some = [(r["vec_id"], r["v"]) for r in hash_sample(rows.filter("query"), "vec_id", audit).toArrow().to_pylist()]
    true = exact_neighbours(rows, some, k).select("query_id", "vec_id")
    q = ranks.filter("query").select("o", F.col("vec_id").alias("query_id"), F.col("pos").alias("qpos"))
    gap = (true.join(ranks.filter("not query"), "vec_id").join(q, ["query_id", "o"])
           .groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("pos") - F.col("qpos"))).alias("gap")))
    got = gap.agg(F.percentile("gap", F.lit(target)).alias("w")).first()["w"]
    return int(np.ceil(got)) if got is not None else 0


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, orderings: int = ORDERINGS, dims: int = DIMS,
            bits: int = BITS, bucket: int | None = None, window: int | None = None, sample_rows: int = SAMPLE,
            audit: int = AUDIT, target: float = TARGET, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of
    each row where ``is_query`` holds, itself left out."""
    spark = embeddings.sparkSession
    rows = (usable(embeddings.filter(F.col(id_col).isNotNull()), vec_col)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"),
                    F.coalesce(is_query, F.lit(False)).alias("query"))
            .groupBy("vec_id").agg(F.min(F.struct("v", "query")).alias("r")).select("vec_id", "r.v", "r.query"))
    rows = materialize(rows, "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims_found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims_found is None:
        return empty
    rows = rows.filter(F.size("v") == dims_found["d"])
    longest = float(rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])
    sample = np.array([r["v"] for r in hash_sample(rows, "vec_id", sample_rows).select("v").toArrow().to_pylist()])
    if not len(sample):
        sample = np.zeros((1, dims_found["d"]))
    ranks = materialize(positions(rows, Curves(sample, longest, orderings, dims, bits), orderings), "positions")
    w = measured_window(rows, ranks, k, audit, target) if window is None else window

    size = bucket or min(MAX_BUCKET, max(MIN_BUCKET, w))
    c = F.col

    def runs(first, last, length):
        return F.explode(F.sequence(F.floor(F.greatest(first, F.lit(0)) / length), F.floor(last / length)))

    b = F.floor(c("pos") / size)
    body = (ranks.filter("not query")
            .select("o", b.alias("b"), runs(b * size - w, b * size + (size - 1 + w), CHUNK * size).alias("chunk"),
                    "vec_id", "query")
            .unionByName(ranks.filter("query").select(
                "o", runs(c("pos") - w, c("pos") + w, size).alias("b"), F.floor(c("pos") / (CHUNK * size)).alias("chunk"),
                "vec_id", "query"))
            .join(rows.select("vec_id", "v"), "vec_id"))

    def search(t: pa.Table) -> pa.Table:
        is_q = t.column("query").to_numpy()
        ids = t.column("vec_id").to_numpy()
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if is_q.any() and not is_q.all():
            v = matrix(t.column("v"))
            out = _best(ids[is_q], v[is_q], ids[~is_q], v[~is_q], k)
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    found = body.groupBy("o", "b", "chunk").applyInArrow(search, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
