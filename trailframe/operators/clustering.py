"""Clustering.

Centres are small (k rows, or k rows per frame) and points are large.  The
point side is never shuffled for an assignment:

* global centres (Lloyd, similar-size k-means) are one constant array in the
  projection (a point's squared distances are one array of numbers), or a tree
  where they are many (:mod:`trailframe.operators.center_tree`); each pass
  is one scan with a partial ``groupBy(cid)`` aggregate, and only the k new
  centres come back to the driver;
* per-frame clustering (M7) takes all passes of a frame in one group where
  the frame fits a task.  Larger frames are partitioned once by frame and a
  salt, and kept; every pass joins one array of k centres per frame to them
  there, so no pass moves a point; settled frames leave the iteration.

Ties between equally distant centres go to the lowest centre id, matching
the reference's stable sort.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.operators.center_tree import bounded_lloyd, nearest_udf
from trailframe.session import cut_lineage, materialize, ship_package

Center = tuple[int, float, float]

#: from this many centres on they are searched through a tree
TREE_FROM = 128


# ------------------------------------------------------------------ ordering

def hash_order(key: Column | str, seed: int) -> Column:
    """Deterministic pseudo-random sort key for sampling without ``rand()``:
    the hex text of ``md5("<seed>:<key>")``.  128 bits, no arithmetic on the
    key (so no overflow at any size), and the same in any SQL engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), k.cast("string")))


def random_rows(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """L1: ``n`` pseudo-random rows (``orderBy(hash).limit(n)``, a bounded
    top-n; stable under repartitioning, unlike ``rand()``)."""
    return (df.withColumn("_h", hash_order(key, seed))
            .orderBy("_h", key).limit(int(n)).drop("_h"))


def random_member(assigned: DataFrame, seed: int, key: str = "id", cid: str = "cid",
                  cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """L2: one pseudo-random member per cluster, all clusters in one
    aggregation (``min_by`` aggregates partially before the shuffle)."""
    order = F.struct(hash_order(key, seed).alias("h"), F.col(key).alias("k"))
    m = F.min_by(F.struct(F.col(key), *[F.col(c) for c in cols]), order)
    return assigned.groupBy(cid).agg(m.alias("_m")).select(cid, "_m.*")


# ---------------------------------------------------------------- assignment

def _d2(x: Column, y: Column, cx, cy) -> Column:
    dx = x - cx
    dy = y - cy
    return dx * dx + dy * dy


def nearest_expr(centers: Sequence[Center], x: str = "x", y: str = "y") -> Column:
    """J3 as one expression: ``struct(d2, cid)`` of the nearest centre.

    The centres are three constant arrays, folded from their JSON text, so
    the plan does not grow with k; the squared distances are one array of
    plain numbers per point, in the order of the ids, so the first place of
    the least one is the lowest id."""
    if not centers:
        raise ValueError("no centres")
    cid, cx, cy = zip(*sorted((int(c), float(px), float(py)) for c, px, py in centers))
    ids, xs, ys = (F.from_json(F.lit(json.dumps(v)), f"array<{t}>")
                   for v, t in ((cid, "int"), (cx, "double"), (cy, "double")))
    d2 = F.zip_with(xs, ys, lambda a, b: _d2(F.col(x), F.col(y), a, b))
    # the array is bound to a name, so it is computed once
    return F.transform(F.array(d2), lambda d: F.struct(
        F.array_min(d).alias("d2"),
        F.element_at(ids, F.array_position(d, F.array_min(d)).cast("int")).alias("cid")))[0]


def assign_nearest(points: DataFrame, centers: Sequence[Center] | DataFrame,
                   x: str = "x", y: str = "y", out: str = "cid", method: str | None = None) -> DataFrame:
    """Add the id of the nearest centre (and ``d2``, the squared distance).

    ``method="array"`` compares every point with every centre in one
    expression, ``"tree"`` goes down a tree of the centres in Arrow batches;
    the rows are the same, and the number of centres decides where none is
    given.  A point with a NULL coordinate gets NULLs.

    ``centers`` is a list of ``(cid, x, y)`` or a DataFrame with those
    columns, whose k rows are read first.  k is a parameter of the
    clustering, not of the data; the centres reach every task as one value
    and the points are not shuffled.
    """
    if isinstance(centers, DataFrame):
        centers = [tuple(r) for r in centers.select("cid", "x", "y").collect()]
    if method not in (None, "array", "tree"):
        raise ValueError("method must be 'array' or 'tree'")
    if method == "tree" or (method is None and len(centers) >= TREE_FROM):
        ship_package(points.sparkSession)
        px, py = F.col(x).cast("double"), F.col(y).cast("double")
        best = F.when(px.isNotNull() & py.isNotNull(), nearest_udf(centers)(px, py))
    else:
        best = nearest_expr(centers, x, y)
    return points.withColumn("_best", best).withColumn(out, F.col("_best.cid")) \
        .withColumn("d2", F.col("_best.d2")).drop("_best")


# --------------------------------------------------------------- aggregates

def centroids(assigned: DataFrame, cid: str = "cid") -> DataFrame:
    """A4: ``avg(x), avg(y)`` and size per cluster; empty clusters vanish."""
    return assigned.groupBy(cid).agg(F.avg("x").alias("x"), F.avg("y").alias("y"),
                                     F.count(F.lit(1)).alias("n"))


def cluster_sizes(assigned: DataFrame, cid: str = "cid") -> DataFrame:
    """A5: ``(cid, n)`` ascending by size, cid as tie-break (L3)."""
    return assigned.groupBy(cid).agg(F.count(F.lit(1)).alias("n")).orderBy("n", cid)


def imbalance(assigned: DataFrame, cid: str = "cid", kind: str = "coded") -> DataFrame:
    """A6-A8 in one pass over the size table (k rows, so the global mean
    window is bounded): ``(k, mean_size, imbalance, n_points)``.

    ``kind="coded"``: ``sum((mu - n_c)^2) / n_points`` as the reference
    computes its "stdDev" (no root, divided by points); ``"stddev"``:
    population standard deviation of the sizes.
    """
    sizes = assigned.groupBy(cid).agg(F.count(F.lit(1)).alias("n"))
    mu = F.avg("n").over(Window.partitionBy(F.lit(1)))
    s = sizes.withColumn("mu", mu)
    if kind == "coded":
        val = F.sum((F.col("mu") - F.col("n")) * (F.col("mu") - F.col("n"))) / F.sum("n")
    elif kind == "stddev":
        val = F.stddev_pop("n")
    else:
        raise ValueError("kind must be 'coded' or 'stddev'")
    return s.agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean_size"),
                 val.alias("imbalance"), F.sum("n").alias("n_points"))


def cluster_members(assigned: DataFrame, cid: int, col: str = "cid") -> DataFrame:
    """The points of one cluster (an equality filter on the id)."""
    return assigned.where(F.col(col) == F.lit(int(cid)))


def _size_bounds(sizes: DataFrame, tolerance: float) -> DataFrame:
    # k rows: the global windows below see the size table only
    w = Window.partitionBy(F.lit(1))
    mu = F.avg("n").over(w)
    s = F.sum((mu - F.col("n")) * (mu - F.col("n"))).over(w) / F.sum("n").over(w)
    return sizes.withColumn("mu", mu).withColumn("s", s).withColumn("_tol", F.lit(float(tolerance)))


def oversized(sizes: DataFrame, tolerance: float) -> DataFrame:
    """Clusters with ``n > mu + s*tolerance`` (s = the A7 imbalance),
    largest first."""
    b = _size_bounds(sizes, tolerance)
    return (b.where(F.col("n") > F.col("mu") + F.col("s") * F.col("_tol"))
            .orderBy(F.col("n").desc(), "cid").drop("_tol"))


def undersized(sizes: DataFrame, tolerance: float) -> DataFrame:
    """Clusters with ``n < mu - s*tolerance``, smallest first."""
    b = _size_bounds(sizes, tolerance)
    return b.where(F.col("n") < F.col("mu") - F.col("s") * F.col("_tol")).orderBy("n", "cid").drop("_tol")


def clustering_cost(points: DataFrame, centers: Sequence[Center], x: str = "x", y: str = "y") -> DataFrame:
    """A10: ``(cost, cost_distance, n)``: sum of squared distances to the
    nearest centre and ``sqrt(cost / n)``."""
    a = points.select(nearest_expr(centers, x, y)["d2"].alias("d2"))
    return a.agg(F.sum("d2").alias("cost"), F.sqrt(F.sum("d2") / F.count(F.lit(1))).alias("cost_distance"),
                 F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- Lloyd (M6)

def same_centers(new: Sequence[Center], old: Sequence[Center], tol: float = 0.0) -> bool:
    """Every new centre lies within ``tol`` of some old centre
    (containment, not order; ``tol=0`` is the reference's exact test)."""
    have = np.array([(x, y) for _, x, y in old], dtype=float).reshape(-1, 2)
    return all(bool((np.abs(have - (x, y)) <= tol).all(axis=1).any()) for _, x, y in new)


@dataclass
class LloydResult:
    centers: list[Center]
    iterations: int
    converged: bool
    history: list[list[Center]] = field(default_factory=list)
    sizes: dict[int, int] = field(default_factory=dict)
    #: with bounds: comparisons of points with centres and boxes, per pass
    tests: list[int] = field(default_factory=list)


def lloyd_pass(points: DataFrame, centers: Sequence[Center],
               on_empty: str = "keep") -> tuple[list[Center], dict[int, int]]:
    """One Lloyd pass: assign, average per cluster; only k rows reach the
    driver.  Returns the new centres and the cluster sizes of the
    assignment to the OLD centres."""
    if on_empty not in ("keep", "drop"):
        raise ValueError("on_empty must be 'keep' or 'drop'")
    agg = centroids(assign_nearest(points, centers)).collect()
    got = {int(r["cid"]): (float(r["x"]), float(r["y"])) for r in agg}
    sizes = {int(r["cid"]): int(r["n"]) for r in agg}
    out = []
    for c, x, y in centers:
        if c in got:
            out.append((c, *got[c]))
        elif on_empty == "keep":
            out.append((c, x, y))
    return out, sizes


def lloyd_step(points: DataFrame, centers: Sequence[Center], on_empty: str = "keep") -> list[Center]:
    return lloyd_pass(points, centers, on_empty)[0]


def lloyd(points: DataFrame, init: Sequence[Center], max_iter: int = 20, tol: float = 0.0,
          on_empty: str = "keep", persist: bool = True, method: str | None = None) -> LloydResult:
    """M6: plain Lloyd from given centres until the centre set repeats
    (within ``tol``) or ``max_iter`` passes.  Ids stay attached to centres.
    ``sizes`` are those of the last assignment.

    ``method="plain"`` assigns every point anew in each pass, ``"bounds"``
    keeps bounds with the points, so most points are compared with no centre
    or one (:func:`trailframe.operators.center_tree.bounded_lloyd`); the
    number of centres decides where none is given."""
    if method not in (None, "plain", "bounds"):
        raise ValueError("method must be 'plain' or 'bounds'")
    if on_empty not in ("keep", "drop"):
        raise ValueError("on_empty must be 'keep' or 'drop'")
    if method == "bounds" or (method is None and len(init) >= TREE_FROM):
        hist, sizes, converged, tests = bounded_lloyd(
            points, init, max_iter, lambda new, old: same_centers(new, old, tol), on_empty)
        return LloydResult(hist[-1], len(hist) - 1, converged, hist, sizes, tests)
    pts = points.select("x", "y")
    if persist:
        pts = pts.persist()
    centers = list(init)
    hist = [centers]
    converged = False
    it = 0
    sizes: dict[int, int] = {}
    try:
        for it in range(1, max_iter + 1):
            new, sizes = lloyd_pass(pts, centers, on_empty)
            hist.append(new)
            if same_centers(new, centers, tol):
                converged = True
                centers = new
                break
            centers = new
    finally:
        if persist:
            pts.unpersist()
    return LloydResult(centers, it, converged, hist, sizes)


def initial_centers(points: DataFrame, k: int, seed: int, key: str = "id") -> list[Center]:
    rows = random_rows(points.select(key, "x", "y"), k, seed, key).collect()
    return [(i, float(r["x"]), float(r["y"])) for i, r in enumerate(rows)]


# ---------------------------------------------------- per-frame Lloyd (M7)

def frame_initial_centers(points: DataFrame, k: int, seed: int, frame: str = "frame",
                          key: str = "slot") -> DataFrame:
    """k hash-picked points per frame as ``(frame, cid, x, y)``.  The rank
    filter is a window group limit: each map task keeps its own top k per
    frame before the shuffle, so a hot frame ships k rows per task."""
    w = Window.partitionBy(frame).orderBy(hash_order(key, seed), F.col(key))
    return (points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .select(frame, (F.col("_rn") - 1).cast("int").alias("cid"), "x", "y"))


def frame_assign(points: DataFrame, centers: DataFrame, on: Sequence[str] = ("frame",)) -> DataFrame:
    """J3 per frame: join each point to its frame's array of centres
    ``(<on>, _c)``; whether that is broadcast is the planner's decision."""
    xc, yc = F.col("x"), F.col("y")
    best = F.array_min(F.transform("_c", lambda c: F.struct(
        _d2(xc, yc, c["cx"], c["cy"]).alias("d2"), c["cid"].alias("cid"))))
    # cid is not nullable, so no null test (a second argmin) is inferred from it
    return (points.join(centers, list(on)).withColumn("_b", best)
            .withColumn("cid", F.coalesce(F.col("_b.cid"), F.lit(-1)))
            .withColumn("d2", F.col("_b.d2")).drop("_b", "_c"))


def center_arrays(centers: DataFrame, frame: str = "frame") -> DataFrame:
    """One array of k centres per frame: ``(frame, _c)``."""
    return centers.groupBy(frame).agg(F.collect_list(F.struct("cid", F.col("x").alias("cx"),
                                                              F.col("y").alias("cy"))).alias("_c"))


def _dealt_points(points: DataFrame, frame: str, key: str, rows_per_part: int) -> tuple[DataFrame, DataFrame]:
    """The points partitioned by ``(frame, _salt)`` and the number of salts
    of every frame: a frame of more than ``rows_per_part`` points is cut
    into as many parts as it needs, whatever share of all rows it holds."""
    salts = cut_lineage(points.groupBy(frame).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(int(rows_per_part))).cast("int").alias("_salts")))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (points.join(salts, frame)
             .withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_salts")).cast("int")).drop("_salts")
             .repartition(parts, frame, "_salt"))
    return dealt.persist(), salts


def frame_lloyd_step(dealt: DataFrame, salts: DataFrame, centers: DataFrame, frame: str = "frame",
                     on_empty: str = "keep") -> DataFrame:
    """One pass over the dealt points.  The centre arrays go to the points'
    partitions; sums are taken there per (frame, salt, cid), and only these
    are shuffled."""
    arrays = (center_arrays(centers, frame).join(salts, frame)
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts"))
    a = frame_assign(dealt, arrays, (frame, "_salt"))
    part = a.groupBy(frame, "_salt", "cid").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                                                F.count(F.lit(1)).alias("n"))
    agg = part.groupBy(frame, "cid").agg((F.sum("sx") / F.sum("n")).alias("nx"),
                                         (F.sum("sy") / F.sum("n")).alias("ny"))
    if on_empty == "drop":
        return agg.select(frame, "cid", F.col("nx").alias("x"), F.col("ny").alias("y"))
    return (centers.join(agg, [frame, "cid"], "left")
            .select(frame, "cid", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y")))


def _lloyd_numpy(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, passes: int, tol: float | None,
                 on_empty: str):
    """Lloyd passes over one frame's points: ``(ids, x, y, moved)`` of the
    centres, ids being places in the arrays given.  Ends at ``passes``, when
    a pass changes nothing, or, with ``tol``, when no centre moved further.

    A point is compared with the centres again only once they have moved far
    enough, all passes since taken together, to change which one is nearest."""
    ids = np.arange(cx.size)
    moved = np.ones(cx.size, dtype=bool)
    rows = max(1, (1 << 22) // max(1, cx.size))
    near = np.zeros(x.size, dtype=np.int64)
    # the drift at which a point has to be looked at again
    due = np.full(x.size, -np.inf)
    drift = 0.0
    slack = 1e-9 * max([1.0, *(np.abs(v).max() for v in (x, y) if v.size)])
    for _ in range(passes):
        late = np.flatnonzero(~(due > drift))
        for a in range(0, late.size, rows):
            at = late[a:a + rows]
            dx, dy = x[at][:, None] - cx, y[at][:, None] - cy
            d = dx * dx + dy * dy
            best = d.argmin(axis=1)  # ties: the lowest id
            row = np.arange(at.size)
            least = d[row, best]
            d[row, best] = np.inf
            near[at] = best
            due[at] = drift + (np.sqrt(d.min(axis=1)) - np.sqrt(least)) / 2 - slack
        n, sx, sy = (np.zeros(ids.size) for _ in range(3))
        for a in range(0, x.size, rows):
            here = near[a:a + rows]
            n += np.bincount(here, minlength=ids.size)
            sx += np.bincount(here, weights=x[a:a + rows], minlength=ids.size)
            sy += np.bincount(here, weights=y[a:a + rows], minlength=ids.size)
        full = n > 0
        if on_empty == "drop" and not full.all():
            ids, cx, cy, n, sx, sy = (v[full] for v in (ids, cx, cy, n, sx, sy))
            full = n > 0
            due[:] = -np.inf
        nx, ny = np.where(full, sx / np.maximum(n, 1), cx), np.where(full, sy / np.maximum(n, 1), cy)
        far = np.maximum(np.abs(nx - cx), np.abs(ny - cy))
        moved = far > (tol or 0.0)
        drift += np.hypot(nx - cx, ny - cy).max(initial=0.0)
        cx, cy = nx, ny
        if not moved.any() and (tol is not None or not far.any()):
            break
    return ids, cx, cy, moved


def _lloyd_many(x: np.ndarray, y: np.ndarray, start: np.ndarray, k: int, passes: int, tol: float | None,
                on_empty: str):
    """:func:`_lloyd_numpy` over many small frames side by side, which lie at
    ``start[f]:start[f + 1]``, their first ``k`` points being the first
    centres: ``(frame place, id, x, y, moved)`` of the centres."""
    size = np.diff(start)
    m = size.size
    here = np.arange(k) < size[:, None]  # centres that a frame has
    first = np.minimum(start[:-1, None] + np.arange(k), max(0, x.size - 1))
    cx, cy = (np.where(here, v[first], np.inf) for v in (x, y))
    moved = here.copy()
    frames = np.arange(m)  # those that still move
    of = np.repeat(frames, size)
    for _ in range(passes):
        if not frames.size:
            break
        ax, ay, alive = cx[frames], cy[frames], here[frames]
        dx, dy = x[:, None] - ax[of], y[:, None] - ay[of]
        cell = of * k + (dx * dx + dy * dy).argmin(axis=1)  # ties: the lowest id
        n, sx, sy = (np.bincount(cell, weights=w, minlength=frames.size * k).reshape(-1, k) for w in (None, x, y))
        if on_empty == "drop":
            alive = n > 0
        hit = n > 0
        nx, ny = (np.where(hit, s / np.maximum(n, 1), np.where(alive, c, np.inf)) for s, c in ((sx, ax), (sy, ay)))
        far = np.zeros(nx.shape)
        far[alive] = np.maximum(np.abs(nx[alive] - ax[alive]), np.abs(ny[alive] - ay[alive]))
        step = alive & (far > (tol or 0.0))
        cx[frames], cy[frames], here[frames], moved[frames] = nx, ny, alive, step
        go = step.any(axis=1)
        if not go.all():
            place = np.cumsum(go) - 1
            stay = go[of]
            x, y, of, frames = x[stay], y[stay], place[of[stay]], frames[go]
    f, c = np.nonzero(here)
    return f, c, cx[f, c], cy[f, c], moved[f, c]


#: a frame of more points is iterated by itself
SMALL_FRAME = 1 << 10


def _whole_frames(points: DataFrame, k: int, passes: int, seed: int, frame: str, key: str, on_empty: str,
                  tol: float | None) -> DataFrame:
    """M7 for frames that fit a task: all passes of a frame in one task, which
    reads its frames one after the other; small ones go side by side."""
    kind = points.schema[frame].dataType
    schema = T.StructType([T.StructField(frame, kind), T.StructField("cid", T.IntegerType()),
                           T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
                           T.StructField("_moved", T.BooleanType())])

    def solved(of: pa.Array, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(start)
        plain = (np.logical_and.reduceat(np.isfinite(x) & np.isfinite(y), start[:-1]) & (size <= SMALL_FRAME))
        found = [(np.full(c.size, f), c, cx, cy, moved) for f in np.flatnonzero(~plain)
                 for a, b in [start[f:f + 2]]
                 for c, cx, cy, moved in [_lloyd_numpy(x[a:b], y[a:b], x[a:b][:k], y[a:b][:k], passes, tol, on_empty)]]
        if plain.any():
            rows = np.repeat(plain, size)
            f, *rest = _lloyd_many(x[rows], y[rows], np.concatenate(([0], np.cumsum(size[plain]))), k, passes, tol, on_empty)
            found.append((np.flatnonzero(plain)[f], *rest))
        f, c, cx, cy, moved = (np.concatenate(v) for v in zip(*found))
        names = of.take(pa.array(start[:-1][f]))
        yield pa.RecordBatch.from_arrays([names, pa.array(c, pa.int32()), pa.array(cx), pa.array(cy), pa.array(moved)],
                                         names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the last frame, which may go on

        def joined(parts):
            ofs, xs, ys = zip(*parts)
            return pa.concat_arrays(ofs), np.concatenate(xs), np.concatenate(ys)

        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0)
            x, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
            new = np.flatnonzero(pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)) + 1
            if held and held[-1][0][-1] != of[0]:
                new = np.concatenate(([0], new))
            if not new.size:
                held.append((of, x, y))
                continue
            end = int(new[-1])
            before = sum(len(h[0]) for h in held)
            done = joined([*held, (of[:end], x[:end], y[:end])])
            start = np.concatenate(([0], new + before))
            held = [(of[end:], x[end:], y[end:])]
            yield from solved(*done, start)
        if held:
            done = joined(held)
            yield from solved(*done, np.array([0, len(done[1])]))

    rows = points.select(frame, key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
                         hash_order(key, seed).alias("_h"))
    return (rows.repartition(frame).sortWithinPartitions(frame, F.asc_nulls_last("_h"), F.asc_nulls_last(key))
            .select(frame, "x", "y").mapInArrow(run, schema))


def _cut_frames(points: DataFrame, k: int, passes: int, seed: int, frame: str, key: str, on_empty: str,
                tol: float | None, rows_per_part: int) -> DataFrame:
    """M7 for frames of any size, cut over many tasks, as a delta iteration:
    the centre table holds the frames that still move; a frame that has
    settled leaves it, and once half of the frames have settled the points
    left are dealt anew without theirs."""
    limit = 0.0 if tol is None else float(tol)
    pts, salts = _dealt_points(points, frame, key, rows_per_part)
    done: list[DataFrame] = []
    try:
        active = cut_lineage(frame_initial_centers(pts, k, seed, frame, key).withColumn("_moved", F.lit(True)))
        dealt = left = active.select(frame).distinct().count()
        for _ in range(passes):
            if not left:
                break
            old = active.drop("_moved")
            new = frame_lloyd_step(pts, salts, old, frame, on_empty)
            o = old.select(frame, "cid", F.col("x").alias("ox"), F.col("y").alias("oy"))
            moved = cut_lineage(new.join(o, [frame, "cid"]).select(
                frame, "cid", "x", "y",
                (F.greatest(F.abs(F.col("x") - F.col("ox")), F.abs(F.col("y") - F.col("oy")))
                 > F.lit(limit)).alias("_moved")))
            open_ = moved.where("_moved").select(frame).distinct()
            active = cut_lineage(moved.join(open_, frame, "left_semi"))
            done.append(moved.join(open_, frame, "left_anti"))
            left = active.select(frame).distinct().count()
            if left and 2 * left <= dealt:
                rest = cut_lineage(pts.drop("_salt").join(active.select(frame).distinct(), frame, "left_semi"))
                pts.unpersist()
                pts, salts = _dealt_points(rest, frame, key, rows_per_part)
                dealt = left
    finally:
        pts.unpersist()
    out = active
    for d in done:
        out = out.unionByName(d)
    return out


def frame_kmeans(points: DataFrame, k: int = 20, passes: int = 20, seed: int = 7,
                 frame: str = "frame", key: str = "slot", on_empty: str = "keep",
                 tol: float | None = None, rows_per_part: int = 1 << 22,
                 with_flag: bool = False, settle: bool = False) -> DataFrame:
    """M7: one k-means per frame.

    Returns ``(frame, cid, x, y)`` after at most ``passes`` Lloyd passes from
    hash-picked initial centres.  With ``tol`` the passes of a frame end once
    none of its centres moved more than ``tol`` in x or y; ``with_flag`` adds
    ``converged``, true for a frame whose last pass stayed within ``tol``
    (0 if not given).  With ``settle`` (which needs ``tol``) ``passes`` is a
    bound that raises when centres still move, it never cuts.

    A frame of at most ``rows_per_part`` points takes all its passes in one
    task (some 60 bytes a point); larger frames are cut over tasks and iterated
    together, each until it has settled.  Rows without a frame or a position are left
    out.
    """
    if settle and tol is None:
        raise ValueError("settle needs tol")
    if on_empty not in ("keep", "drop"):
        raise ValueError("on_empty must be 'keep' or 'drop'")
    # read by the count and by the passes: what it takes to get the points is done once
    points = materialize(points.select(frame, key, "x", "y").na.drop("any", subset=[frame, "x", "y"]), "frame-points")
    large = cut_lineage(points.groupBy(frame).count().where(F.col("count") > int(rows_per_part)).select(frame))
    some = not large.isEmpty()
    whole = points.join(large, frame, "left_anti") if some else points
    centers = _whole_frames(whole, k, passes, seed, frame, key, on_empty, tol)
    if some:
        centers = centers.unionByName(_cut_frames(points.join(large, frame, "left_semi"), k, passes, seed, frame, key,
                                                  on_empty, tol, rows_per_part))
    centers = cut_lineage(centers)
    if settle and not centers.where("_moved").isEmpty():
        raise RuntimeError(f"frame k-means did not settle in {passes} passes")
    if not with_flag:
        return centers.drop("_moved")
    flag = centers.groupBy(frame).agg((~F.max("_moved")).alias("converged"))
    return centers.drop("_moved").join(flag, frame)


# ------------------------------------------------ similar-size k-means (M8)

@dataclass
class BalancedResult:
    centers: list[Center]
    sizes: dict[int, int]
    imbalance: float
    rounds: int
    converged: bool


def _sizes(points: DataFrame, centers: Sequence[Center]) -> dict[int, int]:
    rows = assign_nearest(points, centers).groupBy("cid").count().collect()
    return {int(r["cid"]): int(r["count"]) for r in rows}


def _imbalance_of(sizes: dict[int, int]) -> tuple[float, float]:
    ns = list(sizes.values())
    mu = sum(ns) / len(ns)
    return mu, sum((mu - n) ** 2 for n in ns) / sum(ns)


def split_oversized(points: DataFrame, centers: Sequence[Center], sizes: dict[int, int],
                    tolerance: float, seed: int, victim: str = "smallest", key: str = "id",
                    assigned_by: Sequence[Center] | None = None) -> list[Center]:
    """Move centres onto hash-picked members of oversized clusters.

    Oversized: ``n > mu + s*tolerance``, ranked by (size desc, cid).
    ``victim="smallest"``: the other clusters ranked by (size asc, cid) give
    up their centres, rank for rank.  ``"first"`` (as coded): the centres at
    the first positions of the centre list are overwritten.  Members are
    taken from the assignment to ``assigned_by`` (default ``centers``), the
    one the sizes were counted on.
    """
    mu, s = _imbalance_of(sizes)
    donors = sorted([c for c, n in sizes.items() if n > mu + s * tolerance], key=lambda c: (-sizes[c], c))
    if not donors:
        return list(centers)
    if victim == "smallest":
        others = sorted([c for c, _, _ in centers if c not in donors], key=lambda c: (sizes.get(c, 0), c))
    elif victim == "first":
        others = [c for c, _, _ in centers]
    else:
        raise ValueError("victim must be 'smallest' or 'first'")
    pairs = list(zip(others, donors))
    donor_ids = [d for _, d in pairs]
    assigned = assign_nearest(points, assigned_by or centers).where(F.col("cid").isin(donor_ids))
    picks = {int(r["cid"]): (float(r["x"]), float(r["y"]))
             for r in random_member(assigned, seed, key=key).collect()}
    moved = dict(pairs)
    out = []
    for c, x, y in centers:
        if c in moved and moved[c] in picks:
            out.append((c, *picks[moved[c]]))
        else:
            out.append((c, x, y))
    return out


def similar_size_round(points: DataFrame, init: Sequence[Center], passes: int, tolerance: float,
                       seed: int, victim: str = "smallest", on_empty: str = "keep") -> list[Center]:
    """One round of M8 with a fixed number of Lloyd passes (testable unit)."""
    centers = list(init)
    prev = centers
    for _ in range(passes):
        prev = centers
        centers = lloyd_step(points, centers, on_empty)
    sizes = _sizes(points, prev)
    return split_oversized(points, centers, sizes, tolerance, seed, victim, assigned_by=prev)


def similar_size_kmeans(points: DataFrame, k: int = 20, breakpoint: float = 2.0, tolerance: float = 1.0,
                        seed: int = 7, max_rounds: int = 20, max_iter: int = 50, tol: float = 0.0,
                        victim: str = "smallest", on_empty: str = "keep", key: str = "id") -> BalancedResult:
    """M8: Lloyd, then while the size imbalance is at least ``breakpoint``
    move centres from small clusters onto members of oversized ones and run
    Lloyd again.  Bounded by ``max_rounds``; stops early when no cluster is
    oversized (the reference would loop forever there)."""
    pts = points.select(key, "x", "y").persist()
    try:
        centers = initial_centers(pts, k, seed, key)
        rounds = 0
        converged = False
        sizes: dict[int, int] = {}
        s = math.inf
        for rounds in range(1, max_rounds + 1):
            res = lloyd(pts, centers, max_iter=max_iter, tol=tol, on_empty=on_empty, persist=False)
            centers = res.centers
            # at convergence the last assignment is the one to the final centres
            sizes = res.sizes if res.converged and tol == 0.0 else _sizes(pts, centers)
            _, s = _imbalance_of(sizes)
            if s < breakpoint:
                converged = True
                break
            if rounds == max_rounds:
                break  # the result is always a clustering that Lloyd has settled
            moved = split_oversized(pts, centers, sizes, tolerance, seed + rounds, victim, key)
            if moved == centers:
                break
            centers = moved
    finally:
        pts.unpersist()
    return BalancedResult(centers, sizes, s, rounds, converged)


# --------------------------------------------------- pyspark.ml

def kmeans(df: DataFrame, k: int, seed: int = 1, cols: Sequence[str] = ("x", "y"),
           max_iter: int = 20, tol: float = 1e-4, init_mode: str = "k-means||"):
    """M5: ``pyspark.ml`` k-means on the assembled columns (seeded)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, initMode=init_mode,
                   featuresCol="features", predictionCol="prediction").fit(data)
    return model


def cluster_assign(model, df: DataFrame, cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """M9: ``model.transform`` on the assembled columns."""
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    return model.transform(data).drop("features")


def is_nearest(model, cols: Sequence[str], prediction: str = "prediction", eps: float = 1e-6) -> Column:
    """Whether the assigned centre is a nearest one (within ``eps`` of the
    least squared distance); a check on M9 that needs no second model."""
    text = json.dumps([[float(v) for v in c] for c in model.clusterCenters()])
    point = F.array(*[F.col(c).cast("double") for c in cols])
    d2 = F.transform(F.from_json(F.lit(text), "array<array<double>>"), lambda c: F.aggregate(
        F.zip_with(point, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return F.transform(F.array(d2), lambda d: d[F.col(prediction)] <= F.array_min(d) + F.lit(float(eps)))[0]


def cluster_centers(model, spark) -> DataFrame:
    """The fitted centres as ``(cid, c0, c1, ...)`` (may be fewer than k)."""
    cs = model.clusterCenters()
    rows = [(i, *[float(v) for v in c]) for i, c in enumerate(cs)]
    dim = len(cs[0]) if cs else 0
    return spark.createDataFrame(rows, ["cid"] + [f"c{j}" for j in range(dim)])
