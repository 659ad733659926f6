"""Nearest centre among thousands, and Lloyd passes that skip most of it.

* :class:`CenterTree` splits the centres at medians into leaves of a few and
  keeps the box of every node.  A block of points first meets the leaf each
  of them falls into, then walks the tree once; a node sees only the points
  for which its box is not farther than the best centre so far.  Results are
  those of comparing with every centre, ties to the lowest id.
* :func:`bounded_lloyd` keeps, with every point, its centre, an upper bound
  of the distance to it and a lower bound of the distance to any other.
  Centres that move by ``m`` change both by at most ``m``, so the bounds are
  stored as of the pass that wrote them and compared with how far the centres
  have moved since: the table of points is read by every pass, but written
  again only after a pass in which many bounds no longer decided.

A tree holds k rows; k is a parameter of the clustering, not of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.session import materialize, ship_package

Center = tuple[int, float, float]

NO_ID = np.iinfo(np.int64).max
#: slack of a comparison of bounds, as a share of the numbers compared
SLACK = 1e-9


class CenterTree:
    """Exact nearest centres of blocks of points."""

    def __init__(self, centers: Sequence[Center], leaf: int = 8):
        if not len(centers):
            raise ValueError("no centres")
        rows = sorted((int(c), float(x), float(y)) for c, x, y in centers)
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.xy = np.array([r[1:] for r in rows], dtype=np.float64)
        #: per node: members, lower and upper corner, axis, cut, two children
        self.nodes: list[tuple] = []
        self._split(np.arange(len(rows)), max(1, int(leaf)))

    def _split(self, members: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        pts = self.xy[members]
        lo, hi = pts.min(axis=0), pts.max(axis=0)
        axis = int(np.argmax(hi - lo))
        if len(members) <= leaf or lo[axis] == hi[axis]:
            self.nodes[at] = (members, lo, hi, axis, 0.0, None)
            return at
        cut = np.partition(pts[:, axis], len(members) // 2)[len(members) // 2]
        left = pts[:, axis] < cut
        if not left.any():
            left = pts[:, axis] <= cut
        children = self._split(members[left], leaf), self._split(members[~left], leaf)
        self.nodes[at] = (members, lo, hi, axis, float(pts[~left, axis].min()), children)
        return at

    def nearest(self, x: np.ndarray, y: np.ndarray, second: bool = False):
        """``(d2, cid, other, tests)`` per point: the least squared distance,
        the lowest id at it, the squared distance of the nearest other centre
        (only with ``second``; infinite for a single one) and how many
        centres and boxes the point was compared with.  A coordinate that is
        NaN gives NaN and the lowest id."""
        n = len(x)
        best, other = np.full(n, np.inf), np.full(n, np.inf)
        cid = np.full(n, NO_ID, dtype=np.int64)
        tests, home = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        limit = other if second else best

        def meet(at: int, idx: np.ndarray) -> None:
            members = self.nodes[at][0]
            dx = x[idx, None] - self.xy[members, 0]
            dy = y[idx, None] - self.xy[members, 1]
            d2 = dx * dx + dy * dy
            tests[idx] += len(members)
            place = d2.argmin(axis=1)
            least = d2[np.arange(len(idx)), place]
            ids = self.ids[members][place]
            if second:
                d2[np.arange(len(idx)), place] = np.inf
                other[idx] = np.minimum(np.minimum(other[idx], d2.min(axis=1)), np.maximum(best[idx], least))
            closer = (least < best[idx]) | ((least == best[idx]) & (ids < cid[idx]))
            best[idx[closer]], cid[idx[closer]] = least[closer], ids[closer]

        def settle(at: int, idx: np.ndarray) -> None:
            _, _, _, axis, cut, children = self.nodes[at]
            if not len(idx):
                return
            if children is None:
                home[idx] = at
                meet(at, idx)
                return
            right = (x if axis == 0 else y)[idx] >= cut
            settle(children[0], idx[~right])
            settle(children[1], idx[right])

        def walk(at: int, idx: np.ndarray) -> None:
            members, lo, hi, _, _, children = self.nodes[at]
            if children is None:
                idx = idx[home[idx] != at]
            dx = np.maximum(np.maximum(lo[0] - x[idx], x[idx] - hi[0]), 0.0)
            dy = np.maximum(np.maximum(lo[1] - y[idx], y[idx] - hi[1]), 0.0)
            tests[idx] += 1
            idx = idx[dx * dx + dy * dy <= limit[idx]]
            if not len(idx):
                return
            if children is None:
                meet(at, idx)
            else:
                for child in children:
                    walk(child, idx)

        bad = np.isnan(x) | np.isnan(y)
        idx = np.nonzero(~bad)[0]
        settle(0, idx)
        walk(0, idx)
        best[bad], other[bad], cid[bad] = np.nan, np.nan, self.ids[0]
        return best, cid, other, tests


def nearest_udf(centers: Sequence[Center]) -> Callable[[Column, Column], Column]:
    """``struct(d2, cid)`` of the nearest centre of two coordinate columns;
    only these two columns travel to Python."""
    tree = CenterTree(centers)

    @F.arrow_udf("d2 double, cid int")
    def nearest(x: pa.Array, y: pa.Array) -> pa.Array:
        d2, cid, _, _ = tree.nearest(*(a.cast(pa.float64()).to_numpy(zero_copy_only=False) for a in (x, y)))
        return pa.StructArray.from_arrays([pa.array(d2), pa.array(cid.astype(np.int32))], ["d2", "cid"])

    return nearest


# ------------------------------------------------------------- bounded passes

STATE = "x double, y double, cid int, upper double, lower double, tests int"
PARTIAL = "cid int, n long, sx double, sy double, tests long, searched long"


class Pass:
    """What a task needs for one pass: the centres, their tree, half the
    distance of each to its nearest neighbour, and how far they have moved
    since the first pass: each of them, and the farthest mover of every pass."""

    def __init__(self, centers: Sequence[Center], moved: dict[int, float], farthest: float):
        self.tree = CenterTree(centers)
        ids, xy = self.tree.ids, self.tree.xy
        _, _, other, _ = self.tree.nearest(xy[:, 0], xy[:, 1], second=True)
        self.half = np.sqrt(other) / 2
        self.moved = np.array([moved[int(c)] for c in ids])
        self.farthest = farthest

    def step(self, x, y, cid, upper, lower):
        """New ``(cid, upper, lower, tests, searched)`` of a block; a point
        whose centre is not there (none yet, or dropped) is searched."""
        ids = self.tree.ids
        at = np.minimum(np.searchsorted(ids, cid), len(ids) - 1)
        known = ids[at] == cid
        up = np.where(known, upper + self.moved[at], np.inf)
        low = lower - self.farthest
        tests = np.zeros(len(x), dtype=np.int64)

        def decided(u, lo):
            slack = SLACK * (np.abs(u) + np.abs(lower) + self.farthest)
            return u + slack < np.maximum(lo, self.half[at])

        with np.errstate(invalid="ignore"):
            open_ = np.nonzero(~(known & decided(up, low)))[0]
            near = open_[known[open_]]
            dx, dy = x[near] - self.tree.xy[at[near], 0], y[near] - self.tree.xy[at[near], 1]
            up[near] = np.sqrt(dx * dx + dy * dy)
            tests[near] += 1
            left = open_[~(known[open_] & decided(up, low)[open_])]
        cid = cid.copy()
        if len(left):
            d2, found, other, n = self.tree.nearest(x[left], y[left], second=True)
            cid[left], up[left], low[left] = found, np.sqrt(d2), np.sqrt(other)
            tests[left] += n
            at = np.minimum(np.searchsorted(ids, cid), len(ids) - 1)
        searched = np.zeros(len(x), dtype=bool)
        searched[left] = True
        return cid, up - self.moved[at], low + self.farthest, tests, searched


def _columns(batch: pa.RecordBatch):
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


def _rewrite(step: Pass):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, *state = _columns(batch)
            cid, up, low, tests, _ = step.step(x, y, *state)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x), pa.array(y), pa.array(cid.astype(np.int32)), pa.array(up), pa.array(low),
                 pa.array(tests.astype(np.int32))], ["x", "y", "cid", "upper", "lower", "tests"])
    return run


def _sums(step: Pass):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = step.tree.ids
        n, sx, sy, tests, searched = (np.zeros(len(ids)) for _ in range(5))
        for batch in batches:
            x, y, *state = _columns(batch)
            cid, _, _, t, s = step.step(x, y, *state)
            at = np.searchsorted(ids, cid)
            for total, weights in ((n, None), (sx, x), (sy, y), (tests, t), (searched, s)):
                total += np.bincount(at, weights=weights, minlength=len(ids))
        some = n > 0
        longs = [pa.array(a[some].astype(np.int64)) for a in (n, tests, searched)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[some].astype(np.int32)), longs[0], pa.array(sx[some]), pa.array(sy[some]), *longs[1:]],
            ["cid", "n", "sx", "sy", "tests", "searched"])
    return run


def bounded_lloyd(points: DataFrame, init: Sequence[Center], max_iter: int, stop: Callable[[list, list], bool],
                  on_empty: str = "keep", rewrite: float = 0.1):
    """Lloyd passes with bounds: ``(history, sizes, converged, tests)``, the
    last one being the comparisons of each pass with a centre or a box.

    The centres are those of plain passes, up to the order of the sums.
    Points with a coordinate that is NULL or NaN belong to no cluster.  The
    state is one row per point under the checkpoint folder; it is written by
    the first pass, and by a pass that follows one in which more than the
    share ``rewrite`` of the points had to be searched.  An empty table keeps
    its centres (or, with ``on_empty="drop"``, loses them all)."""
    ship_package(points.sparkSession)
    x, y = (F.col(c).cast("double") for c in ("x", "y"))
    # no centre yet: an id that none of them has
    unused = min(int(c) for c, _, _ in init) - 1
    state = (points.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
             .where("not isnan(x) and not isnan(y)")
             .withColumns({"cid": F.lit(unused).cast("int"), "upper": F.lit(0.0), "lower": F.lit(0.0)}))
    centers = [(int(c), float(px), float(py)) for c, px, py in init]
    moved, farthest = {c: 0.0 for c, _, _ in centers}, 0.0
    history, tested = [centers], []
    sizes: dict[int, int] = {}
    write, converged = True, False
    for _ in range(max_iter):
        step = Pass(centers, moved, farthest)
        cols = state.select("x", "y", "cid", "upper", "lower")
        if write:
            state = materialize(cols.mapInArrow(_rewrite(step), STATE), "bounds")
            parts = state.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                                             F.sum("tests").alias("tests"), F.count_if(F.col("tests") > 1).alias("searched"))
        else:
            parts = cols.mapInArrow(_sums(step), PARTIAL).groupBy("cid").agg(
                *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "tests", "searched")])
        got = {r["cid"]: r for r in parts.collect()}
        sizes = {c: int(r["n"]) for c, r in got.items()}
        tested.append(sum(int(r["tests"]) for r in got.values()))
        write = sum(int(r["searched"]) for r in got.values()) > rewrite * sum(sizes.values())
        new = []
        for c, px, py in centers:
            if c in got:
                new.append((c, got[c]["sx"] / got[c]["n"], got[c]["sy"] / got[c]["n"]))
            elif on_empty == "keep":
                new.append((c, px, py))
        before = {c: (px, py) for c, px, py in centers}
        by = {c: float(np.hypot(px - before[c][0], py - before[c][1])) for c, px, py in new}
        moved = {c: moved[c] + d for c, d in by.items()}
        farthest += max(by.values(), default=0.0)
        history.append(new)
        done, centers = stop(new, centers), new
        if done:
            converged = True
            break
        if not centers:
            break
    return history, sizes, converged, tested
