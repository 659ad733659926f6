"""Nearest point of the next frame through an adaptive cell tree (J1 where
detections are dense).

The grid join of :func:`trailframe.operators.matching.match_next_frame`
pairs every two points of neighbouring cells, which is quadratic in the
points within one radius.  Here

* the candidates of every frame stand in a tree of square cells.  Its root is
  the frame; a cell that holds more than ``block`` distinct points is split
  into 4 x 4, as the counts say, so only dense places get deep.  Every cell
  carries the bounding box of its points.  The tables of the tree hold cells,
  about one for some thousand points, never points;
* a query point goes down the tree to the cell with the nearest box, its home,
  and is compared with the candidates there.  Where the circle of the distance
  found lies inside the home cell, that is the answer;
* the others, those near an edge, go down once more, to every cell whose box
  is not beyond the distance found, and are compared there.

A comparison is one shuffle that brings the candidates of a cell and its query
points together; a cell with many query points is dealt over several tasks.
The task keeps one cell's candidates, split by medians into boxes of at most
``leaf`` points, and streams the query points past them.  Points are written
and shuffled a fixed number of times, however deep the tree gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.session import materialize, ship_package

#: levels below the root; the finest cell is the extent / 4**MAX_LEVEL wide
MAX_LEVEL = 13
#: distinct points of a cell that is not split
BLOCK = 1 << 14
#: points of a box inside a task
LEAF = 128
#: query points of a cell that one task compares
CHUNK = 1 << 18
_SLACK = 1 + 1e-9
_BITS = 2 * MAX_LEVEL

_KEY = ["frame", "slot", "x", "y"]


def _cell(level: int) -> Column:
    """Number of the cell at ``level`` that holds the finest cell ``i, j``."""
    up = 2 * (MAX_LEVEL - level)
    return (F.lit(level << 2 * _BITS) + F.shiftleft(F.shiftright("i", up), _BITS) + F.shiftright("j", up))


def _parent(cell: str, level: int) -> Column:
    i = F.shiftright(F.shiftright(cell, _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)), 2)
    j = F.shiftright(F.col(cell).bitwiseAND(F.lit((1 << _BITS) - 1)), 2)
    return F.lit(level - 1 << 2 * _BITS) + F.shiftleft(i, _BITS) + j


def _least(box: Column) -> Column:
    """Square of the least distance of ``x, y`` to a box."""
    dx = F.greatest(box["x0"] - F.col("x"), F.col("x") - box["x1"], F.lit(0.0))
    dy = F.greatest(box["y0"] - F.col("y"), F.col("y") - box["y1"], F.lit(0.0))
    return dx * dx + dy * dy


def _somewhere(x: str, y: str) -> Column:
    """Rows without coordinates, or infinitely far away, are near nothing."""
    far = float("inf")
    return F.coalesce((F.abs(x) < far) & (F.abs(y) < far), F.lit(False))


class _Tree:
    """``cand(frame, nx, ny, nslot, i, j)`` in cells: ``roots(frame, root)``
    and ``kids(frame, cell, kids)``, the cells that were split with the
    number and box of every part that holds points."""

    def __init__(self, cand: DataFrame, block: int):
        self.depth = 0
        self.cand = cand
        cells = self._level(cand, 0)
        self.roots = cells.select("frame", F.col("cell").alias("root"))
        self.kids = None
        points = cand
        while self.depth < MAX_LEVEL:
            split = cells.where(F.col("n") > block).select("frame", "cell")
            if split.isEmpty():
                break
            points = (points.withColumn("cell", _cell(self.depth))
                      .join(split, ["frame", "cell"], "left_semi").drop("cell"))
            self.depth += 1
            cells = self._level(points, self.depth)
            kids = (cells.withColumn("up", _parent("cell", self.depth)).groupBy("frame", F.col("up").alias("cell"))
                    .agg(F.collect_list(F.struct("cell", "x0", "x1", "y0", "y1")).alias("kids")))
            self.kids = kids if self.kids is None else self.kids.unionByName(kids)
        if self.kids is not None:
            self.kids = materialize(self.kids, "kids")

    @staticmethod
    def _level(points: DataFrame, level: int) -> DataFrame:
        return materialize(points.groupBy("frame", _cell(level).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("nx").alias("x0"), F.max("nx").alias("x1"),
            F.min("ny").alias("y0"), F.max("ny").alias("y1")), f"cells{level}")

    def _down(self, rows: DataFrame, into) -> DataFrame:
        """``rows`` with their ``cell`` taken down to the cells that were not
        split; ``into(level)`` names the next cell."""
        for level in range(1, self.depth + 1):
            there = rows.join(self.kids, ["frame", "cell"], "left")
            rows = there.withColumn("cell", into(level)).drop("kids")
        return rows

    def placed(self) -> DataFrame:
        """The candidates with their cell."""
        return self._down(self.cand.withColumn("cell", _cell(0)), lambda level: F.when(
            F.col("kids").isNotNull(), _cell(level)).otherwise(F.col("cell"))).select("frame", "cell", "nx", "ny", "nslot")

    def homes(self, query: DataFrame) -> DataFrame:
        """Query points (with their finest cell ``i, j``) and the cell they
        lie in, or, where that holds no points, the one whose box is nearest,
        level by level (NULL where the next frame has no points)."""
        def nearest(level):
            near = F.array_min(F.transform("kids", lambda c: F.struct(_least(c).alias("d"), c["cell"].alias("cell"))))
            return (F.when(F.col("kids").isNull(), F.col("cell"))
                    .when(F.array_contains(F.col("kids.cell"), _cell(level)), _cell(level)).otherwise(near["cell"]))

        start = query.join(self.roots, "frame", "left").withColumnRenamed("root", "cell")
        return self._down(start, nearest).select(*_KEY, "cell")

    def within(self, rows: DataFrame) -> DataFrame:
        """Every cell that may hold a point not beyond ``bound``, except
        ``home``."""
        def near(_):
            limit = F.col("bound") * F.col("bound") * F.lit(_SLACK)
            open_ = F.transform(F.filter("kids", lambda c: _least(c) <= limit), lambda c: c["cell"])
            return F.explode(F.when(F.col("kids").isNotNull(), open_).otherwise(F.array("cell")))

        start = rows.join(self.roots, "frame").withColumnRenamed("root", "cell")
        return self._down(start, near).where("cell <> home").select(*_KEY, "cell")


class _Block:
    """The candidates of a cell in boxes of at most ``leaf`` points.  Of
    equally near ones the first in order of slot (none first), x, y counts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, slot: np.ndarray, none: np.ndarray, leaf: int):
        order = np.lexsort((y, x, slot, ~none))
        self.x, self.y, self.slot, self.none = x[order], y[order], slot[order], none[order]
        self.parts = []
        todo = [np.arange(len(x))]
        while todo:
            p = todo.pop()
            if len(p) <= leaf:
                self.parts.append(np.sort(p))
                continue
            v = self.x[p] if np.ptp(self.x[p]) >= np.ptp(self.y[p]) else self.y[p]
            half = len(p) // 2
            o = np.argpartition(v, half)
            todo += [p[o[:half]], p[o[half:]]]
        self.boxes = np.array([(self.x[p].min(), self.x[p].max(), self.y[p].min(), self.y[p].max()) for p in self.parts])

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and place of the nearest candidate of every point."""
        best, at = np.full(len(x), np.inf), np.full(len(x), -1)

        def compare(k: int, rows: np.ndarray) -> None:
            p = self.parts[k]
            dx, dy = x[rows, None] - self.x[p], y[rows, None] - self.y[p]
            d = np.sqrt(dx * dx + dy * dy)
            i = d.argmin(axis=1)
            d, i = d[np.arange(len(rows)), i], p[i]
            better = (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], i[better]

        if len(self.parts) == 1:
            compare(0, np.arange(len(x)))
            return best, at
        least = np.array([np.square(np.maximum(np.maximum(x0 - x, x - x1), 0.0))
                          + np.square(np.maximum(np.maximum(y0 - y, y - y1), 0.0)) for x0, x1, y0, y1 in self.boxes])
        home = least.argmin(axis=0)
        order = np.argsort(home, kind="stable")
        first = np.searchsorted(home[order], np.arange(len(self.parts) + 1))
        for k in range(len(self.parts)):
            if first[k] < first[k + 1]:
                compare(k, order[first[k]:first[k + 1]])
        for k in range(len(self.parts)):
            rows = np.flatnonzero((least[k] <= best * best * _SLACK) & (home != k))
            if len(rows):
                compare(k, rows)
        return best, at


def _compared(rows: DataFrame, cand: DataFrame, radius: float, leaf: int) -> DataFrame:
    """``rows(frame, slot, x, y, cell)`` with the nearest of the candidates of
    their cell, ``dist, nslot, nx, ny``; where none is closer than
    ``radius``, ``dist`` is infinite."""
    # cells with many query points: their number is what the points make of CHUNK
    parts = materialize(rows.groupBy("frame", "cell").agg(F.floor(F.count(F.lit(1)) / F.lit(CHUNK)).alias("more"))
                        .where("more > 0"), "parts")
    more = F.coalesce(F.col("more"), F.lit(0).cast("long"))
    here = (cand.join(parts, ["frame", "cell"], "left")
            .select("frame", "cell", F.explode(F.sequence(F.lit(0).cast("long"), more)).alias("part"),
                    F.lit(False).alias("query"), F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nslot").alias("slot")))
    asked = (rows.join(parts, ["frame", "cell"], "left")
             .select("frame", "cell", F.pmod(F.xxhash64("slot", "x", "y"), more + F.lit(1)).alias("part"),
                     F.lit(True).alias("query"), "x", "y", "slot"))
    together = (here.unionByName(asked).repartition("frame", "cell", "part")
                .sortWithinPartitions("frame", "cell", "part", "query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            frame, cell, part = (b.column(i).to_numpy() for i in range(3))
            query = b.column(3).to_numpy(zero_copy_only=False)
            x, y = (b.column(i).to_numpy() for i in (4, 5))
            none = b.column(6).is_null().to_numpy(zero_copy_only=False)
            slot = b.column(6).fill_null(0).to_numpy()
            cuts = [0, *(1 + np.flatnonzero((np.diff(frame) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)
                                            | (query[1:] != query[:-1]))).tolist(), b.num_rows]
            dist = np.full(b.num_rows, np.inf)
            to = np.zeros(b.num_rows, dtype=np.int64)
            tx, ty = np.zeros((2, b.num_rows))
            lost, slotless = np.ones((2, b.num_rows), dtype=bool)
            for a, e in zip(cuts[:-1], cuts[1:]):
                key = (frame[a], cell[a], part[a])
                if key != now:
                    now, held, block = key, [], None
                if not query[a]:
                    held.append((x[a:e], y[a:e], slot[a:e], none[a:e]))
                    continue
                if block is None:
                    block = _Block(*(np.concatenate(c) for c in zip(*held)), leaf)
                    held = []
                d, at = block.nearest(x[a:e], y[a:e])
                hit = d < radius
                dist[a:e] = np.where(hit, d, np.inf)
                lost[a:e] = ~hit
                to[a:e], tx[a:e], ty[a:e] = block.slot[at], block.x[at], block.y[at]
                slotless[a:e] = ~hit | block.none[at]
            asked = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(6), b.column(4), b.column(5), b.column(1), pa.array(dist),
                 pa.array(to, mask=slotless), pa.array(tx, mask=lost), pa.array(ty, mask=lost)],
                names=[*_KEY, "cell", "dist", "nslot", "nx", "ny"])
            yield asked.filter(b.column(3))

    ship_package(rows.sparkSession)
    return together.mapInArrow(run, "frame long, slot long, x double, y double, cell long, "
                                    "dist double, nslot long, nx double, ny double")


def nearest(points: DataFrame, radius: float, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``frame, slot, x, y, dist, nslot, nx, ny``: every distinct row of
    ``points(frame, slot, x, y)`` with the nearest point of the next frame
    closer than ``radius`` (of equally near ones the lowest slot), or NULLs."""
    if radius <= 0 or block < 1 or leaf < 1:
        raise ValueError("radius, block and leaf must be positive")
    radius = float(radius)
    types = dict(points.select(*_KEY).dtypes)
    points = points.select(F.col("frame").cast("long").alias("frame"), F.col("slot").cast("long").alias("slot"),
                           F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    cand = materialize(
        points.where(_somewhere("x", "y") & F.col("frame").isNotNull())
        .groupBy((F.col("frame") - 1).alias("frame"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        .agg(F.min("slot").alias("nslot")), "candidates")
    # the extent of all candidates
    e = cand.agg(F.min("nx").alias("x0"), F.max("nx").alias("x1"), F.min("ny").alias("y0"), F.max("ny").alias("y1")).first()
    x0, y0 = e["x0"] or 0.0, e["y0"] or 0.0
    extent = max((e["x1"] or 0.0) - x0, (e["y1"] or 0.0) - y0) or 1.0
    last = (1 << _BITS) - 1

    def fine(c: str, low: float) -> Column:
        place = F.floor((F.col(c) - F.lit(low)) / F.lit(extent) * F.lit(float(last + 1)))
        return F.greatest(F.least(place, F.lit(last)), F.lit(0)).cast("long")

    tree = _Tree(cand.withColumns({"i": fine("nx", x0), "j": fine("ny", y0)}), block)
    placed = tree.placed()
    asked = points.where(_somewhere("x", "y")).distinct().withColumns({"i": fine("x", x0), "j": fine("y", y0)})
    homes = materialize(tree.homes(asked), "homes")
    found = materialize(_compared(homes.where("cell is not null"), placed, radius, leaf), "found")

    # a cell holds what lies between its edges, up to rounding; the outermost have no outer edge
    bound = F.least("dist", F.lit(radius))
    level = F.shiftright("cell", 2 * _BITS)
    side = F.lit(extent) / F.pow(F.lit(4.0), level)
    off = F.lit(1e-9 * max(extent, abs(x0), abs(y0)))
    end = F.pow(F.lit(4.0), level) - 1

    def inside(c: str, low: float, up: int) -> Column:
        k = F.shiftright("cell", up).bitwiseAND(F.lit(last))
        return (((k == 0) | (F.col(c) - bound > F.lit(low) + k * side + off))
                & ((k == end) | (F.col(c) + bound < F.lit(low) + (k + 1) * side - off)))

    judged = found.withColumn("sure", inside("x", x0, _BITS) & inside("y", y0, 0))
    m = F.struct("dist", "nslot", "nx", "ny").alias("m")
    if tree.depth:
        unsure = judged.where("not sure")
        wide = materialize(tree.within(unsure.select(*_KEY, bound.alias("bound"), F.col("cell").alias("home"))), "wide")
        again = (unsure.select(*_KEY, m).unionByName(_compared(wide, placed, radius, leaf).select(*_KEY, m))
                 .groupBy(*_KEY).agg(F.min("m").alias("m")).select(*_KEY, "m.*"))
        out = judged.where("sure").select(*_KEY, "dist", "nslot", "nx", "ny").unionByName(again)
    else:
        out = found.drop("cell")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("dist", "double"), ("nslot", "long"), ("nx", "double"), ("ny", "double"))]
    out = (out.withColumn("dist", F.when(F.col("dist") < F.lit(radius), F.col("dist")))
           .unionByName(homes.where("cell is null").select(*_KEY, *none))
           .unionByName(points.where(~_somewhere("x", "y")).distinct().select(*_KEY, *none)))
    return out.select(*[F.col(c).cast(types[c]).alias(c) for c in _KEY], "dist", "nslot", "nx", "ny")


def nearest_pairs(points: DataFrame, radius: float, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """The rows of :func:`nearest` that have a point closer than ``radius``."""
    return nearest(points, radius, block, leaf).where(F.col("dist").isNotNull())
