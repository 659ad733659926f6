"""Linking detections across frames (J1, J2, Q2 gate, W3).

J1 finds, for every detection of frame f, the nearest detection of frame
f+1 strictly closer than ``radius`` (ties go to the lowest slot; several
detections may pick the same partner).  It is a spatial equi-join, never a
per-frame product:

* frame f+1 is keyed by ``(frame, cell)`` with a square cell (side
  ``radius`` by default); every candidate closer than ``radius`` lies within
  ``ceil(radius / side)`` cells of the query point's cell, so the query side
  is exploded to those keys (3x3 at the default side);
* exact copies of a point in frame f+1 are folded to their lowest slot
  before the join (a copy can never beat its lower-slot twin), so a pile of
  identical coordinates joins as one row;
* the best candidate per detection is ``min(struct(dist, slot, x, y))``,
  which aggregates partially before its shuffle; pairs at or beyond
  ``radius`` never reach it;
* one infinite-distance row per detection goes into the same aggregation
  for the misses, so no join back onto the facts is needed.

A hot ``(frame, cell)`` key is split by AQE's skew-join handling (the query
side is split, the candidate side replicated).  Joins of tables that grow
with the detections ask for a merge join: Spark would broadcast a table whose
compressed files are small, and the driver would have to hold it whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.operators import cell_tree
from trailframe.session import materialize

_MISS = ("origin", "zero_delta", "null", "drop")


def _cell(c, side: float):
    return F.floor(F.col(c) / F.lit(float(side))).cast("long")


def match_next_frame(det: DataFrame, radius: float = 100.0, on_miss: str = "null",
                     cell: float | None = None, method: str = "grid") -> DataFrame:
    """J1.  ``det(frame, slot, x, y)`` -> ``(frame, slot, x, y, nslot, nx, ny, dist)``.

    ``on_miss``: ``"origin"`` gives (0, 0) as in the transitions builder,
    ``"zero_delta"`` gives the point itself (zero displacement) as in the
    flow field, ``"null"`` leaves NULLs, ``"drop"`` removes the row.

    ``method="grid"`` joins neighbouring cells; its pairs grow with the
    square of the points within one radius.  ``method="tree"`` goes through
    the adaptive cell tree of :mod:`trailframe.operators.cell_tree`: the same
    rows, few candidates a point however dense a frame is.
    """
    if on_miss not in _MISS:
        raise ValueError(f"on_miss must be one of {_MISS}")
    pts = det.select("frame", "slot", "x", "y")
    if method == "tree":
        best = cell_tree.nearest(pts, radius)
    elif method == "grid":
        near = (_grid_pairs(pts, radius, cell)
                .select("frame", "slot", "x", "y", F.struct("dist", "nslot", "nx", "ny").alias("m")))
        miss = F.struct(F.lit(float("inf")).alias("dist"), F.lit(None).cast("long").alias("nslot"),
                        F.lit(None).cast("double").alias("nx"), F.lit(None).cast("double").alias("ny"))
        pairs = near.union(pts.select("frame", "slot", "x", "y", miss.alias("m")))
        best = (pairs.groupBy("frame", "slot", "x", "y").agg(F.min("m").alias("m"))
                .select("frame", "slot", "x", "y", "m.*"))
    else:
        raise ValueError("method must be 'grid' or 'tree'")
    hit = F.col("nslot").isNotNull()
    if on_miss == "drop":
        return best.where(hit)
    if on_miss == "null":
        return best.withColumn("dist", F.when(hit, F.col("dist")))
    if on_miss == "origin":
        fill_x, fill_y = F.lit(0.0), F.lit(0.0)
    else:
        fill_x, fill_y = F.col("x"), F.col("y")
    return best.select("frame", "slot", "x", "y", "nslot",
                       F.when(hit, F.col("nx")).otherwise(fill_x).alias("nx"),
                       F.when(hit, F.col("ny")).otherwise(fill_y).alias("ny"),
                       F.when(hit, F.col("dist")).alias("dist"))


def _grid_pairs(pts: DataFrame, radius: float, cell: float | None) -> DataFrame:
    """Every detection with the candidates of the next frame closer than
    ``radius``, through a join of neighbouring cells."""
    side = float(cell if cell is not None else radius)
    if side <= 0:
        raise ValueError("cell side must be positive")

    cand = (pts.select((F.col("frame") - 1).alias("frame"), F.col("slot").alias("nslot"),
                       F.col("x").alias("nx"), F.col("y").alias("ny"))
            .withColumn("cx", _cell("nx", side)).withColumn("cy", _cell("ny", side))
            .groupBy("frame", "cx", "cy", "nx", "ny").agg(F.min("nslot").alias("nslot")))

    # a candidate closer than ``radius`` is at most ceil(radius / side) cells away
    reach = max(1, math.ceil(float(radius) / side))
    span = range(-reach, reach + 1)
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in span for dy in span])
    query = (pts.withColumn("o", F.explode(offsets))
             .select("frame", "slot", "x", "y",
                     (_cell("x", side) + F.col("o.dx")).alias("cx"),
                     (_cell("y", side) + F.col("o.dy")).alias("cy")))

    dx = F.col("x") - F.col("nx")
    dy = F.col("y") - F.col("ny")
    # as many candidates as detections: their files may look small enough to
    # broadcast, in memory they are not
    return (query.join(cand.hint("merge"), ["frame", "cx", "cy"]).withColumn("dist", F.sqrt(dx * dx + dy * dy))
            .where(F.col("dist") < F.lit(float(radius)))
            .select("frame", "slot", "x", "y", "dist", "nslot", "nx", "ny"))


def frame_count(det: DataFrame) -> Column:
    """Number of frames as a scalar subquery (frames are numbered from 0)."""
    return det.select((F.max("frame") + 1).alias("n")).scalar()


def lookahead(matched: DataFrame, hops: int = 2, chain: bool = False,
              det: DataFrame | None = None, tail_skip: int = 5, shown: Sequence[int] | None = None) -> DataFrame:
    """J2.  Positions looked up over ``hops`` consecutive frames.

    Not chained (as coded): hop h starts from the detection with the SAME
    slot in frame i+h and takes its J1 match.  Chained: hop h starts from the
    point matched at hop h-1.  Rows whose slot is missing in a later frame
    are dropped (the reference throws).  Frames ``i >= n - tail_skip`` are
    skipped (``n`` = number of frames of ``det``, default the matched table).

    Output: ``frame, slot, ox0, oy0, nx0, ny0, ..., ox{h-1}, oy{h-1}, nx{h-1}, ny{h-1}``
    where ``(ox, oy)`` is where hop h started and ``(nx, ny)`` its match.

    Chained lookups of more than three hops double paths: see
    :func:`chained_paths`.  With ``shown``, they double steps and give
    ``nx{h}, ny{h}`` of the hops named there only, of the rows whose path goes
    through all hops: see :func:`chained_positions`.
    """
    if hops < 1:
        raise ValueError("hops must be >= 1")
    if shown is not None and (not chain or not all(0 <= h < hops for h in shown)):
        raise ValueError("shown names hops of a chained lookup")
    src = det if det is not None else matched
    n = frame_count(src)
    m = matched.select("frame", "slot", "x", "y", "nx", "ny")
    if not chain:
        return _same_slot_hops(m, hops).where(F.col("frame") < n - F.lit(tail_skip))
    if shown is not None:
        return chained_positions(m, m.where(F.col("frame") < n - F.lit(tail_skip)), hops, shown)
    if hops > 3:
        walked = chained_paths(m, m.where(F.col("frame") < n - F.lit(tail_skip)), hops)
        return walked.select("frame", "slot", *[c for h in range(hops) for c in (
            (F.col("x") if h == 0 else F.col("path")[h - 1]["x"]).alias(f"ox{h}"),
            (F.col("y") if h == 0 else F.col("path")[h - 1]["y"]).alias(f"oy{h}"),
            F.col("path")[h]["x"].alias(f"nx{h}"), F.col("path")[h]["y"].alias(f"ny{h}"))])
    out = (m.where(F.col("frame") < n - F.lit(tail_skip))
           .select("frame", "slot", F.col("x").alias("ox0"), F.col("y").alias("oy0"),
                   F.col("nx").alias("nx0"), F.col("ny").alias("ny0")))
    for h in range(1, hops):
        # follow the match: the hop-h start is the matched point of hop h-1,
        # found in frame i+h by its coordinates (lowest slot on copies)
        nxt = (m.groupBy("frame", "x", "y")
               .agg(F.min(F.struct("slot", "nx", "ny")).alias("s"))
               .select((F.col("frame") - h).alias("frame"),
                       F.col("x").alias(f"ox{h}"), F.col("y").alias(f"oy{h}"),
                       F.col("s.nx").alias(f"nx{h}"), F.col("s.ny").alias(f"ny{h}")))
        out = out.join(nxt.hint("merge"), (out["frame"] == nxt["frame"])
                       & (out[f"nx{h - 1}"] == nxt[f"ox{h}"])
                       & (out[f"ny{h - 1}"] == nxt[f"oy{h}"])).drop(nxt["frame"])
    return out


def chained_paths(matched: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """``frame, slot, x, y, path``: the ``hops`` positions (struct x, y) that
    each row of ``starts(frame, slot, x, y, nx, ny)`` moves through; rows
    whose path ends early are left out.

    The first position is the row's own match.  The rest, ``l = hops - 1``
    steps, is read off a table of paths of ``2**k`` steps from every point
    of every frame, the largest such that is not longer: one lookup gives
    the first ``2**k`` positions, a second one, from the position after ``l -
    2**k`` steps, the last ``2**k``.  The table is built by joining it with
    itself k times, so ``hops`` cost k + 2 joins, not ``hops``; it is written
    at each doubling, so its plan does not double."""
    rest = hops - 1
    key = ["frame", "x", "y"]
    point = F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"))
    first = starts.select("frame", "slot", "x", "y", F.array(point).alias("path"))
    if rest == 0:
        return first
    paths = materialize(
        matched.where(F.col("nx").isNotNull() & F.col("ny").isNotNull()).groupBy(*key)
        .agg(F.min(F.struct("slot", "nx", "ny")).alias("s"))
        .select(*key, F.array(F.struct(F.col("s.nx").alias("x"), F.col("s.ny").alias("y"))).alias("steps")), "paths1")

    def walk(rows: DataFrame, after: int, size: int, done: str) -> DataFrame:
        """``rows`` with the ``size`` steps that follow position ``after`` of
        their path (an array column ``done``) as ``steps``."""
        at = F.col(done)[after - 1]
        return (rows.withColumns({"_f": F.col("frame") + after, "_x": at["x"], "_y": at["y"]})
                .join(paths.select(F.col("frame").alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y"), "steps")
                      .hint("merge"), ["_f", "_x", "_y"]).drop("_f", "_x", "_y"))

    size = 1
    while 2 * size <= rest:
        ahead = walk(paths.withColumnRenamed("steps", "head"), size, size, "head")
        paths = materialize(ahead.select(*key, F.concat("head", "steps").alias("steps")), f"paths{2 * size}")
        size *= 2
    out = walk(first, 1, size, "path").select("frame", "slot", "x", "y", F.concat("path", "steps").alias("path"))
    if rest > size:
        # from the position after rest - size steps the table reaches the end
        over = 2 * size - rest
        out = (walk(out, 1 + rest - size, size, "path")
               .withColumn("path", F.concat("path", F.slice("steps", over + 1, size))).drop("steps"))
    return out.select("frame", "slot", "x", "y", "path")


def chained_positions(matched: DataFrame, starts: DataFrame, hops: int, shown: Sequence[int]) -> DataFrame:
    """``frame, slot`` and ``nx{h}, ny{h}`` for the hops ``shown``: the
    positions that :func:`chained_paths` gives there.

    A row keeps the positions asked for and where it stands, not its path:
    the tables say where ``2**k`` steps lead from every point, one position a
    point at any k, and a row takes the steps between two hops by the binary
    digits of their number."""
    at = {h: (f"nx{h}", f"ny{h}") for h in sorted(set(shown))}
    jumps = [materialize(
        matched.where(F.col("nx").isNotNull() & F.col("ny").isNotNull()).groupBy("frame", "x", "y")
        .agg(F.min(F.struct("slot", "nx", "ny")).alias("s"))
        .select("frame", "x", "y", F.col("s.nx").alias("tx"), F.col("s.ny").alias("ty")), "jump1")]

    def jumped(rows: DataFrame, after: int, k: int) -> DataFrame:
        """``rows`` that stand at ``_x, _y``, ``after`` frames on, moved
        ``2**k`` steps."""
        to = jumps[k].select((F.col("frame") - after).alias("frame"), F.col("x").alias("_x"), F.col("y").alias("_y"), "tx", "ty")
        return (rows.join(to.hint("merge"), ["frame", "_x", "_y"]).drop("_x", "_y")
                .withColumnsRenamed({"tx": "_x", "ty": "_y"}))

    ends = [*at, hops - 1]
    gaps = [b - a for a, b in zip([0, *ends], ends)]
    for k in range(max(gaps).bit_length() - 1):
        twice = jumped(jumps[k].withColumnsRenamed({"tx": "_x", "ty": "_y"}), 1 << k, k)
        jumps.append(materialize(twice.withColumnsRenamed({"_x": "tx", "_y": "ty"}), f"jump{2 << k}"))

    rows = starts.select("frame", "slot", F.col("nx").alias("_x"), F.col("ny").alias("_y"))
    done = 0
    for end, gap in zip(ends, gaps):
        for k in reversed(range(gap.bit_length())):
            if gap >> k & 1:
                rows = jumped(rows, done + 1, k)
                done += 1 << k
        if end in at and at[end][0] not in rows.columns:
            rows = rows.withColumns(dict(zip(at[end], (F.col("_x"), F.col("_y")))))
    return rows.select("frame", "slot", *[c for h in at for c in at[h]])


def _same_slot_hops(m: DataFrame, hops: int) -> DataFrame:
    """Hops by equal slot: every matched row is emitted once per hop under
    the key ``(frame - h, slot)`` of the row it serves, and one aggregation
    lays the hops side by side (one shuffle, the match runs once)."""
    cols = ("x", "y", "nx", "ny")
    rows = (m.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in range(hops)])))
            .withColumn("frame", F.col("frame") - F.col("_h")).where(F.col("frame") >= 0))
    aggs = []
    for h in range(hops):
        for c, name in zip(cols, ("ox", "oy", "nx", "ny")):
            aggs.append(F.max(F.when(F.col("_h") == h, F.col(c))).alias(f"{name}{h}"))
    wide = rows.groupBy("frame", "slot").agg(F.bit_or(F.expr("shiftleft(1, _h)")).alias("_seen"), *aggs)
    return wide.where(F.col("_seen") == F.lit((1 << hops) - 1)).drop("_seen")


def gate(la: DataFrame, hops: int, limit: float = 0.5) -> DataFrame:
    """Q2 gate: drop a row when two consecutive looked-up points differ by
    more than ``limit`` in x or in y (NULL positions never pass)."""
    cond = F.lit(True)
    for h in range(1, hops):
        for a in ("nx", "ny"):
            cond = cond & (F.abs(F.col(f"{a}{h}") - F.col(f"{a}{h - 1}")) <= F.lit(float(limit)))
    return la.where(cond)


def build_transitions(det: DataFrame, hops: int = 2, gate_limit: float = 0.5,
                      mode: str = "delta", radius: float = 100.0, on_miss: str = "null",
                      chain: bool = False, tail_skip: int = 5, matched: DataFrame | None = None) -> DataFrame:
    """Q2: labelled transition rows, both labels in one row.  ``matched``: the
    rows of :func:`match_next_frame` for ``det``, ``radius`` and ``on_miss``,
    where the caller has them.

    ``mode="position"`` (as coded): features are the looked-up positions of
    hops 0..h-2, labels the x and y of the last hop.  ``mode="delta"``
    (as documented): the same with each position replaced by its
    displacement from the hop's start point.

    Columns: ``frame, slot, x, y, [x1, y1, ...], next_x, next_y``; with
    ``hops=2`` the features are ``x, y``, otherwise ``x1, y1, ..``.
    """
    if mode not in ("delta", "position"):
        raise ValueError("mode must be 'delta' or 'position'")
    given = matched is not None
    matched = matched if given else match_next_frame(det, radius=radius, on_miss=on_miss)
    if hops > 1 and chain and not given:
        # the chained lookahead joins the matched table with itself; without
        # a cut the match would run once per side
        matched = materialize(matched, "matched")
    la = gate(lookahead(matched, hops=hops, chain=chain, det=det, tail_skip=tail_skip), hops, gate_limit)
    if on_miss == "null":
        la = la.where(F.col(f"nx{hops - 1}").isNotNull() & F.col(f"ny{hops - 1}").isNotNull())

    def val(a: str, h: int):
        c = F.col(f"n{a}{h}")
        return c - F.col(f"o{a}{h}") if mode == "delta" else c

    names = ["x", "y"] if hops == 2 else None
    feats = []
    for h in range(hops - 1):
        fx, fy = (names if names else (f"x{h + 1}", f"y{h + 1}"))
        feats += [val("x", h).alias(fx), val("y", h).alias(fy)]
    last = hops - 1
    return la.select("frame", "slot", *feats,
                     val("x", last).alias("next_x"), val("y", last).alias("next_y"))


def memory_features(tracks: DataFrame, k: int = 4, cols=("x", "y"),
                    track: str = "track", step: str = "step") -> DataFrame:
    """For every step with k earlier steps on its track, the k earlier
    values of each column (``x1`` oldest .. ``xk`` newest) and the current
    values as labels ``next_<col>``.  Rows with a NULL among the k earlier
    values are dropped.

    No window holds a whole track.  The rows are range-partitioned by
    ``(track, step)`` into parts of about equal numbers of ROWS, whatever
    the ids are and however long one track is, and written once (range
    bounds are sampled, so they must not be drawn twice).  Lags are taken
    inside each part.  A part boundary cuts at most one track; only the
    first k rows of such a track in each part reach back, and they are
    completed from the first and last k rows of its parts (at most 2k rows
    per part).
    """
    cols = list(cols)
    dealt = materialize(
        tracks.select(track, step, *cols).repartitionByRange(track, step)
        .withColumn("_part", F.spark_partition_id()), "tracks")
    inside = Window.partitionBy("_part", track)
    w = inside.orderBy(step)
    names = {(c, i): f"_l_{c}_{i}" for c in cols for i in range(1, k + 1)}
    lags = {n: F.lag(c, i).over(w) for (c, i), n in names.items()}
    d = dealt.withColumn("_r", F.row_number().over(w)).withColumns(lags)
    whole = d.where(F.col("_r") > k)

    cut = (dealt.groupBy(track).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b"))
           .where("_a < _b").select(F.col(track).alias("_cut")))
    edges = (dealt.join(cut, dealt[track].eqNullSafe(F.col("_cut"))).drop("_cut")
             .withColumn("_r", F.row_number().over(w))
             .withColumn("_z", F.row_number().over(inside.orderBy(F.desc(step))))
             .where((F.col("_r") <= k) | (F.col("_z") <= k)).drop("_z"))
    # the rows in front of a head row are all among the edges of its track
    over = Window.partitionBy(track).orderBy(step)
    heads = (edges.withColumn("_q", F.row_number().over(over))
             .withColumns({n: F.lag(c, i).over(over) for (c, i), n in names.items()})
             .where((F.col("_r") <= k) & (F.col("_q") > k)))

    feats = [F.col(names[(c, k + 1 - j)]).alias(f"{c}{j}") for j in range(1, k + 1) for c in cols]
    keep = [track, step, *feats, *[F.col(c).alias(f"next_{c}") for c in cols]]
    out = whole.select(*keep).unionByName(heads.select(*keep))
    return out.na.drop("any", subset=[f"{c}{j}" for j in range(1, k + 1) for c in cols])


def memory_features_window(tracks: DataFrame, k: int = 4, cols=("x", "y"),
                           track: str = "track", step: str = "step") -> DataFrame:
    """Same rows as :func:`memory_features` with ``lag`` over a track window;
    simpler, but one task holds each whole track.  Kept for small inputs and
    as a cross-check in tests."""
    w = Window.partitionBy(track).orderBy(step)
    sel = [track, step]
    for i in range(1, k + 1):
        for c in cols:
            sel.append(F.lag(c, k + 1 - i).over(w).alias(f"{c}{i}"))
    sel += [F.col(c).alias(f"next_{c}") for c in cols]
    out = tracks.select(*sel, F.row_number().over(w).alias("_r")).where(F.col("_r") > k).drop("_r")
    return out.na.drop("any", subset=[f"{c}{i}" for i in range(1, k + 1) for c in cols])
