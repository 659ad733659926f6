"""Visit-count and flow-field grids.

Grids are sparse ``groupBy`` results (partial aggregation before the
shuffle, so a hot cell costs nothing extra).  The dense form is generated
from ``spark.range(width*height)`` and left-joined, never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.functions import scalar as S
from trailframe.operators.matching import frame_count, match_next_frame


def _in_bounds(cx, cy, width, height):
    cond = F.lit(True)
    if width is not None:
        cond = cond & (cx >= 0) & (cx < F.lit(int(width)))
    if height is not None:
        cond = cond & (cy >= 0) & (cy < F.lit(int(height)))
    return cond


def heatmap(det: DataFrame, width: int | None = 720, height: int | None = 480,
            dense: bool = False) -> DataFrame:
    """A1: visits per integer cell ``(cx, cy, visits)``.

    Coordinates are truncated toward zero.  Cells outside ``[0, width) x
    [0, height)`` are dropped (the reference would fail on them); pass
    ``None`` for an unbounded axis.  ``dense=True`` returns all
    ``width*height`` cells with zeros.
    """
    cx, cy = S.truncate_to_cell("x").alias("cx"), S.truncate_to_cell("y").alias("cy")
    cells = det.select(cx, cy).where(_in_bounds(F.col("cx"), F.col("cy"), width, height))
    sparse = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("visits"))
    if not dense:
        return sparse
    if width is None or height is None:
        raise ValueError("the dense grid needs width and height")
    spark = det.sparkSession
    grid = spark.range(int(width) * int(height)).select(
        (F.col("id") / F.lit(int(height))).cast("int").alias("cx"),
        (F.col("id") % F.lit(int(height))).cast("int").alias("cy"))
    return (grid.join(sparse, ["cx", "cy"], "left")
            .select("cx", "cy", F.coalesce("visits", F.lit(0)).cast("long").alias("visits")))


def out_of_bounds(det: DataFrame, width: int = 720, height: int = 480) -> DataFrame:
    """Count of detections the bounded heat map leaves out."""
    cx, cy = S.truncate_to_cell("x"), S.truncate_to_cell("y")
    return det.where(~_in_bounds(cx, cy, width, height)).agg(F.count(F.lit(1)).alias("dropped"))


def heatmap_extent(grid: DataFrame, width: int | None = 720, height: int | None = 480) -> DataFrame:
    """A2: ``(min_visits, max_visits)`` over the DENSE grid, computed from the
    sparse one: the minimum is 0 as soon as one cell is empty.  Without a
    width or height the grid is the bounding box of the visited cells."""
    def side(given, c):
        return F.lit(int(given)) if given is not None else F.max(c).cast("long") - F.min(c) + 1

    return grid.agg(
        F.when(F.count(F.lit(1)) < side(width, "cx") * side(height, "cy"), F.lit(0).cast("long"))
        .otherwise(F.min("visits")).alias("min_visits"),
        F.max("visits").alias("max_visits"))


# The stops of the heat map's gradient are the minimum and the
# sum of minimum and maximum divided by these (integer division).
STOP_DIVISORS = (4, 3)


def _let(value, body):
    """``body(value)`` with ``value`` evaluated once, however often the body
    names it (a projection would be collapsed and its expression repeated)."""
    return F.transform(F.array(value), body)[0]


def heatmap_colors(grid: DataFrame, width: int | None = 720, height: int | None = 480) -> DataFrame:
    """P13 applied to a heat map: stops at ``min``, ``(min+max)/4`` and
    ``(min+max)/3`` (integer division) with blue, green, red.  The three
    stops are one scalar subquery over the extent, the packed colour is
    computed once per cell and then split."""
    lo, both = F.col("min_visits"), F.col("min_visits") + F.col("max_visits")
    q, t = (F.floor(both / F.lit(d)).cast("long") for d in STOP_DIVISORS)
    stops = heatmap_extent(grid, width, height).select(
        F.struct(lo.alias("lo"), q.alias("q"), t.alias("t")).alias("s")).scalar()
    packed = S.color_ramp("visits", [(F.col("s.lo"), S.BLUE_ARGB), (F.col("s.q"), S.GREEN_ARGB),
                                     (F.col("s.t"), S.RED_ARGB)])
    rgb = _let(F.col("p"), lambda p: F.struct(*[c.alias(n) for n, c in zip("rgb", S.rgb_channels(p))]))
    out = grid.withColumn("s", stops).select("cx", "cy", "visits", packed.alias("p"))
    return out.select("cx", "cy", "visits", rgb.alias("c")).select("cx", "cy", "visits", "c.r", "c.g", "c.b")


def displacements(det: DataFrame, radius: float = 100.0, tail_skip: int = 5) -> DataFrame:
    """P9 over J1: ``(frame, slot, x, y, vx, vy)``; an unmatched detection has
    zero displacement (as in the flow-field job)."""
    m = match_next_frame(det, radius=radius, on_miss="zero_delta")
    n = frame_count(det)
    return (m.where(F.col("frame") < n - F.lit(tail_skip))
            .select("frame", "slot", "x", "y",
                    (F.col("nx") - F.col("x")).alias("vx"), (F.col("ny") - F.col("y")).alias("vy")))


def flow_field(det: DataFrame, bin_size: int = 15, radius: float = 100.0,
               slow_limit: float = 0.3, absolute: bool = False, tail_skip: int = 5,
               width: int | None = None, height: int | None = None, dense: bool = False) -> DataFrame:
    """A3: per ``bin_size`` square, the sum of small displacements and its
    unit vector ``(bin_x, bin_y, n, sum_vx, sum_vy, ux, uy)``.

    ``ux, uy`` are NULL for a zero sum.  Bins outside the frame are dropped
    when ``width``/``height`` are given; ``dense=True`` then returns every
    bin of the frame, those without a move with zero count and sums.
    """
    if dense and (width is None or height is None):
        raise ValueError("the dense field needs width and height")
    v = displacements(det, radius=radius, tail_skip=tail_skip)
    v = v.where(S.slow_only("vx", "vy", slow_limit, absolute))
    bx, by = S.bin_index("x", bin_size), S.bin_index("y", bin_size)
    nbx = None if width is None else int(width) // bin_size
    nby = None if height is None else int(height) // bin_size
    g = (v.select(bx.alias("bin_x"), by.alias("bin_y"), "vx", "vy")
         .where(_in_bounds(F.col("bin_x"), F.col("bin_y"), nbx, nby))
         .groupBy("bin_x", "bin_y")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("vx").alias("sum_vx"), F.sum("vy").alias("sum_vy")))
    if dense:
        bins = det.sparkSession.range(nbx * nby).select(
            (F.col("id") / F.lit(nby)).cast("int").alias("bin_x"), (F.col("id") % F.lit(nby)).cast("int").alias("bin_y"))
        g = bins.join(g, ["bin_x", "bin_y"], "left").na.fill({"n": 0, "sum_vx": 0.0, "sum_vy": 0.0})
    ux, uy = S.unit_vector("sum_vx", "sum_vy")
    return g.select("bin_x", "bin_y", "n", "sum_vx", "sum_vy", ux.alias("ux"), uy.alias("uy"))


def glyph_segments(field: DataFrame, bin_size: int = 15) -> DataFrame:
    """Line end points of the flow-field glyphs."""
    x0, y0, x1, y1 = S.glyph_segment("bin_x", "bin_y", "ux", "uy", bin_size)
    return field.select("bin_x", "bin_y", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
