"""A1-A3, P6-P13 on hand-made detections."""

import math

import pytest
from pyspark.sql import functions as F

from trailframe.functions import scalar as S
from trailframe.operators import grids

DET_SCHEMA = "frame long, slot long, x double, y double"


def test_truncation_and_binning(spark):
    df = spark.createDataFrame([(-3.7,), (3.7,), (29.9,), (30.0,)], "x double")
    got = df.select(S.truncate_to_cell("x").alias("c"), S.bin_index("x", 15).alias("b")).collect()
    assert [(r.c, r.b) for r in got] == [(-3, 0), (3, 0), (29, 1), (30, 2)]


def test_heatmap_sparse_dense_and_extent(spark):
    rows = [(0, 0, 1.2, 2.9), (0, 1, 1.9, 2.1), (1, 0, 3.0, 0.0), (1, 1, 9.0, 9.0), (2, 0, -0.5, 0.5)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    sparse = {(r.cx, r.cy): r.visits for r in grids.heatmap(det, 4, 3).collect()}
    # (9, 9) is outside 4 x 3; -0.5 truncates to 0 and stays inside
    assert sparse == {(1, 2): 2, (3, 0): 1, (0, 0): 1}
    assert grids.out_of_bounds(det, 4, 3).first()["dropped"] == 1
    dense = grids.heatmap(det, 4, 3, dense=True)
    assert dense.count() == 12
    assert dense.agg(F.sum("visits")).first()[0] == 4
    ext = grids.heatmap_extent(grids.heatmap(det, 4, 3), 4, 3).first()
    assert (ext.min_visits, ext.max_visits) == (0, 2)
    full = spark.createDataFrame([(0, i, float(i % 2), float(i // 2)) for i in range(4)], DET_SCHEMA)
    ext2 = grids.heatmap_extent(grids.heatmap(full, 2, 2), 2, 2).first()
    assert (ext2.min_visits, ext2.max_visits) == (1, 1)


def test_color_ramp(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 5.0, 10.0, 15.0, 20.0, 99.0)], "v double")
    packed = S.color_ramp("v", [(0.0, S.BLUE_ARGB), (10.0, S.GREEN_ARGB), (20.0, S.RED_ARGB)])
    r, g, b = S.rgb_channels(packed)
    got = [(x.r, x.g, x.b) for x in df.select(r.alias("r"), g.alias("g"), b.alias("b")).collect()]
    assert got == [(0, 0, 255), (0, 0, 255), (0, 127, 127), (0, 255, 0), (127, 127, 0), (255, 0, 0), (255, 0, 0)]


def test_flow_field_signed_limit_and_unit_vectors(spark):
    rows = [(0, 0, 1.0, 1.0), (1, 0, 1.2, 1.1),      # small positive move
            (0, 1, 20.0, 20.0), (1, 1, 10.0, 20.0),  # large negative move: passes the signed test
            (0, 2, 40.0, 40.0), (1, 2, 45.0, 40.0),  # large positive move: filtered
            (0, 3, 70.0, 70.0)]                      # no partner: zero move
    rows += [(f, 0, 700.0, 700.0) for f in range(2, 7)]  # far away: frame-1 rows find no partner
    det = spark.createDataFrame(rows, DET_SCHEMA)
    ff = {(r.bin_x, r.bin_y): r for r in grids.flow_field(det, bin_size=15, radius=11.0, slow_limit=0.3).collect()}
    assert (0, 0) in ff and ff[(0, 0)].ux == pytest.approx(0.2 / math.hypot(0.2, 0.1))
    assert ff[(1, 1)].sum_vx == pytest.approx(-10.0) and ff[(1, 1)].ux == pytest.approx(-1.0)
    assert (2, 2) not in ff
    assert ff[(4, 4)].ux is None  # zero sum -> NULL unit vector
    ffa = {(r.bin_x, r.bin_y) for r in grids.flow_field(det, 15, 11.0, 0.3, absolute=True).collect()}
    assert (1, 1) not in ffa


def test_glyph_segments(spark):
    f = spark.createDataFrame([(2, 3, 1.0, 0.0)], "bin_x int, bin_y int, ux double, uy double")
    s = grids.glyph_segments(f, 15).first()
    assert (s.x0, s.y0, s.x1, s.y1) == (44.5, 52.0, 29.5, 52.0)


def test_unit_vector_and_advance(spark):
    df = spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "a double, b double")
    ux, uy = S.unit_vector("a", "b")
    got = df.select(ux.alias("u"), uy.alias("v"), S.advance("a", "b", 3500.0, 0.5).alias("c")).collect()
    assert (got[0].u, got[0].v, got[0].c) == (0.6, 0.8, 3.0 + 4.0 * 3500.0 * 0.5)
    assert got[1].u is None


def test_pixel_expressions(spark):
    df = spark.createDataFrame([(0xFF102030,), (0x000000,), (0xFFFFFF,)], "c long")
    r, g, b = S.unpack_rgb("c")
    v = S.inverted_gray(r, g, b)
    got = df.select(v.alias("v")).collect()
    assert got[0].v == pytest.approx(255.0 - (16.0 + 32.0 + 48.0) / 3.0)
    assert got[1].v == 255.0 and got[2].v == 0.0


def test_frame_name(spark):
    df = spark.createDataFrame([(1,), (1234567,), (123456789,)], "i long")
    assert [r.n for r in df.select(S.frame_name("i").alias("n")).collect()] == ["0000001", "1234567", "3456789"]
