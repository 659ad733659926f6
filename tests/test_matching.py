"""J1, J2, Q2 gate, W1-W3 against brute force and hand-worked cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trailframe.operators import matching
from trailframe.operators.indexing import dense_index, row_index

DET_SCHEMA = "frame long, slot long, x double, y double"


def brute_match(rows, radius):
    by_frame = {}
    for f, s, x, y in rows:
        by_frame.setdefault(f, []).append((s, x, y))
    out = {}
    for f, s, x, y in rows:
        best = None
        for ns, nx, ny in sorted(by_frame.get(f + 1, [])):
            d = math.sqrt((x - nx) ** 2 + (y - ny) ** 2)
            if d < radius and (best is None or d < best[0]):
                best = (d, ns, nx, ny)
        out[(f, s)] = best
    return out


def random_det(seed, frames=6, per=25, span=60.0, dup=True):
    rnd = random.Random(seed)
    rows = []
    for f in range(frames):
        pts = [(round(rnd.uniform(0, span), 1), round(rnd.uniform(0, span), 1)) for _ in range(per)]
        if dup:
            pts += pts[:3]
        for s, (x, y) in enumerate(pts):
            rows.append((f, s, x, y))
    return rows


@pytest.mark.parametrize("radius,cell", [(10.0, None), (10.0, 3.0), (25.0, None), (7.5, 20.0)])
def test_match_equals_brute_force(spark, radius, cell):
    rows = random_det(1)
    det = spark.createDataFrame(rows, DET_SCHEMA)
    got = {(r.frame, r.slot): r for r in matching.match_next_frame(det, radius, "null", cell).collect()}
    want = brute_match(rows, radius)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        if w is None:
            assert g.nslot is None and g.nx is None and g.dist is None
        else:
            assert (g.nslot, g.nx, g.ny) == (w[1], w[2], w[3])
            assert g.dist == pytest.approx(w[0])


def test_ties_go_to_lowest_slot_and_radius_is_strict(spark):
    rows = [(0, 0, 0.0, 0.0),
            (1, 0, 5.0, 0.0), (1, 1, -5.0, 0.0), (1, 2, 0.0, 5.0),  # three at distance 5
            (0, 1, 100.0, 100.0), (1, 3, 110.0, 100.0)]             # exactly at radius 10
    det = spark.createDataFrame(rows, DET_SCHEMA)
    m = {(r.frame, r.slot): r for r in matching.match_next_frame(det, radius=10.0, on_miss="null").collect()}
    assert m[(0, 0)].nslot == 0
    assert m[(0, 1)].nslot is None  # 10 is not < 10


def test_many_to_one_and_miss_modes(spark):
    rows = [(0, 0, 1.0, 1.0), (0, 1, 2.0, 2.0), (0, 2, 500.0, 500.0), (1, 0, 1.5, 1.5)]
    det = spark.createDataFrame(rows, DET_SCHEMA)

    def run(mode):
        return {(r.frame, r.slot): (r.nx, r.ny) for r in matching.match_next_frame(det, 100.0, mode).collect()}

    o = run("origin")
    assert o[(0, 0)] == (1.5, 1.5) and o[(0, 1)] == (1.5, 1.5)
    assert o[(0, 2)] == (0.0, 0.0) and o[(1, 0)] == (0.0, 0.0)
    z = run("zero_delta")
    assert z[(0, 2)] == (500.0, 500.0)
    n = run("null")
    assert n[(0, 2)] == (None, None)
    d = run("drop")
    assert set(d) == {(0, 0), (0, 1)}


def test_hot_copies_fold_without_changing_result(spark):
    # a third of the rows are copies of one point in the next frame
    rows = [(0, i, float(i), 0.0) for i in range(10)]
    rows += [(1, i, 3.0, 0.0) for i in range(20)] + [(1, 20, 2.0, 0.0)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    got = {(r.frame, r.slot): r.nslot for r in matching.match_next_frame(det, 100.0, "null").collect()}
    want = brute_match(rows, 100.0)
    for k, w in want.items():
        assert got[k] == (None if w is None else w[1])


def test_lookahead_not_chained_uses_same_slot(spark):
    # slot 0 of frame 1 is far from where slot 0 of frame 0 went
    rows = [(0, 0, 0.0, 0.0), (0, 1, 50.0, 50.0),
            (1, 0, 50.2, 50.1), (1, 1, 0.3, 0.1),
            (2, 0, 50.4, 50.3), (2, 1, 0.4, 0.2)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    m = matching.match_next_frame(det, 10.0, "origin")
    la = {r.slot: r for r in matching.lookahead(m, hops=2, det=det, tail_skip=1).collect() if r.frame == 0}
    # hop 0 from (0,0) lands on frame-1 slot 1; hop 1 starts at frame-1 slot 0 (as coded)
    assert (la[0].nx0, la[0].ny0) == (0.3, 0.1)
    assert (la[0].nx1, la[0].ny1) == (50.4, 50.3)
    ch = {r.slot: r for r in matching.lookahead(m, hops=2, chain=True, det=det, tail_skip=1).collect()
          if r.frame == 0}
    assert (ch[0].nx1, ch[0].ny1) == (0.4, 0.2)


def test_gate_and_modes(spark):
    rows = [(0, 0, 0.0, 0.0), (1, 0, 0.2, 0.1), (2, 0, 0.5, 0.3),
            (0, 1, 9.0, 9.0), (1, 1, 9.1, 9.0), (2, 1, 12.0, 9.0)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    pos = matching.build_transitions(det, hops=2, gate_limit=0.5, mode="position", radius=5.0,
                                     on_miss="origin", tail_skip=2).collect()
    # slot 1: hop points (9.1, 9.0) then (12.0, 9.0): |dx| = 2.9 > 0.5 -> gated out
    assert [(r.slot, r.x, r.y, r.next_x, r.next_y) for r in pos] == [(0, 0.2, 0.1, 0.5, 0.3)]
    dl = matching.build_transitions(det, hops=2, gate_limit=0.5, mode="delta", radius=5.0,
                                    tail_skip=2).collect()
    r = dl[0]
    assert (r.x, r.y) == pytest.approx((0.2, 0.1))
    assert (r.next_x, r.next_y) == pytest.approx((0.3, 0.2))


def test_tail_skip_follows_frame_count(spark):
    rows = [(f, 0, float(f), 0.0) for f in range(10)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    m = matching.match_next_frame(det, 5.0, "origin")
    la = matching.lookahead(m, hops=2, det=det, tail_skip=5)
    assert sorted(r.frame for r in la.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("tracks,scale", [(4, 1), (1, 1), (150, 1), (4, 1_000_000_007)])
def test_memory_features_equal_window_form(spark, tracks, scale):
    rnd = random.Random(3)
    rows = [(rnd.randrange(tracks), (i * 3 + rnd.randrange(2)) * scale, None if rnd.random() < 0.05 else rnd.random(),
             rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "track long, step long, x double, y double")
    a = matching.memory_features(df, k=4).toPandas().sort_values(["track", "step"]).reset_index(drop=True)
    b = matching.memory_features_window(df, k=4).toPandas().sort_values(["track", "step"]).reset_index(drop=True)
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)


def test_memory_features_drop_rows_with_a_null_lag(spark):
    rows = [(1, i, None if i == 2 else float(i), 0.0) for i in range(8)] + [(None, i, float(i), 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "track long, step long, x double, y double")
    want = [(None, 3), (1, 6), (1, 7)]
    for f in (matching.memory_features, matching.memory_features_window):
        assert sorted(((r.track, r.step) for r in f(df, k=3).collect()), key=str) == sorted(want, key=str)


def test_row_index_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (None, 3), (None, 7)], "g long, o long")
    got = sorted(((r.g, r.o, r.rn) for r in row_index(df, ["g"], "o", "rn").collect()), key=str)
    assert got == sorted([(1, None, 0), (1, 5, 1), (None, 3, 0), (None, 7, 1)], key=str)
    keys = spark.createDataFrame([(3,), (None,), (3,), (1,)], "k long")
    assert sorted(((r.k, r.i) for r in dense_index(keys, "k", "i").collect()), key=str) == \
        sorted([(None, 0), (1, 1), (3, 2)], key=str)


@pytest.mark.parametrize("width", [2, 7, 1 << 16])
def test_row_index_equals_row_number(spark, width):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), i * 2 + 1, rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, o long, v double")
    got = {(r.g, r.o): r.rn for r in row_index(df, ["g"], "o", "rn", bucket_width=width).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, o in enumerate(sorted(o for gg, o, _ in rows if gg == g)):
            want[(g, o)] = i
    assert got == want


def test_dense_index(spark):
    df = spark.createDataFrame([(k,) for k in [5, 9, 5, 100, 3, 9, 40]], "k long")
    got = {r.k: r.i for r in dense_index(df, "k", "i", bucket_width=8).collect()}
    assert got == {3: 0, 5: 1, 9: 2, 40: 3, 100: 4}


def test_detections_fixture_numbering(spark):
    from trailframe import fixtures as fx
    from conftest import SF_SMALL

    det = fx.detections(spark, SF_SMALL)
    agg = det.groupBy("frame").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.min("slot").alias("z"))
    assert agg.where("m != n - 1 or z != 0").count() == 0
    nf = det.select("frame").distinct().count()
    assert det.agg(F.max("frame")).first()[0] == nf - 1


def test_three_hops_and_wide_features(spark):
    from trailframe.operators import regression as RG

    rows = [(f, 0, 1.0 + 0.1 * f, 2.0 + 0.05 * f) for f in range(10)]
    rows += [(f, 1, 50.0 - 0.1 * f, 60.0) for f in range(10)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    tr = matching.build_transitions(det, hops=3, gate_limit=0.5, mode="delta", radius=5.0)
    assert tr.columns == ["frame", "slot", "x1", "y1", "x2", "y2", "next_x", "next_y"]
    r = tr.where("frame = 0 and slot = 0").first()
    assert (r.x1, r.y1, r.x2, r.y2, r.next_x, r.next_y) == pytest.approx((0.1, 0.05, 0.1, 0.05, 0.1, 0.05))
    pair = RG.fit_pair("linear", tr, ("x1", "y1", "x2", "y2"))
    assert pair.predict(tr).count() == tr.count()


def test_frame_numbering_ignores_session_time_zone(spark):
    from conftest import SF_SMALL
    from trailframe import fixtures as fx

    base = fx.derive_detections(spark, SF_SMALL).orderBy("frame", "slot").collect()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = fx.derive_detections(spark, SF_SMALL).orderBy("frame", "slot").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert base == other


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pts=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=40),
       radius=st.sampled_from([1.0, 5.0, 12.5, 30.0]), cell=st.sampled_from([None, 2.0, 7.0, 50.0]))
def test_match_property_equals_brute_force(spark, pts, radius, cell):
    slots = {}
    rows = []
    for f, x, y in pts:
        s = slots.get(f, 0)
        slots[f] = s + 1
        rows.append((f, s, float(x) / 2, float(y) / 2))
    det = spark.createDataFrame(rows, DET_SCHEMA)
    got = {(r.frame, r.slot): r.nslot for r in matching.match_next_frame(det, radius, "null", cell).collect()}
    want = brute_match(rows, radius)
    assert got == {k: (None if w is None else w[1]) for k, w in want.items()}


@pytest.mark.parametrize("seed,radius", [(1, 10.0), (2, 25.0), (3, 1000.0), (4, 0.05)])
def test_tree_equals_brute_force(spark, seed, radius):
    """Also with piles of copies, a dense knot and points far from it."""
    rows = random_det(seed, frames=4, per=60)
    rnd = random.Random(seed)
    for f in range(4):
        knot = [(30 + rnd.gauss(0, 1e-4), 30 + rnd.gauss(0, 1e-4)) for _ in range(80)] + [(5.0, 5.0)] * 40
        rows += [(f, 1000 + k, x, y) for k, (x, y) in enumerate(knot)]
    rows += [(1, 5000, -1e6, 3.0), (2, 5000, -1e6 - 1e-3, 3.0), (7, 1, 0.0, 0.0)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    got = {(r.frame, r.slot): r for r in matching.match_next_frame(det, radius, "null", method="tree").collect()}
    want = brute_match(rows, radius)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.dist, g.nslot, g.nx, g.ny) == ((None,) * 4 if w is None else (pytest.approx(w[0], rel=1e-12), *w[1:]))


def test_tree_odd_rows(spark):
    rows = [(0, 0, None, 1.0), (0, 1, float("nan"), 1.0), (0, 2, 1.0, 1.0), (1, 0, None, None), (1, 1, 1.0, 2.0), (None, 3, 1.0, 1.0)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    got = {(r.frame, r.slot): r.nslot for r in matching.match_next_frame(det, 10.0, "null", method="tree").collect()}
    assert got == {(0, 0): None, (0, 1): None, (0, 2): 1, (1, 0): None, (1, 1): None, (None, 3): None}
    assert matching.match_next_frame(det.limit(0), 10.0, method="tree").count() == 0


def test_tree_in_a_dense_frame(spark):
    """Forty thousand points inside one radius, half of them on a thin
    line: exact, and few candidates a point."""
    from trailframe.operators import cell_tree
    n = 20_000
    det = spark.range(2 * n).select(
        (F.col("id") % 2).alias("frame"), F.floor(F.col("id") / 2).alias("slot"),
        (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 14)).alias("x"),
        F.when(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)) == 0, F.lit(30.0))
        .otherwise(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 20)) / F.lit(1 << 14)).alias("y"))
    pairs = cell_tree.nearest_pairs(det, 100.0).toPandas()
    assert len(pairs) <= 50 * n
    best = pairs.groupby("slot").dist.min()
    assert len(best) == n
    pts = det.toPandas()
    a, b = pts[pts.frame == 0].set_index("slot"), pts[pts.frame == 1]
    bx, by = b.x.to_numpy(), b.y.to_numpy()
    for s in range(0, n, 97):
        d = (bx - a.x[s]) ** 2 + (by - a.y[s]) ** 2
        assert best[s] == math.sqrt(d.min())


def walk(rows, starts, hops):
    """Positions of chained hops, row by row."""
    step = {}
    for f, s, x, y, nx, ny in sorted(rows, key=lambda r: (r[0], r[1])):
        if nx is not None:
            step.setdefault((f, x, y), (nx, ny))
    out = {}
    for f, s, x, y, nx, ny in starts:
        path = [(nx, ny)]
        while len(path) < hops and path[-1] is not None:
            path.append(step.get((f + len(path), *path[-1])))
        if None not in path and nx is not None:
            out[(f, s)] = path
    return out


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 21])
def test_chained_paths_equal_a_walk(spark, hops):
    rnd = random.Random(hops)
    pos = {f: [(float(rnd.randrange(6)), float(rnd.randrange(6))) for _ in range(8)] for f in range(30)}
    rows = [(f, s, *p, *(rnd.choice(pos[f + 1]) if f < 29 and rnd.random() < 0.98 else (None, None)))
            for f in pos for s, p in enumerate(pos[f])]
    m = spark.createDataFrame(rows, "frame long, slot long, x double, y double, nx double, ny double")
    got = {(r.frame, r.slot): [tuple(p) for p in r.path]
           for r in matching.chained_paths(m, m.where("nx is not null"), hops).collect()}
    want = walk(rows, rows, hops)
    assert got == want and len(want) > 0


def test_chained_lookahead_joins_few_times(spark, monkeypatch):
    """32 hops: four doublings and two lookups."""
    joins = []
    real = type(spark.range(1)).join

    def seen(self, *a, **k):
        joins.append(1)
        return real(self, *a, **k)

    rows = [(f, s, float(s), 0.0, float(s), 0.0) for f in range(40) for s in range(3)]
    m = spark.createDataFrame(rows, "frame long, slot long, x double, y double, nx double, ny double")
    monkeypatch.setattr(type(m), "join", seen)
    la = matching.lookahead(m, hops=32, chain=True, tail_skip=5)
    assert len(joins) == 6
    assert la.count() == 3 * 9 and la.columns[-2:] == ["nx31", "ny31"]


def test_chained_lookahead_broadcasts_no_facts(spark, tmp_dir):
    # constant columns: files of a few KB, far more rows than the driver should hold
    path = f"{tmp_dir}/det"
    (spark.range(20000).select((F.col("id") % 8).alias("frame"), F.col("id").alias("slot"),
                               F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).write.parquet(path))
    det = spark.read.parquet(path)
    for df in (matching.match_next_frame(det, on_miss="drop"),
               matching.lookahead(matching.match_next_frame(det, on_miss="drop"), hops=3, chain=True, det=det, tail_skip=1)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("radius", [10.0, 1000.0])
def test_deep_tree_equals_the_grid(spark, radius, monkeypatch):
    """Cells of a few points, piles of query points, repeated and missing slots."""
    from trailframe.operators import cell_tree
    monkeypatch.setattr(cell_tree, "CHUNK", 7)
    rnd = random.Random(5)
    rows = random_det(5, frames=3, per=40)
    rows += [(f, rnd.choice([None, 3, 4, 900]), float(rnd.randrange(12)), float(rnd.randrange(12)))
             for f in range(3) for _ in range(60)]
    rows += [(0, 2000 + k, 20.0, 20.0) for k in range(30)] + [(1, 1, -4e5, 7.0), (0, 1, -4e5, 7.5), (0, 1, -4e5, 7.5)]
    det = spark.createDataFrame(rows, DET_SCHEMA)
    got = sorted(map(str, cell_tree.nearest(det, radius, block=4, leaf=2).collect()))
    grid = matching.match_next_frame(det, radius, "null", cell=1000.0).select("frame", "slot", "x", "y", "dist", "nslot", "nx", "ny")
    # the grid shows no distance to a point without a slot
    want = sorted(map(str, grid.collect()))
    got = [g if "nslot=None" not in g else g[:g.index("dist=")] + "dist=None, " + g[g.index("nslot="):] for g in got]
    assert got == want


def test_tree_writes_points_a_fixed_number_of_times(spark, monkeypatch):
    """However deep the tree: no search state of every point at each level."""
    from trailframe.operators import cell_tree
    n, written = 20_000, []
    real = cell_tree.materialize

    def seen(df, name):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(cell_tree, "materialize", seen)
    det = spark.range(2 * n).select(
        (F.col("id") % 2).alias("frame"), F.floor(F.col("id") / 2).alias("slot"),
        (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 14)).alias("x"),
        (F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 20)) / F.lit(1 << 14)).alias("y"))
    assert matching.match_next_frame(det, 100.0, "drop", method="tree").count() == n
    # candidates, homes and what was found: twice, twice and once each frame of n
    assert sum(written) < 6 * n


@pytest.mark.parametrize("hops,shown", [(1, (0,)), (2, (1,)), (5, (0, 4)), (8, (3, 2)), (21, (0, 7, 20)), (17, (5,)), (32, (0, 15, 31))])
def test_chained_positions_equal_a_walk(spark, hops, shown, monkeypatch):
    """No table and no row holds more than the positions asked for."""
    rnd = random.Random(hops)
    pos = {f: [(float(rnd.randrange(6)), float(rnd.randrange(6))) for _ in range(8)] for f in range(40)}
    rows = [(f, s, *p, *(rnd.choice(pos[f + 1]) if f < 39 and rnd.random() < 0.98 else (None, None)))
            for f in pos for s, p in enumerate(pos[f])]
    m = spark.createDataFrame(rows, "frame long, slot long, x double, y double, nx double, ny double")
    wide = []
    real = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, name: wide.append(df.dtypes) or real(df, name))
    la = matching.lookahead(m.where("nx is not null"), hops=hops, chain=True, det=m, tail_skip=0, shown=shown)
    got = {(r.frame, r.slot): [(r[f"nx{h}"], r[f"ny{h}"]) for h in sorted(shown)] for r in la.collect()}
    want = {k: [p[h] for h in sorted(shown)] for k, p in walk(rows, rows, hops).items()}
    assert got == want and len(want) > 0
    assert all(len(t) == 5 and not any("array" in kind for _, kind in t) for t in wide)
