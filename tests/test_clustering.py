"""J3, M5-M10, A4-A7, A10, L1, L2, E1 against numpy and hand-worked cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.operators import clustering as C
from trailframe.plans import cluster_queries


def pts_df(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                                 "id long, x double, y double")


def blobs(seed=0, sizes=(40, 25, 10), centers=((0, 0), (50, 0), (0, 60))):
    rnd = np.random.default_rng(seed)
    out = []
    for n, (cx, cy) in zip(sizes, centers):
        out += [(cx + rnd.normal(0, 3), cy + rnd.normal(0, 3)) for _ in range(n)]
    return out


def np_assign(pts, centers):
    p = np.array(pts)
    c = np.array([(x, y) for _, x, y in centers])
    d2 = ((p[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    return [centers[i][0] for i in d2.argmin(1)]


def test_assign_nearest_matches_numpy_and_ties_to_low_id(spark):
    pts = blobs()
    df = pts_df(spark, pts)
    cs = [(0, 1.0, 1.0), (1, 45.0, 2.0), (2, 3.0, 55.0)]
    got = [r.cid for r in C.assign_nearest(df, cs).orderBy("id").collect()]
    assert got == np_assign(pts, cs)
    tie = pts_df(spark, [(0.0, 0.0)])
    assert C.assign_nearest(tie, [(5, 1.0, 0.0), (2, -1.0, 0.0)]).first().cid == 2


def md5_key(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def test_many_centres_as_list_and_as_table(spark):
    rnd = random.Random(1)
    pts = [(rnd.uniform(0, 100), rnd.uniform(0, 100)) for _ in range(300)]
    cs = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(500)]
    got = [r.cid for r in C.assign_nearest(pts_df(spark, pts), cs).orderBy("id").collect()]
    assert got == np_assign(pts, cs)
    table = spark.createDataFrame(cs, "cid int, x double, y double")
    got = [r.cid for r in C.assign_nearest(pts_df(spark, pts), table).orderBy("id").collect()]
    assert got == np_assign(pts, cs)


def test_lloyd_cost_never_increases_and_converges(spark):
    pts = blobs(2)
    df = pts_df(spark, pts)
    init = C.initial_centers(df, 3, seed=7)
    res = C.lloyd(df, init, max_iter=30)
    costs = [C.clustering_cost(df, h).first().cost for h in res.history]
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))
    assert res.converged
    # numpy Lloyd from the same start
    p = np.array(pts)
    c = np.array([(x, y) for _, x, y in init])
    for _ in range(30):
        a = ((p[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([p[a == j].mean(0) if (a == j).any() else c[j] for j in range(len(c))])
    assert np.allclose(np.array([(x, y) for _, x, y in res.centers]), c)


def test_lloyd_same_result_for_any_partitioning(spark):
    df = pts_df(spark, blobs(4))
    init = C.initial_centers(df, 3, seed=9)
    a = C.lloyd(df.repartition(1), init, max_iter=10).centers
    b = C.lloyd(df.repartition(7), init, max_iter=10).centers
    assert np.allclose(np.array(a), np.array(b))


def test_empty_cluster_keep_and_drop(spark):
    df = pts_df(spark, [(0.0, 0.0), (1.0, 0.0)])
    cs = [(0, 0.5, 0.0), (1, 100.0, 100.0)]
    assert C.lloyd_step(df, cs, "keep") == [(0, 0.5, 0.0), (1, 100.0, 100.0)]
    assert C.lloyd_step(df, cs, "drop") == [(0, 0.5, 0.0)]


def test_same_centers_is_containment():
    assert C.same_centers([(0, 1.0, 2.0), (1, 3.0, 4.0)], [(7, 3.0, 4.0), (8, 1.0, 2.0)])
    assert not C.same_centers([(0, 1.0, 2.0)], [(0, 1.0, 2.1)])
    assert C.same_centers([(0, 1.0, 2.0)], [(0, 1.0, 2.1)], tol=0.2)


def test_sizes_imbalance_and_member(spark):
    df = pts_df(spark, blobs(5))
    cs = [(0, 0.0, 0.0), (1, 50.0, 0.0), (2, 0.0, 60.0)]
    a = C.assign_nearest(df, cs)
    sizes = [(r.cid, r.n) for r in C.cluster_sizes(a).collect()]
    assert sizes == [(2, 10), (1, 25), (0, 40)]
    im = C.imbalance(a).first()
    mu = 75 / 3
    assert im.k == 3 and im.mean_size == pytest.approx(mu) and im.n_points == 75
    assert im.imbalance == pytest.approx(((mu - 40) ** 2 + (mu - 25) ** 2 + (mu - 10) ** 2) / 75)
    sd = C.imbalance(a, kind="stddev").first().imbalance
    assert sd == pytest.approx(np.std([40, 25, 10]))
    m = {r.cid: r.id for r in C.random_member(a, seed=11).collect()}
    pdf = a.toPandas()
    for c, i in m.items():
        mem = pdf[pdf.cid == c].id
        want = min(mem, key=lambda v: (md5_key(11, v), v))
        assert i == want


def test_random_rows_stable_under_repartitioning(spark):
    df = pts_df(spark, blobs(6))
    a = [r.id for r in C.random_rows(df.repartition(1), 5, 3).collect()]
    b = [r.id for r in C.random_rows(df.repartition(6), 5, 3).collect()]
    assert a == b and len(a) == 5


def test_sample_is_spread_over_all_ids(spark):
    df = spark.range(10_000_000).withColumnRenamed("id", "id")
    ids = np.array([r.id for r in C.random_rows(df, 1000, 7).collect()])
    assert len(set(ids)) == 1000
    deciles = np.histogram(ids, bins=10, range=(0, 10_000_000))[0]
    assert deciles.min() >= 60 and deciles.max() <= 140


def test_sample_keys_of_any_size(spark):
    big = 2 ** 50
    df = spark.createDataFrame([(big + i, float(i), 0.0) for i in range(20)] + [(2 ** 63 - 1, 1.0, 1.0)],
                               "id long, x double, y double")
    assert C.random_rows(df, 5, 7).count() == 5
    a = C.assign_nearest(df, [(0, 0.0, 0.0), (1, 19.0, 0.0)])
    assert C.random_member(a, 7).count() == 2


def test_large_frame_is_cut_into_salts(spark):
    rows = [(0 if s % 3 else 1, s, float(s % 7), float(s % 5)) for s in range(300)]
    det = spark.createDataFrame(rows, "frame long, slot long, x double, y double")
    a = {(r.frame, r.cid): (r.x, r.y) for r in C.frame_kmeans(det, k=3, passes=4, seed=7, rows_per_part=16).collect()}
    b = {(r.frame, r.cid): (r.x, r.y) for r in C.frame_kmeans(det, k=3, passes=4, seed=7).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_frame_passes_do_not_move_points(spark):
    det = spark.createDataFrame([(f, s, float(s), 0.0) for f in range(5) for s in range(40)],
                                "frame long, slot long, x double, y double")
    pts, salts = C._dealt_points(det, "frame", "slot", 1000)
    pts.count()
    step = C.frame_lloyd_step(pts, salts, C.frame_initial_centers(pts, 3, 7))
    step.collect()
    plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the kept points feed the join directly: no exchange right above their scan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "InMemoryTableScan" in line:
            assert not any("Exchange hashpartitioning(frame" in x and "_salt" in x for x in lines[max(0, i - 4):i])
    assert plan.count("array_min") <= 2
    pts.unpersist()


def test_frame_kmeans_flag(spark):
    det = spark.createDataFrame([(f, s, float(s * s), 0.0) for f in range(3) for s in range(3 + 10 * f)],
                                "frame long, slot long, x double, y double")
    few = C.frame_kmeans(det, k=3, passes=1, seed=7, tol=0.0, with_flag=True).toPandas()
    many = C.frame_kmeans(det, k=3, passes=40, seed=7, tol=1e-9, with_flag=True).toPandas()
    assert few[few.frame == 0].converged.all() and not few[few.frame == 2].converged.any()
    assert many.converged.all()


def test_is_nearest(spark):
    df = pts_df(spark, blobs(8))
    model = C.kmeans(df, k=3, seed=1)
    a = C.cluster_assign(model, df)
    assert a.filter(~C.is_nearest(model, ("x", "y"))).count() == 0
    wrong = a.withColumn("prediction", (F.col("prediction") + 1) % 3)
    assert wrong.filter(C.is_nearest(model, ("x", "y"))).count() == 0


def test_frame_kmeans_matches_per_frame_numpy(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for f in range(4):
        for s in range(30):
            cx, cy = [(0, 0), (40, 40)][s % 2]
            rows.append((f, s, float(cx + rnd.normal(0, 2) + f), float(cy + rnd.normal(0, 2))))
    det = spark.createDataFrame(rows, "frame long, slot long, x double, y double")
    got = C.frame_kmeans(det, k=2, passes=3, seed=7).toPandas()
    for f in range(4):
        fr = [(s, x, y) for ff, s, x, y in rows if ff == f]
        init = sorted(fr, key=lambda t: (md5_key(7, t[0]), t[0]))[:2]
        c = np.array([(x, y) for _, x, y in init])
        p = np.array([(x, y) for _, x, y in fr])
        for _ in range(3):
            a = ((p[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            c = np.array([p[a == j].mean(0) if (a == j).any() else c[j] for j in range(2)])
        g = got[got.frame == f].sort_values("cid")[["x", "y"]].to_numpy()
        assert np.allclose(g, c)


def test_split_oversized_victims(spark):
    pts = [(0.0, float(i)) for i in range(10)] + [(100.0, 0.0), (101.0, 0.0), (200.0, 0.0)]
    df = pts_df(spark, pts)
    cs = [(0, 0.0, 4.5), (1, 100.5, 0.0), (2, 200.0, 0.0)]
    sizes = {0: 10, 1: 2, 2: 1}
    small = C.split_oversized(df, cs, sizes, tolerance=0.5, seed=11, victim="smallest")
    # cluster 0 is oversized; the smallest (2) moves onto one of its members
    assert small[0] == cs[0] and small[1] == cs[1]
    assert small[2][1] == 0.0 and 0.0 <= small[2][2] <= 9.0
    first = C.split_oversized(df, cs, sizes, tolerance=0.5, seed=11, victim="first")
    assert first[1:] == cs[1:] and first[0][1] == 0.0


def test_similar_size_kmeans_bounded_and_reproducible(spark):
    df = pts_df(spark, blobs(7, sizes=(60, 10, 10)))
    a = C.similar_size_kmeans(df, k=3, breakpoint=1.0, tolerance=0.5, seed=3, max_rounds=4, max_iter=15)
    b = C.similar_size_kmeans(df, k=3, breakpoint=1.0, tolerance=0.5, seed=3, max_rounds=4, max_iter=15)
    assert a.centers == b.centers and a.rounds <= 4
    assert sum(a.sizes.values()) == 80


def test_pyspark_kmeans_assignment_is_nearest_returned_centre(spark):
    pts = blobs(8)
    df = pts_df(spark, pts)
    model = C.kmeans(df, k=3, seed=1)
    cs = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    got = [r.prediction for r in C.cluster_assign(model, df).orderBy("id").collect()]
    assert got == np_assign(pts, cs)
    cc = C.cluster_centers(model, spark)
    assert cc.columns == ["cid", "c0", "c1"] and cc.count() == 3


def test_kmeans_fewer_centres_than_k(spark):
    df = pts_df(spark, [(1.0, 1.0), (1.0, 1.0), (5.0, 5.0)])
    model = C.kmeans(df, k=4, seed=1)
    assert len(model.clusterCenters()) <= 4


def test_cost_distance(spark):
    df = pts_df(spark, [(0.0, 0.0), (2.0, 0.0)])
    r = C.clustering_cost(df, [(0, 1.0, 0.0)]).first()
    assert (r.cost, r.cost_distance, r.n) == (2.0, 1.0, 2)
    assert df.select(F.lit(1)).count() == 2


def test_members_oversized_undersized(spark):
    df = pts_df(spark, blobs(5))
    a = C.assign_nearest(df, [(0, 0.0, 0.0), (1, 50.0, 0.0), (2, 0.0, 60.0)])
    assert C.cluster_members(a, 1).count() == 25
    sizes = a.groupBy("cid").agg(F.count("*").alias("n"))
    mu, n = 25.0, 75
    s = ((mu - 40) ** 2 + (mu - 25) ** 2 + (mu - 10) ** 2) / n
    big = [r.cid for r in C.oversized(sizes, 0.1).collect()]
    small = [r.cid for r in C.undersized(sizes, 0.1).collect()]
    assert big == [c for c, k in ((0, 40), (1, 25), (2, 10)) if k > mu + s * 0.1]
    assert small == [c for c, k in ((2, 10), (1, 25), (0, 40)) if k < mu - s * 0.1]


def test_frame_kmeans_early_stop_gives_the_converged_centres(spark):
    rows = [(f, s, float((s % 2) * 40 + s * 0.01), float((s % 2) * 40)) for f in range(3) for s in range(20)]
    det = spark.createDataFrame(rows, "frame long, slot long, x double, y double")
    full = sorted(C.frame_kmeans(det, k=2, passes=15, seed=7).collect())
    early = sorted(C.frame_kmeans(det, k=2, passes=15, seed=7, tol=1e-9).collect())
    assert [(r.frame, r.cid) for r in full] == [(r.frame, r.cid) for r in early]
    for a, b in zip(full, early):
        assert a.x == pytest.approx(b.x) and a.y == pytest.approx(b.y)


def test_frame_kmeans_query_runs_until_settled(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(f, s, float(x), float(y)) for f in range(3) for s, (x, y) in enumerate(rnd.uniform(0, 700, (400, 2)))]
    det = spark.createDataFrame(rows, "frame long, slot long, x double, y double")
    monkeypatch.setattr(cluster_queries.fx, "detections", lambda spark, sf: det)
    got = cluster_queries.q_frame_kmeans(spark, "").toPandas()
    assert got.converged.all()
    passes = []
    for f in range(3):
        fr = [(s, x, y) for ff, s, x, y in rows if ff == f]
        p = np.array([(x, y) for _, x, y in fr])
        c = np.array([(x, y) for _, x, y in sorted(fr, key=lambda t: (md5_key(7, t[0]), t[0]))[:20]])
        for n in range(1, 1000):
            a = ((p[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([p[a == j].mean(0) if (a == j).any() else c[j] for j in range(20)])
            moved, c = np.abs(new - c).max(), new
            if moved <= 1e-6:
                break
        passes.append(n)
        assert np.allclose(got[got.frame == f].sort_values("cid")[["x", "y"]].to_numpy(), c, atol=2e-6)
    assert max(passes) > 10


def test_frame_kmeans_bound_raises(spark):
    det = spark.createDataFrame([(0, s, float(s * s), 0.0) for s in range(40)],
                                "frame long, slot long, x double, y double")
    with pytest.raises(RuntimeError):
        C.frame_kmeans(det, k=3, passes=1, seed=7, tol=1e-9, settle=True)


def test_cut_frames_equal_whole_frames(spark):
    """Frames of very different sizes: the delta iteration, which drops
    settled frames, gives what one task per frame gives."""
    rnd = np.random.default_rng(8)
    rows = [(f, s, float(x), float(y)) for f, n in enumerate([1, 2, 30, 60, 400, 400, 5])
            for s, (x, y) in enumerate(rnd.uniform(0, 100, (n, 2)))]
    rows += [(None, 1, 1.0, 1.0), (2, 99, None, 1.0)]
    det = spark.createDataFrame(rows, "frame long, slot long, x double, y double")
    for on_empty in ("keep", "drop"):
        kw = dict(k=6, passes=200, seed=7, tol=1e-9, with_flag=True, settle=True, on_empty=on_empty)
        a = {(r.frame, r.cid): r for r in C.frame_kmeans(det, **kw).collect()}
        b = {(r.frame, r.cid): r for r in C.frame_kmeans(det, rows_per_part=25, **kw).collect()}
        assert a.keys() == b.keys() and {f for f, _ in a} == set(range(7))
        for k in a:
            assert (a[k].x, a[k].y) == pytest.approx((b[k].x, b[k].y)) and a[k].converged and b[k].converged


def _plain_lloyd(x, y, k, passes, tol, on_empty):
    ids, cx, cy = np.arange(min(k, x.size)), x[:k].copy(), y[:k].copy()
    moved = np.ones(ids.size, dtype=bool)
    for _ in range(passes):
        near = ((x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2).argmin(axis=1)
        n = np.bincount(near, minlength=ids.size)
        keep = n > 0 if on_empty == "drop" else np.ones(ids.size, dtype=bool)
        sx, sy = (np.bincount(near, weights=w, minlength=ids.size) for w in (x, y))
        nx, ny = np.where(n > 0, sx / np.maximum(n, 1), cx), np.where(n > 0, sy / np.maximum(n, 1), cy)
        ids, cx, cy, nx, ny = (v[keep] for v in (ids, cx, cy, nx, ny))
        far = np.maximum(abs(nx - cx), abs(ny - cy))
        moved, cx, cy = far > (tol or 0.0), nx, ny
        if not moved.any():
            break
    return ids, cx, cy, moved


@pytest.mark.parametrize("on_empty", ["keep", "drop"])
@pytest.mark.parametrize("passes,tol", [(0, None), (3, None), (500, 1e-6), (500, 0.5)])
def test_lloyd_forms_agree_with_all_distances(on_empty, passes, tol):
    rng = np.random.default_rng(5)
    frames = [rng.integers(0, 9, (2, n)).astype(float) for n in (1, 2, 3, 7, 40, 300)]
    frames += [rng.normal(0, 30, (2, 5000)), np.stack([np.arange(900.0), np.zeros(900)])]
    start = np.concatenate(([0], np.cumsum([f.shape[1] for f in frames])))
    x, y = np.concatenate(frames, axis=1)
    many = C._lloyd_many(x, y, start, 5, passes, tol, on_empty)
    for i, (fx, fy) in enumerate(frames):
        want = _plain_lloyd(fx, fy, 5, passes, tol, on_empty)
        one = C._lloyd_numpy(fx, fy, fx[:5], fy[:5], passes, tol, on_empty)
        for got in (one, tuple(v[many[0] == i] for v in many[1:])):
            assert got[0].tolist() == want[0].tolist() and got[3].tolist() == want[3].tolist()
            assert np.allclose(got[1], want[1], atol=1e-9) and np.allclose(got[2], want[2], atol=1e-9)


def test_many_small_frames_share_a_python_call(spark):
    # a group a frame costs a call a frame; 20,000 frames took minutes of task time
    pts = spark.range(60000).select((F.col("id") % 20000).alias("frame"), F.col("id").alias("slot"),
                                    (F.col("id") % 101).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = C.frame_kmeans(pts, k=2, passes=4)
    assert got.count() == 40000
    plan = C._whole_frames(pts, 2, 4, 7, "frame", "slot", "keep", None)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
