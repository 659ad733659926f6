"""The full-size queries that have no SQL, recomputed on small tables."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from conftest import SF_SMALL
from trailframe.operators import mlp
from trailframe.operators import regression as RG
from trailframe.plans import full_queries as Q
from trailframe.plans import model_queries as MQ


@pytest.fixture()
def trans(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 240
    x, y = rng.normal(0, 3, n), rng.normal(0, 3, n)
    rows = [(i // 8, i % 8, float(a), float(b), float(0.6 * a + 0.1 * b + e), float(0.5 * b - 0.2 * a + f))
            for i, (a, b, e, f) in enumerate(zip(x, y, *rng.normal(0, 0.3, (2, n))))]
    df = spark.createDataFrame(rows, "frame long, slot long, x double, y double, next_x double, next_y double")
    monkeypatch.setattr(MQ, "transitions", lambda spark, sf: df)
    return df


def is_train(key):
    return int(hashlib.md5(f"{MQ.SPLIT_SEED}:{key}".encode()).hexdigest()[:15], 16) < int(0.7 * (1 << 60))


def least_squares(train, test, label):
    a = np.column_stack([train[["x", "y"]], np.ones(len(train))])
    w = np.linalg.lstsq(a, train[label], rcond=None)[0]
    return np.sqrt(np.mean((np.column_stack([test[["x", "y"]], np.ones(len(test))]) @ w - test[label]) ** 2))


def direct(df, kind, label, on):
    """RMSE of one kind, fitted by itself."""
    train, test = (df.where(RG.hash_split_flag(on, MQ.SPLIT_SEED, 0.7) == f) for f in (True, False))
    if kind == "net":
        p = mlp.fit_mlp(train, ("x", "y"), label).transform(test, "p")
    else:
        p = RG.fit(kind, RG.assemble(train, ("x", "y")), label, MQ.SPLIT_SEED).transform(
            RG.assemble(test, ("x", "y"))).withColumnRenamed(f"pred_{label}", "p")
    d = p.select("p", label).toPandas()
    return np.sqrt(np.mean((d.p - d[label]) ** 2))


def test_model_report_full(spark, trans):
    got = {r.model: (r.rmse_x, r.rmse_y) for r in Q.q_model_report_full(spark, "").collect()}
    assert sorted(got) == sorted(Q.KINDS)
    p = trans.toPandas()
    p["t"] = [is_train(f * 1000003 + s) for f, s in zip(p.frame, p.slot)]
    for k, label in enumerate(("next_x", "next_y")):
        assert got["linear"][k] == pytest.approx(least_squares(p[p.t], p[~p.t], label), abs=2e-4)
    for kind in ("tree", "forest", "gbt", "isotonic", "net"):
        assert got[kind][0] == pytest.approx(direct(trans, kind, "next_x", MQ.split_key()), abs=2e-4)
        assert got[kind][0] < p[~p.t].next_x.std() * 1.1


def test_model_report_files_full(spark, trans):
    got = {r.model: (r.rmse_x, r.rmse_y) for r in Q.q_model_report_files_full(spark, "").collect()}
    assert sorted(got) == sorted(Q.KINDS)
    p = trans.toPandas()
    for k, label in enumerate(("next_x", "next_y")):
        key = [",".join(str(int(np.floor(abs(v) * 1e6 + 0.5) * np.sign(v))) for v in r)
               for r in p[["x", "y", label]].to_numpy()]
        t = np.array([is_train(x) for x in key])
        assert got["linear"][k] == pytest.approx(least_squares(p[t], p[~t], label), abs=2e-4)
    assert all(0 < v < 10 for r in got.values() for v in r)


def lags(spark):
    t = pd.DataFrame([r.asDict() for r in Q.fx.tracks(spark, SF_SMALL).collect()]).sort_values(["track", "step"])
    for i in range(1, 5):
        for c in ("x", "y"):
            t[f"{c}{i}"] = t.groupby("track")[c].shift(5 - i)
    return t.dropna()


def weights(m, label):
    return np.linalg.lstsq(np.column_stack([m[list(Q.MEMORY)], np.ones(len(m))]), m[label], rcond=None)[0]


def test_memory_of_four(spark):
    m = lags(spark)
    w = {f"next_{c}": weights(m, c) for c in ("x", "y")}
    for r in Q.q_memory_fit_linear_4(spark, SF_SMALL).collect():
        assert [*(r[c] for c in Q.MEMORY), r.intercept] == pytest.approx(w[r.label], abs=2e-3)
    got = {(r.track, r.origin, r.step): r for r in Q.q_memory_forecast_4(spark, SF_SMALL).collect()}
    assert len(got) == 4 * len(m)
    for row in m.itertuples():
        held = [getattr(row, f"{c}{i}") for i in range(2, 5) for c in ("x", "y")] + [row.x, row.y]
        cx = cy = 0.0
        for step in range(1, 4):
            v = [float(np.dot(w[f"next_{c}"], [*held, 1.0])) for c in ("x", "y")]
            held = [*held[2:], *v]
            cx, cy = cx + v[0], cy + v[1]
            g = got[(row.track, row.step, step)]
            assert (g.cx, g.cy, g.vx, g.vy) == pytest.approx((cx, cy, *v), abs=5e-3, rel=1e-4)


def lloyd(p, c, passes, tol):
    for _ in range(passes):
        a = ((p[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([p[a == j].mean(0) if (a == j).any() else c[j] for j in range(len(c))])
        moved, c = np.abs(new - c).max(), new
        if moved <= tol:
            break
    return c


def test_extract_detections_full(spark):
    got = Q.q_extract_detections_full(spark, SF_SMALL).toPandas()
    li = pd.read_parquet(f"{SF_SMALL}/lineitem.parquet")
    li["rgb"] = (li.l_partkey * 7919 + li.l_suppkey * 104729 + li.l_linenumber * 31) % 16777216
    li["v"] = 255 - (li.rgb // 65536 + li.rgb // 256 % 256 + li.rgb % 256) / 3
    frames = 0
    for f, d in li.sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).groupby(li.l_suppkey % 64):
        at = np.flatnonzero(d.v.to_numpy() > 100.0)
        g = got[got.frame == f].sort_values("slot")
        if not len(at):
            assert not len(g)
            continue
        order = sorted(range(len(at)), key=lambda i: hashlib.md5(f"7:{at[i]}".encode()).hexdigest())[:20]
        p = np.column_stack([at, np.zeros(len(at))]).astype(float)
        assert g[["x", "y"]].to_numpy() == pytest.approx(lloyd(p, p[order], 1000, 1e-6), abs=2e-6)
        frames += 1
    assert frames > 5


def test_balanced_clusters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(30, 1, (40, 2)), rng.normal((0, 30), 1, (20, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    monkeypatch.setattr(Q.fx, "points", lambda spark, sf: df)
    monkeypatch.setattr(Q, "BALANCED_K", 6)
    got = Q.q_balanced_clusters(spark, "").toPandas()
    spread = {}
    for kind, g in got.groupby("kind"):
        g = g.sort_values("cid")
        c = g[["x", "y"]].to_numpy()
        near = ((p[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        assert np.bincount(near, minlength=len(c)).tolist() == g.n.tolist() and g.n.sum() == len(p)
        spread[kind] = ((g.n - g.n.mean()) ** 2).sum() / g.n.sum()
        if kind == "balanced":  # a settled clustering
            assert lloyd(p, c, 1, 0.0) == pytest.approx(c, abs=1e-5)
    assert spread["balanced"] <= spread["plain"] + 1e-9
