"""Rolled-out trees and nets against Spark's own scoring, step by step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from trailframe.functions.scalar import rounded
from trailframe.operators import forecast as FC
from trailframe.operators import regression as RG
from trailframe.operators import rollout as RO
from trailframe.plans import full_queries as Q
from trailframe.plans import model_queries as MQ


@pytest.fixture(scope="module")
def moves(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 2, (2, 400))
    # y takes four values: the indexer makes it a category
    y = np.round(np.clip(y, -1.4, 1.4))
    rows = [(float(a), float(b), float(np.sin(a) + b), float(a * b / 3)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "x double, y double, next_x double, next_y double").persist()


OPTIONS = {"tree": {}, "forest": {"numTrees": 7}, "gbt": {"maxIter": 6}, "net": {"epochs": 3}}


@pytest.mark.parametrize("kind", RO.KINDS)
def test_scores_equal_the_models(spark, moves, kind):
    pair = RG.fit_pair(kind, moves, **OPTIONS[kind])
    rows = [(float(a), float(b)) for a, b in np.random.default_rng(4).normal(0, 3, (300, 2))]
    # known categories, unknown ones, exact thresholds and far values
    rows += [(float(a), float(b)) for a in (-1e9, 0.0, -0.0, 1e9) for b in (-1.0, 0.0, 1.0, 7.0, -0.0)]
    got = pair.predict(spark.createDataFrame(rows, "x double, y double")).select("x", "y", "pred_next_x", "pred_next_y")
    got = np.array([list(r) for r in got.collect()])
    for i, score in enumerate(RO.scorers(pair, spark)):
        assert np.allclose(score(got[:, :2]), got[:, 2 + i], rtol=0, atol=1e-9)


@pytest.mark.parametrize("kind", ["forest", "net"])
def test_paths_equal_single_steps_of_the_model(spark, moves, kind):
    pair = RG.fit_pair(kind, moves, **OPTIONS[kind])
    agents = FC.initial_agents(spark, 12, seed=5)
    got = FC.forecast(agents, pair, n_steps=5, dt=0.5, speed=2.0, block=2).toPandas()
    assert len(got) == 12 * 6
    now = agents.toPandas().sort_values("agent")
    for step in range(6):
        rows = got[got.step == step].sort_values("agent")
        assert np.allclose(rows[["cx", "cy", "vx", "vy"]], now[["cx", "cy", "vx", "vy"]], atol=1e-9)
        at = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(now.agent, now.vx, now.vy)],
                                   "agent long, x double, y double")
        new = pair.predict(at).select("agent", "pred_next_x", "pred_next_y").toPandas().sort_values("agent")
        now = now.assign(vx=new.pred_next_x.values, vy=new.pred_next_y.values)
        now = now.assign(cx=now.cx + now.vx, cy=now.cy + now.vy)


def test_the_plan_does_not_grow_with_the_steps(spark, moves):
    pair = RG.fit_pair("forest", moves, numTrees=3)
    agents = FC.initial_agents(spark, 5)
    state = ("cx", "cy", "vx", "vy")
    plans = [RO.rollout(agents, pair, ("agent",), state, 0, n, 1.0, 1.0)._jdf.queryExecution().optimizedPlan().toString()
             for n in (2, 500)]
    assert [p.count("\n") for p in plans] == [plans[0].count("\n")] * 2
    assert RO.rollout(agents, pair, ("agent",), state, 0, 500, 1.0, 1.0).count() == 5 * 501


def test_memory_and_missing_velocities(spark):
    rng = np.random.default_rng(8)
    feats = ("x1", "y1", "x2", "y2")
    rows = [tuple(float(v) for v in r) for r in rng.normal(0, 1, (200, 6))]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*feats, "next_x", "next_y")))
    pair = RG.fit_pair("tree", train, feats)
    schema = "agent long, cx double, cy double, vx double, vy double, m_x1 double, m_y1 double, m_x2 double, m_y2 double"
    agents = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0, 0.3, 0.4, 1.0, 2.0), (2, 0.0, None, 1.0, 2.0, 0.3, 0.4, 1.0, 2.0),
                                    (3, 0.0, 0.0, 1.0, 2.0, None, 0.4, 1.0, 2.0), (None, 0.0, 0.0, 1.0, 2.0, 0.3, 0.4, 1.0, 2.0)], schema)
    got = {(r.agent, r.step): r for r in FC.forecast(agents, pair, n_steps=3, dt=1.0, speed=1.0, block=2).collect()}
    assert len(got) == 16
    fx, fy = RO.scorers(pair, spark)
    buf, c = [0.3, 0.4, 1.0, 2.0], [0.0, 0.0]
    for step in (1, 2, 3):
        x = np.array([buf])
        v = [fx(x)[0], fy(x)[0]]
        c, buf = [c[0] + v[0], c[1] + v[1]], buf[2:] + v
        for agent in (1, None):
            r = got[agent, step]
            assert (r.cx, r.cy, r.vx, r.vy) == pytest.approx((*c, *v))
        assert got[2, step].cx == got[1, step].cx and got[2, step].cy is None
        assert got[3, step].vx is None and got[3, step].cx is None
    empty = FC.forecast(agents.where("agent > 9"), pair, n_steps=3, dt=1.0, speed=1.0)
    assert empty.count() == 0 and empty.columns == ["agent", "step", "cx", "cy", "vx", "vy"]


@pytest.mark.parametrize("query,kind", [(Q.q_forecast_forest, "forest"), (Q.q_forecast_net, "net")])
def test_queries_start_at_the_agents_and_follow_the_model(spark, query, kind, monkeypatch):
    monkeypatch.setattr(Q, "STEPS", 3)
    got = query(spark, SF_SMALL).toPandas().set_index(["frame", "slot", "step"]).sort_index()
    agents = MQ.moving_agents(spark, SF_SMALL).toPandas()
    assert len(got) == 4 * len(agents) > 0
    pair = RG.fit_pair(kind, MQ.transitions(spark, SF_SMALL), ("x", "y"))
    now = spark.createDataFrame(agents).select("frame", "slot", "vx", "vy")
    one = pair.predict(now.withColumnRenamed("vx", "x").withColumnRenamed("vy", "y")).toPandas().set_index(["frame", "slot"])
    first = got.xs(1, level="step")
    assert np.abs(first.vx - one.pred_next_x.reindex(first.index)).max() < 1e-3


@pytest.mark.parametrize("kind", ["tree", "forest", "gbt"])
def test_continuous_trees_are_looked_up_not_walked(spark, moves, kind, monkeypatch):
    rows = moves.selectExpr("x", "x * 0.3 + y as y", "next_x", "next_y")
    score = RO.scorers(RG.fit_pair(kind, rows, **OPTIONS[kind]), spark)[0]
    flat = score.__self__
    used, cuts, _ = flat.table
    x = np.random.default_rng(8).normal(0, 4, (3000, 2))
    for f, c in zip(used, cuts):  # the thresholds themselves and their neighbours
        x = np.concatenate([x, *[np.insert(x[:len(c), 1 - f, None], f, v, axis=1)
                                 for v in (c, np.nextafter(c, np.inf), np.nextafter(c, -np.inf))]])
    x = np.concatenate([x, [[np.nan, 0.0], [0.0, np.nan], [np.inf, -np.inf], [-0.0, 0.0]]])
    want = flat._walk(x)
    monkeypatch.setattr(RO.FlatTrees, "_walk", None)
    assert (score(x) == want).all()


@pytest.mark.parametrize("query,kind", [(Q.q_forecast_forest, "forest"), (Q.q_forecast_net, "net")])
def test_queries_match_once_and_write_no_paths(spark, query, kind, monkeypatch, tmp_path):
    """The match serves the training rows and the agents; 51 rows an agent
    are not written before they are returned."""
    import datetime

    from trailframe.operators import matching

    t0 = datetime.datetime(2024, 1, 1)
    rng = np.random.default_rng(6)
    rows = [(i, t0 + datetime.timedelta(hours=i // 20), int(u), float(v))
            for i, (u, v) in enumerate(zip(rng.integers(0, 60, 200), rng.uniform(0, 60, 200)))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    calls, match = [], matching.match_next_frame
    monkeypatch.setattr(matching, "match_next_frame", lambda *a, **kw: calls.append(a) or match(*a, **kw))
    monkeypatch.setattr(Q, "STEPS", 4)
    options = {"forest": {"numTrees": 3}, "net": {"epochs": 2}}[kind]
    fit = RG.fit_pair
    monkeypatch.setattr(RG, "fit_pair", lambda *a, **kw: fit(*a, **{**options, **kw}))
    got = query(spark, str(tmp_path))
    assert len(calls) == 1 and not any("forecast" in f for f in got.inputFiles())
    agents = MQ.moving_agents(spark, str(tmp_path))
    assert got.count() == 5 * agents.count() > 0
    start = got.where("step = 0").join(agents.select("frame", "slot", *[F.round(c, 4).alias(f"a{c}") for c in ("cx", "cy", "vx", "vy")]),
                                       ["frame", "slot"])
    assert start.where("cx = acx and cy = acy and vx = avx and vy = avy").count() == agents.count()


def test_unwritten_paths_equal_written_ones(spark, moves):
    pair = RG.fit_pair("net", moves, epochs=2)
    agents = FC.initial_agents(spark, 9, seed=2)
    a, b = (FC.forecast(agents, pair, n_steps=6, dt=1.0, speed=1.0, block=6, write=w) for w in (True, False))
    assert a.dtypes == b.dtypes and sorted(a.collect()) == sorted(b.collect())
    for kw in ({"block": 3}, {"block": 6, "out_path": "/nowhere"}):
        with pytest.raises(ValueError, match="write=False"):
            FC.forecast(agents, pair, n_steps=6, dt=1.0, write=False, **kw)


def test_rounding_equals_spark(spark):
    """Also at halves, near them, for zeros, very large values, NaN and NULL."""
    rng = np.random.default_rng(1)
    halves = (rng.integers(-10 ** 9, 10 ** 9, 4000) * 2 + 1) / 20000
    x = np.concatenate([rng.normal(0, 10.0 ** rng.integers(-6, 17, 8000)), halves, np.nextafter(halves, np.inf),
                        np.nextafter(halves, -np.inf), [0.0, -0.0, -1e-5, 1e300, -1e300, np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = df.select(rounded("v").alias("a"), F.round("v", 4).alias("b")).collect()
    bits = [[None if v is None else np.float64(v).tobytes() for v in r] for r in got]
    assert len(bits) == len(x) + 1 and all(a == b for a, b in bits)
