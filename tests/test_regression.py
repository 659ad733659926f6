"""M1-M4, L5, A9, M11-M21 against numpy and hand-worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.operators import forecast as FC
from trailframe.operators import regression as RG


@pytest.fixture(scope="module")
def trans(spark):
    rnd = np.random.default_rng(0)
    n = 400
    x, y = rnd.normal(0, 1, n), rnd.normal(0, 1, n)
    nx = 0.3 + 0.5 * x - 0.2 * y + rnd.normal(0, 0.1, n)
    ny = -0.1 + 0.1 * x + 0.7 * y + rnd.normal(0, 0.1, n)
    rows = [(i // 20, i % 20, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(x, y, nx, ny))]
    return spark.createDataFrame(rows, "frame long, slot long, x double, y double, next_x double, next_y double")


def test_linear_matches_least_squares(spark, trans):
    pair = RG.fit_pair("linear", trans)
    pdf = trans.toPandas()
    a = np.c_[np.ones(len(pdf)), pdf.x, pdf.y]
    for lab in ("next_x", "next_y"):
        coef = np.linalg.lstsq(a, pdf[lab], rcond=None)[0]
        m = pair.models[lab]
        assert m.intercept == pytest.approx(coef[0], abs=1e-8)
        assert list(m.coefficients) == pytest.approx(list(coef[1:]), abs=1e-8)


def test_linear_expression_equals_model_transform(spark, trans):
    pair = RG.fit_pair("linear", trans)
    fast = pair.predict(trans).orderBy("frame", "slot").toPandas()
    slow = pair.models["next_x"].transform(RG.assemble(trans, ["x", "y"])).orderBy("frame", "slot").toPandas()
    assert (fast["pred_next_x"].to_numpy() == slow["pred_next_x"].to_numpy()).all()


def test_predict_pair_reads_old_features_and_rmse(spark, trans):
    pair = RG.fit_pair("linear", trans)
    scored = pair.predict(trans).toPandas()
    for lab in ("next_x", "next_y"):
        want = np.sqrt(((scored[f"pred_{lab}"] - scored[lab]) ** 2).mean())
        got = RG.evaluate_pair(pair, trans).first()[f"rmse_{lab[5:]}"]
        assert got == pytest.approx(want)
    assert "features" not in scored.columns


def test_tree_and_gbt_predict_group_means_on_categorical(spark):
    rows = [(float(i % 4), float(10 * (i % 4) + (i % 3))) for i in range(200)]
    df = RG.assemble(spark.createDataFrame(rows, "x double, label double"), ["x"])
    means = {k: np.mean([b for a, b in rows if a == k]) for k in range(4)}
    for kind in ("tree", "gbt"):
        m = RG.fit(kind, df, "label", maxIter=5) if kind == "gbt" else RG.fit(kind, df, "label")
        got = {r.x: r.p for r in m.transform(df).select("x", F.col("pred_label").alias("p")).distinct().collect()}
        for k, v in means.items():
            assert got[float(k)] == pytest.approx(v, abs=1e-6)


def test_forest_runs_with_seed(spark, trans):
    a = RG.fit_pair("forest", trans, seed=3)
    b = RG.fit_pair("forest", trans, seed=3)
    pa = a.predict(trans).select("pred_next_x").toPandas()
    pb = b.predict(trans).select("pred_next_x").toPandas()
    assert pa.equals(pb)


def pav(xs, ys):
    xs, ys = np.asarray(xs), np.asarray(ys)
    order = np.argsort(xs, kind="stable")
    ux = sorted(set(xs))
    w = [np.sum(xs == u) for u in ux]
    v = [np.mean(ys[xs == u]) for u in ux]
    blocks = [[v[i], w[i], [i]] for i in range(len(ux))]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0]:
            a, b = blocks[i], blocks[i + 1]
            tw = a[1] + b[1]
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / tw, tw, a[2] + b[2]]
            del blocks[i + 1]
            i = max(i - 1, 0)
        else:
            i += 1
    out = {}
    for val, _, idx in blocks:
        for j in idx:
            out[ux[j]] = val
    del order
    return out


def test_isotonic_uses_feature_zero_and_matches_pav(spark):
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 20, 300).astype(float)
    y = np.sqrt(x) + rnd.normal(0, 0.5, 300)
    z = rnd.normal(0, 1, 300)
    df = RG.assemble(spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y)],
                                           "x double, z double, label double"), ["x", "z"])
    m = RG.fit("isotonic", df, "label")
    got = {r.x: r.p for r in m.transform(df).select("x", F.col("pred_label").alias("p")).distinct().collect()}
    want = pav(x, y)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_hash_split_is_deterministic(spark):
    df = spark.range(1000)
    a, b = RG.train_test_split(df, 0.7, 42, "id")
    a2, _ = RG.train_test_split(df.repartition(5), 0.7, 42, "id")
    ids = sorted(r.id for r in a.collect())
    assert ids == sorted(r.id for r in a2.collect())
    assert a.count() + b.count() == 1000
    assert 600 < len(ids) < 800
    r1, r2 = RG.train_test_split(df, 0.7, 42)
    assert r1.count() + r2.count() == 1000


def test_model_report_and_as_coded_swap(spark, trans):
    key = F.col("frame") * 1000003 + F.col("slot")
    rep = {r.model: r for r in RG.model_report(trans, kinds=("linear", "isotonic"), key=key).collect()}
    assert set(rep) == {"linear", "isotonic"}
    assert rep["linear"].rmse_x < 0.2 and rep["linear"].rmse_y < 0.2
    coded = RG.model_report(trans, kinds=("linear",), key=key, as_coded=True).first()
    assert coded.rmse_x != rep["linear"].rmse_x


def test_l2_normalize_arrays_and_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r.u for r in RG.l2_normalize(df, "v", "u").collect()]
    assert got[0] == [0.6, 0.8] and got[1] == [None, None]
    vec = RG.l2_normalize(RG.assemble(spark.createDataFrame([(3.0, 4.0)], "a double, b double"), ["a", "b"]),
                          "features", "n")
    assert list(vec.first().n) == pytest.approx([0.6, 0.8])


def test_index_categories_keeps_unseen(spark):
    train = RG.assemble(spark.createDataFrame([(float(i % 3),) for i in range(30)], "x double"), ["x"])
    m = RG.index_categories(train, max_categories=4)
    test = RG.assemble(spark.createDataFrame([(7.0,)], "x double"), ["x"])
    assert m.transform(test).first().indexed[0] == 3.0


def test_forecast_matches_numpy_recursion(spark, trans):
    pair = RG.fit_pair("linear", trans)
    agents = FC.initial_agents(spark, 20, seed=5)
    a0 = agents.toPandas()
    assert ((a0.cx >= 200) & (a0.cx < 400)).all() and ((a0.vx >= -1) & (a0.vx < 1)).all()
    assert (a0.cx == a0.cx.round()).all()
    out = FC.forecast(agents, pair, n_steps=4, dt=0.01, speed=3500.0, block=3).toPandas()
    assert len(out) == 20 * 5 and sorted(out.step.unique()) == [0, 1, 2, 3, 4]
    mx, my = pair.models["next_x"], pair.models["next_y"]
    for _, ag in a0.iterrows():
        cx, cy, vx, vy = ag.cx, ag.cy, ag.vx, ag.vy
        for s in range(1, 5):
            nvx = mx.intercept + mx.coefficients[0] * vx + mx.coefficients[1] * vy
            nvy = my.intercept + my.coefficients[0] * vx + my.coefficients[1] * vy
            cx, cy, vx, vy = cx + nvx * 3500.0 * 0.01, cy + nvy * 3500.0 * 0.01, nvx, nvy
            row = out[(out.agent == ag.agent) & (out.step == s)].iloc[0]
            assert (row.cx, row.cy, row.vx, row.vy) == pytest.approx((cx, cy, vx, vy))


@pytest.mark.parametrize("fraction", [0.05, 0.72, 0.75, 0.95])
def test_split_follows_the_fraction(spark, fraction):
    df = spark.range(20_000).withColumn("key", F.col("id") * 3 + 2 ** 50)
    train, test = RG.train_test_split(df, fraction, 42, "key")
    assert abs(train.count() / 20_000 - fraction) < 0.01
    assert train.count() + test.count() == 20_000


def test_forecast_reads_only_its_own_folders(spark, trans, tmp_dir):
    pair = RG.fit_pair("linear", trans)
    agents = FC.initial_agents(spark, 5)
    out = f"{tmp_dir}/paths"
    assert FC.forecast(agents, pair, n_steps=12, dt=0.01, out_path=out, block=5).count() == 65
    again = FC.forecast(agents, pair, n_steps=4, dt=0.01, out_path=out, block=5)
    assert again.count() == 25 and again.agg(F.max("step")).first()[0] == 4


def test_forecast_with_memory_shifts_the_velocities(spark):
    from trailframe.operators import matching

    tracks = spark.createDataFrame([(t, s, float((t * s * 7) % 11), float((t + s * s) % 5)) for t in range(1, 6) for s in range(40)],
                                   "track long, step long, x double, y double")
    mem = matching.memory_features(tracks, k=2)
    feats = ("x1", "y1", "x2", "y2")
    pair = RG.fit_pair("linear", mem, feats)
    start = (0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 1.0, 2.0)
    ag = spark.createDataFrame([start], "agent long, cx double, cy double, vx double, vy double, "
                               "m_x1 double, m_y1 double, m_x2 double, m_y2 double")
    got = FC.forecast(ag, pair, n_steps=5, dt=0.5, speed=2.0, block=2).orderBy("step").collect()
    buf, c = [3.0, 4.0, 1.0, 2.0], [0.0, 0.0]
    for r in got[1:]:
        v = [float(np.dot(m.coefficients.toArray(), buf) + m.intercept) for m in pair.models.values()]
        c = [c[0] + v[0], c[1] + v[1]]
        buf = buf[2:] + v
        assert (r.cx, r.cy, r.vx, r.vy) == pytest.approx((*c, *v))


def test_model_report_with_the_net(spark, trans):
    rep = RG.model_report(trans, kinds=("linear", "net"), seed=1, key=F.col("frame") * 100 + F.col("slot"),
                          options={"net": {"layers": (2, 3, 1), "epochs": 3, "dropout": 0.0}}).toPandas()
    assert list(rep.model) == ["linear", "net"] and (rep.rmse_x > 0).all()


def test_model_report_from_two_files(spark, trans, tmp_dir):
    from trailframe.plans import jobs
    from trailframe.sources import text as TX

    TX.write_transitions(trans, f"{tmp_dir}/x", f"{tmp_dir}/y")
    rep = jobs.model_report_from_files(spark, f"{tmp_dir}/x", f"{tmp_dir}/y", kinds=("linear", "tree")).toPandas()
    assert list(rep.model) == ["linear", "tree"]
    assert rep[rep.model == "linear"].rmse_x[0] == pytest.approx(0.1, abs=0.03)


def test_tree_rows_come_in_bounded_parts(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(RG, "TREE_ROWS", 100)
    rows = spark.range(200 * cores).select((F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 4 * 2.0).alias("label"))
    data = RG.assemble(rows.coalesce(1), ["x"])
    assert RG._tree_parts(data).rdd.getNumPartitions() == 2 * cores
    assert RG._tree_parts(data.limit(50)).rdd.getNumPartitions() == 1
    got = RG.fit("tree", data, "label").transform(data).select("x", "pred_label").distinct().collect()
    assert {(r.x, r.pred_label) for r in got} == {(float(i), 2.0 * i) for i in range(4)}


def _labelled(spark, n=3000):
    """``n`` rows of 15 vectors, labels spread within each."""
    rows = spark.range(n).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 (F.col("id") * 7919 % 101 + F.col("id") % 3 * 40 - F.col("id") % 5 * 9).cast("double").alias("label"))
    return RG.assemble(rows, ["a", "b"])


def _predictions(model, df):
    return {(r.a, r.b): r.pred_label for r in model.transform(df).select("a", "b", "pred_label").distinct().collect()}


@pytest.mark.parametrize("indexed", [None, "indexed"])
def test_boosted_trees_read_rows_summed_up_by_vector(spark, monkeypatch, indexed):
    df = _labelled(spark)
    kw = {"maxIter": 6, "maxDepth": 3, "indexed": indexed}
    if indexed:
        df = RG.index_categories(df, out=indexed).transform(df)
    whole = RG.estimator("gbt", "label", **kw).fit(df)
    read = []
    made = RG.estimator

    def counted(*a, **k):
        est = made(*a, **k)
        return type("Counted", (), {"fit": lambda self, d: read.append(d.count()) or est.fit(d)})()

    monkeypatch.setattr(RG, "estimator", counted)
    model = RG.fit("gbt", df, "label", **kw)
    assert read[0] <= 64 < df.count()
    got, want = _predictions(model, df), _predictions(whole, df)
    assert got.keys() == want.keys() and len(got) == 15
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    a, b = (m if indexed else m.stages[-1] for m in (model, whole))
    assert [t.numNodes for t in a.trees][:1] == [t.numNodes for t in b.trees][:1]
    assert a.featureImportances.toArray() == pytest.approx(b.featureImportances.toArray(), abs=1e-6)


def test_vector_rows_keep_count_sum_and_squares(spark):
    df = _labelled(spark)
    sums = [F.sum("w"), F.sum(F.col("w") * F.col("label")), F.sum(F.col("w") * F.col("label") * F.col("label"))]
    want = {r[0]: r[1:] for r in df.withColumn("w", F.lit(1.0)).groupBy("features").agg(*sums).collect()}
    rows = RG._moment_rows(df.select("features", "label"), "features", "label", 32).withColumnRenamed("label_weight", "w")
    got = {r[0]: r[1:] for r in rows.groupBy("features").agg(*sums).collect()}
    assert got.keys() == want.keys() and rows.count() >= 32
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_boosted_trees_read_all_rows_where_sums_do_not_do(spark, monkeypatch):
    df = _labelled(spark).select("features", "label")
    assert RG._moment_rows(df, "features", "label", 14) is None
    assert RG._moment_rows(df.limit(500), "features", "label", 32) is None
    # vectors that the first rows don't show
    late = df.unionByName(RG.assemble(spark.range(40).select(F.col("id").cast("double").alias("a"), F.lit(0.5).alias("b"),
                                                             F.lit(1.0).alias("label")), ["a", "b"]).select("features", "label"))
    assert RG._moment_rows(late, "features", "label", 32) is None
    for bad in (None, float("nan"), float("inf")):
        odd = df.withColumn("label", F.when(F.col("label") != 0, F.col("label")).otherwise(F.lit(bad).cast("double")))
        assert RG._moment_rows(odd, "features", "label", 32) is None
    with pytest.raises(Exception, match="Null or NaN"):
        RG.fit("gbt", df.withColumn("label", F.when(F.col("label") != 0, F.col("label"))), "label", maxIter=1)
    monkeypatch.setattr(RG, "_moment_rows", lambda *a: pytest.fail("sums by vector"))
    for kw in ({"subsamplingRate": 0.5}, {"lossType": "absolute"}, {"minInstancesPerNode": 5}):
        RG.fit("gbt", df, "label", maxIter=1, **kw)
