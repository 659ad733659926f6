"""Gradient check, partition independence, loss falls."""

import numpy as np
import pytest

from trailframe.operators import mlp


def test_gradient_matches_numeric():
    w = mlp.xavier((2, 4, 3, 1), seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 2)), rng.normal(size=7)
    assert np.allclose(mlp.analytic_gradient(w, x, y), mlp.numeric_gradient(w, x, y), atol=1e-5)


def test_full_batch_independent_of_partitioning(spark):
    df = mlp.sum_samples(spark, 300, seed=3)
    a = mlp.fit_mlp(df.repartition(1), ("a", "b"), "label", layers=(2, 5, 1), epochs=5, dropout=0.0)
    b = mlp.fit_mlp(df.repartition(6), ("a", "b"), "label", layers=(2, 5, 1), epochs=5, dropout=0.0)
    for (wa, ba), (wb, bb) in zip(a.weights, b.weights):
        assert np.allclose(wa, wb) and np.allclose(ba, bb)


def test_sum_samples_and_training_learns_addition(spark):
    df = mlp.sum_samples(spark, 1000, 0.0, 3.0, seed=12345)
    p = df.toPandas()
    assert ((p.a >= 0) & (p.a < 3)).all() and np.allclose(p.label, p.a + p.b)
    net = mlp.fit_mlp(df, ("a", "b"), "label", layers=(2, 10, 1), epochs=80, lr=0.05,
                      dropout=0.0)
    assert net.losses[-1] < 0.1 * net.losses[0]
    assert net.forward(np.array([[1.5, 1.5]]))[0] == pytest.approx(3.0, abs=0.4)
    scored = net.transform(df.limit(5)).toPandas()
    assert np.allclose(scored.prediction, net.forward(scored[["a", "b"]].to_numpy()))


def test_workers_import_the_package_from_any_directory(spark, tmp_dir):
    import os

    here = os.getcwd()
    os.chdir(tmp_dir)
    try:
        df = mlp.sum_samples(spark, 50, seed=2)
        net = mlp.fit_mlp(df, ("a", "b"), "label", layers=(2, 3, 1), epochs=2, dropout=0.0)
        assert net.transform(df).count() == 50
    finally:
        os.chdir(here)


def test_reference_shape_with_dropout_runs(spark):
    df = mlp.sum_samples(spark, 200, seed=1)
    net = mlp.fit_mlp(df, ("a", "b"), "label", epochs=4)
    assert net.layers == mlp.DEFAULT_LAYERS and len(net.losses) == 4


def test_weights_are_equal_on_any_partitioning_and_in_one_job(spark):
    """With dropout, to the last bit; and dropout does change the weights."""
    df = mlp.sum_samples(spark, 500, seed=9)
    runs = [mlp.fit_mlp(df.repartition(n), ("a", "b"), "label", epochs=4, mode=mode)
            for n, mode in ((1, "jobs"), (8, "jobs"), (3, "barrier"))]
    for r in runs[1:]:
        assert r.losses == runs[0].losses
        for (wa, ba), (wb, bb) in zip(runs[0].weights, r.weights):
            assert (wa == wb).all() and (ba == bb).all()
    dry = mlp.fit_mlp(df, ("a", "b"), "label", epochs=4, dropout=0.0)
    assert dry.losses != runs[0].losses


def test_training_equals_plain_numpy(spark):
    df = mlp.sum_samples(spark, 300, seed=4)
    net = mlp.fit_mlp(df, ("a", "b"), "label", layers=(2, 3, 1), epochs=6, dropout=0.0, lr=0.02)
    p = df.toPandas()
    x, y = p[["a", "b"]].to_numpy(), p.label.to_numpy()
    w = mlp.xavier((2, 3, 1), 12345)
    v = [(0 * a, 0 * b) for a, b in w]
    for _ in range(6):
        g, _ = mlp._grad(w, x, y, None)
        w, v = mlp._nesterov(w, v, g, len(y), 0.02, 0.9)
    for (wa, ba), (wb, bb) in zip(w, net.weights):
        assert np.allclose(wa, wb) and np.allclose(ba, bb)


def test_dropout_masks_keep_their_share():
    rows = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = mlp.xavier((2, 4, 8, 1), 1)
    a, b = (mlp._masks(rows, e, 5, w, 0.25, (1, 2)) for e in (0, 1))
    assert a[0] is None and a[1].shape == (20_000, 4) and a[2].shape == (20_000, 8)
    assert abs((a[2] > 0).mean() - 0.75) < 0.01 and np.allclose(a[2][a[2] > 0], 1 / 0.75)
    assert abs(np.corrcoef(a[2][:, 0], a[2][:, 1])[0, 1]) < 0.03 and (a[1] != b[1]).any()


def test_no_rows_and_nulls(spark):
    df = mlp.sum_samples(spark, 50)
    with pytest.raises(Exception, match="no training rows"):
        mlp.fit_mlp(df.limit(0), ("a", "b"), "label", epochs=1)
    more = df.union(spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, label double"))
    assert mlp.fit_mlp(more, ("a", "b"), "label", epochs=2).losses == mlp.fit_mlp(df, ("a", "b"), "label", epochs=2).losses


def test_a_task_holds_a_chunk_and_a_batch(monkeypatch):
    """Rows are cut where the shard says, whatever the batches, and no task
    gathers them all."""
    import pyarrow as pa

    monkeypatch.setattr(mlp, "CHUNK", 100)
    rng = np.random.default_rng(2)
    shard = np.sort(rng.integers(0, 5, 2000)).astype(np.int32)
    cols = [pa.array(shard), pa.array(rng.integers(-9, 9, 2000)), *[pa.array(v) for v in rng.normal(size=(3, 2000))]]
    task = mlp._Task((2, 3, 1), mlp._flatten(mlp.xavier((2, 3, 1), 1)), 1, 0.1, 0.9, 0.5, (1,), 3)

    def batches(n):
        for a in range(0, 2000, n):
            yield pa.RecordBatch.from_arrays([c[a:a + n] for c in cols], names=list("srxyz"))

    sums = [task.sums(task.chunks(batches(n)), task.start, 0) for n in (7, 333, 2000)]
    for s in sums[1:]:
        assert set(s) == set(sums[0]) and all((s[k] == v).all() for k, v in sums[0].items())
    assert sum(v[-1] for v in sums[0].values()) == 2000
    taken = []
    first = next(task.chunks(b for b in batches(50) if not taken.append(b)))
    assert len(first[3]) <= 100 and len(taken) <= 4


def test_a_chunk_goes_through_the_net_in_blocks(monkeypatch):
    """The layers see a block of rows at a time; sums, masks and scores are
    those of all rows at once, to the last bit."""
    rng = np.random.default_rng(4)
    n = 2 * mlp.BLOCK + 77
    rows, x, y = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.normal(size=(n, 2)), rng.normal(size=n)
    w = mlp.xavier(mlp.DEFAULT_LAYERS, 1)
    for p in (0.5, 0.3):
        for i, m in enumerate(mlp._masks(rows, 3, 9, w, p, (1, 2))[:3]):
            if i:
                unit = np.array([(9 << 40) ^ (3 << 20) ^ (i << 12) ^ j for j in range(m.shape[1])], dtype=np.uint64)
                kept = mlp._mixed(rows[:, None] ^ mlp._mixed(unit)) < np.uint64(int((1 - p) * 2.0 ** 64))
                assert (m == kept / (1 - p)).all()
    for n in (1, mlp.BLOCK + 1, n):
        task = mlp._Task(mlp.DEFAULT_LAYERS, mlp._flatten(w), 1, 0.1, 0.9, 0.5, mlp.DEFAULT_DROPOUT_LAYERS, 3)
        net = mlp.MLP(mlp.DEFAULT_LAYERS, w, ("a", "b"), "y")
        chunk = (0, rows[:n], x[:n], y[:n])
        with monkeypatch.context() as m:
            m.setattr(mlp, "BLOCK", 1 << 20)
            want, whole = task.sums([chunk], task.start, 0)[0], net.forward(x[:n])
        sizes, forward = [], mlp._forward
        with monkeypatch.context() as m:
            m.setattr(mlp, "_forward", lambda ws, bx, masks: sizes.append(len(bx)) or forward(ws, bx, masks))
            got = task.sums([chunk], task.start, 0)[0]
            assert (got == want).all() and (net.forward(x[:n]) == whole).all()
        assert max(sizes) <= 1.5 * mlp.BLOCK and len(net.forward(x[:0])) == 0
