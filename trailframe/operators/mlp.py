"""Feed-forward regression net trained data-parallel on Spark.

Spark ML has a multilayer perceptron classifier only, so the regressor is
trained here by synchronous full-batch gradient descent.  Either every epoch
is a job, whose tasks send gradient sums to the driver, or all epochs are one
job: a barrier stage, whose tasks keep their rows in numpy, exchange the sums
with ``allGather`` and each take the same optimizer step.  Spark lets a task
wait a full second in each gather, so jobs are the default; the barrier pays
where an epoch's rows take longer than that to read again.

Rows are dealt into ``SHARDS`` shards by a hash of their values, sorted there
by Spark, once, and summed shard by shard in a fixed order, a chunk at a time; dropout masks come from the same
hash, the epoch and the unit.  Weights are therefore equal to the last bit
however many partitions the rows lie in.

Network as in the reference: tanh hidden layers, identity output, squared
error, Xavier initialisation, Nesterov momentum, dropout on the inputs of
the middle layers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.session import ship_package

# The reference's network for 2 inputs and 1 output.
DEFAULT_LAYERS = (2, 4, 8, 16, 8, 4, 2, 1)
DEFAULT_DROPOUT_LAYERS = (1, 2, 3, 4, 5)

#: shards that rows are dealt into, and summed by
SHARDS = 64
#: rows of a shard that go through the net at once
CHUNK = 1 << 16
#: rows of a chunk that go through the layers together: their activations stay in the cache of a core
BLOCK = 1 << 11


@dataclass
class MLP:
    layers: tuple[int, ...]
    weights: list[tuple[np.ndarray, np.ndarray]]
    features: tuple[str, ...]
    label: str
    losses: list[float] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([_forward(self.weights, x[s], None)[-1][:, 0] for s in _blocks(len(x))])

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Score every row (no dropout) with an Arrow-batched pandas UDF."""
        ship_package(df.sparkSession)
        forward = self.forward

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(forward(np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])))

        return df.withColumn(out, score(*[F.col(c).cast("double") for c in self.features]))


def xavier(layers: Sequence[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    out = []
    for n_in, n_out in zip(layers[:-1], layers[1:]):
        std = np.sqrt(2.0 / (n_in + n_out))
        out.append((rng.normal(0.0, std, (n_in, n_out)), np.zeros(n_out)))
    return out


def _blocks(n: int) -> list[slice]:
    """``n`` rows in pieces of ``BLOCK``, the last up to half longer: a few
    rows by themselves would be multiplied another way, to other last bits."""
    starts = range(0, max(1, n - BLOCK // 2), BLOCK)
    return [slice(i, n if i == starts[-1] else i + BLOCK) for i in starts]


def _forward(weights, x, masks):
    acts = [x]
    a = x
    last = len(weights) - 1
    for i, (w, b) in enumerate(weights):
        if masks is not None and masks[i] is not None:
            a = a * masks[i]
        a = a @ w
        a += b
        if i != last:
            np.tanh(a, out=a)
        acts.append(a)
    return acts


def _grad(weights, x, y, masks):
    """Gradient of 0.5 * sum((yhat - y)^2) (a sum, not a mean) and the loss sum.

    ``masks`` are those of all rows, or a function of the slice of rows.  The
    rows go through the net a block at a time; layer inputs and deltas are
    put together and summed over all rows at once, so the sums have the same
    bits whatever the block."""
    n, k = len(x), len(weights)
    inputs = [np.empty((n, w.shape[0])) for w, _ in weights]
    err = np.empty(n)
    deltas = [np.empty((n, w.shape[1])) for w, _ in weights[:-1]] + [err[:, None]]
    for s in _blocks(n):
        m = masks(s) if callable(masks) else [None if v is None else v[s] for v in masks or [None] * k]
        acts = _forward(weights, x[s], m)
        err[s] = acts[-1][:, 0] - y[s]
        for i in range(k - 1, -1, -1):
            inputs[i][s] = acts[i] if m is None or m[i] is None else acts[i] * m[i]
            if i > 0:
                back = deltas[i][s] @ weights[i][0].T
                if m is not None and m[i] is not None:
                    back *= m[i]
                np.multiply(back, 1.0 - acts[i] ** 2, out=deltas[i - 1][s])
    return [(a.T @ d, d.sum(0)) for a, d in zip(inputs, deltas)], 0.5 * float(err @ err)


def _flatten(pairs) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b.ravel()]) for w, b in pairs])


def _unflatten(vec: np.ndarray, layers: Sequence[int]):
    out, k = [], 0
    for n_in, n_out in zip(layers[:-1], layers[1:]):
        w = vec[k:k + n_in * n_out].reshape(n_in, n_out)
        k += n_in * n_out
        b = vec[k:k + n_out]
        k += n_out
        out.append((w, b))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def _masks(rows: np.ndarray, epoch: int, seed: int, weights, dropout: float, dropout_layers):
    """Inverted dropout masks of rows with the hashes ``rows``: a unit stays
    where a hash of row, seed, epoch, layer and unit is below the keep rate."""
    if not dropout:
        return None
    u = np.uint64
    keep = 1.0 - dropout
    cut = min(int(keep * 2.0 ** 64), (1 << 64) - 1)
    # _mixed(row ^ unit), its first shift taken of row and unit alone
    rows = rows ^ (rows >> u(30))
    out = []
    for i, (w, _) in enumerate(weights):
        if i not in dropout_layers:
            out.append(None)
            continue
        unit = _mixed(np.array([(seed << 40) ^ (epoch << 20) ^ (i << 12) ^ j for j in range(w.shape[0])], dtype=u))
        z = (unit ^ (unit >> u(30)))[:, None] ^ rows
        z *= u(0xBF58476D1CE4E5B9)
        z ^= z >> u(27)
        z *= u(0x94D049BB133111EB)
        if cut % (1 << 33):  # the last shift leaves the upper 31 bits
            z ^= z >> u(31)
        out.append(np.divide((z < u(cut)).T, keep, order="C"))
    return out


@dataclass
class _Task:
    """What a task needs to know of the training run."""
    layers: tuple[int, ...]
    start: np.ndarray
    epochs: int
    lr: float
    momentum: float
    dropout: float
    dropout_layers: tuple[int, ...]
    seed: int

    def chunks(self, batches: Iterator) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(shard, row hashes, inputs, labels)`` of up to ``CHUNK`` rows of a
        shard at a time, of rows that come sorted by shard.  However the rows
        are batched, a shard is cut at the same places; no more than a chunk
        and a batch are held."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, n = -1, 0

        def chunk():
            rows, v = (np.concatenate(p) for p in zip(*held))
            return now, rows, v[:, :-1], v[:, -1]

        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(0).to_numpy()
            rows = b.column(1).to_numpy().view(np.uint64)
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[2:]])
            at = 0
            while at < len(shard):
                if shard[at] != now:
                    if held:
                        yield chunk()
                    held, now, n = [], int(shard[at]), 0
                end = min(int(np.searchsorted(shard, now, side="right")), at + CHUNK - n)
                held.append((rows[at:end], v[at:end]))
                n += end - at
                at = end
                if n == CHUNK:
                    yield chunk()
                    held, n = [], 0
        if held:
            yield chunk()

    def sums(self, chunks, flat: np.ndarray, epoch: int) -> dict[int, np.ndarray]:
        """Per shard: the gradient sum, the loss sum, the number of rows."""
        weights = _unflatten(flat, self.layers)
        out: dict[int, np.ndarray] = {}
        for s, rows, x, y in chunks:
            total = out.setdefault(s, np.zeros(len(flat) + 2))
            g, lo = _grad(weights, x, y, lambda at, rows=rows: _masks(
                rows[at], epoch, self.seed, weights, self.dropout, self.dropout_layers))
            total[:-2] += _flatten(g)
            total[-2] += lo
            total[-1] += len(y)
        return out

    def step(self, flat: np.ndarray, velocity: np.ndarray, sums: dict[int, np.ndarray]):
        """New weights, new velocity and the loss, from the sums of all
        shards added in order."""
        total = np.zeros(len(flat) + 2)
        for s in sorted(sums):
            total += sums[s]
        if total[-1] == 0:
            raise ValueError("no training rows")
        w, v = _nesterov(_unflatten(flat, self.layers), _unflatten(velocity, self.layers),
                         _unflatten(total[:-2], self.layers), total[-1], self.lr, self.momentum)
        return _flatten(w), _flatten(v), float(total[-2] / total[-1])


def _gathered(parts: list[str], width: int) -> dict[int, np.ndarray]:
    """Shard sums of all tasks from their messages."""
    out = {}
    for p in parts:
        rows = np.frombuffer(base64.b64decode(p), dtype="<f8").reshape(-1, width + 1)
        out.update({int(r[0]): r[1:] for r in rows})
    return out


def _message(sums: dict[int, np.ndarray]) -> str:
    rows = [np.concatenate(([float(s)], v)) for s, v in sums.items()]
    return base64.b64encode(np.concatenate(rows).astype("<f8").tobytes() if rows else b"").decode()


def _train_in_barrier(data: DataFrame, task: _Task) -> tuple[np.ndarray, list[float]]:
    """All epochs in one job; the first task returns the weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        ctx = BarrierTaskContext.get()
        shards = list(task.chunks(batches))
        flat, velocity, losses = task.start, np.zeros_like(task.start), []
        for epoch in range(task.epochs):
            parts = ctx.allGather(_message(task.sums(shards, flat, epoch)))
            flat, velocity, loss = task.step(flat, velocity, _gathered(parts, len(flat) + 2))
            losses.append(loss)
        if ctx.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()]), pa.array([losses], pa.list_(pa.float64()))],
                                             names=["weights", "losses"])

    r = data.mapInArrow(run, "weights array<double>, losses array<double>", barrier=True).collect()[0]
    return np.array(r["weights"]), list(r["losses"])


def _train_in_jobs(data: DataFrame, task: _Task) -> tuple[np.ndarray, list[float]]:
    """One job per epoch; at most ``SHARDS`` sums reach the driver."""
    sc = data.sparkSession.sparkContext
    data = data.persist()
    flat, velocity, losses = task.start, np.zeros_like(task.start), []
    try:
        for epoch in range(task.epochs):
            now = sc.broadcast(flat)

            def run(batches, now=now, epoch=epoch):
                sums = task.sums(task.chunks(batches), now.value, epoch)
                yield pa.RecordBatch.from_arrays([pa.array([_message(sums)])], names=["m"])

            parts = [r["m"] for r in data.mapInArrow(run, "m string").collect()]
            now.unpersist()
            flat, velocity, loss = task.step(flat, velocity, _gathered(parts, len(flat) + 2))
            losses.append(loss)
    finally:
        data.unpersist()
    return flat, losses


def _nesterov(weights, vel, grads, n, lr, momentum):
    new_w, new_v = [], []
    for (w, b), (vw, vb), (gw, gb) in zip(weights, vel, grads):
        nvw = momentum * vw - lr * gw / n
        nvb = momentum * vb - lr * gb / n
        new_w.append((w - momentum * vw + (1 + momentum) * nvw, b - momentum * vb + (1 + momentum) * nvb))
        new_v.append((nvw, nvb))
    return new_w, new_v


def fit_mlp(df: DataFrame, features: Sequence[str], label: str, layers: Sequence[int] | None = None,
            epochs: int = 200, lr: float = 0.01, momentum: float = 0.9, dropout: float = 0.5,
            dropout_layers: Sequence[int] = DEFAULT_DROPOUT_LAYERS, seed: int = 12345, mode: str = "jobs") -> MLP:
    """Train a regression net on ``features -> label``.

    ``layers`` defaults to the reference's 2-4-8-16-8-4-2-1 shape scaled to
    the number of features.  ``mode``: ``"jobs"`` runs a job per epoch over
    the rows, which are kept; ``"barrier"`` trains in one job, with as many
    tasks as run at once (at most ``SHARDS``; a task keeps its rows in
    memory; not with dynamic allocation).  Both give the same weights.  Rows with a NULL are left out; equal rows share
    their dropout masks.
    """
    if mode not in ("barrier", "jobs"):
        raise ValueError("mode must be 'barrier' or 'jobs'")
    k = len(features)
    layers = tuple(layers) if layers else (k, 2 * k, 4 * k, 8 * k, 4 * k, 2 * k, k, 1)
    if layers[0] != k or layers[-1] != 1:
        raise ValueError("layers must start with the number of features and end with 1")
    dl = tuple(i for i in dropout_layers if i < len(layers) - 1)
    spark = df.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    names = [f"x{i}" for i in range(k)]
    rows = df.select(*[F.col(c).cast("double").alias(n) for n, c in zip(names, features)],
                     F.col(label).cast("double").alias("y")).na.drop()
    row = F.xxhash64(*names, "y")
    data = (rows.select(F.pmod(row, F.lit(SHARDS)).cast("int").alias("shard"), row.alias("row"), *names, "y")
            .repartition(max(1, min(SHARDS, sc.defaultParallelism)), "shard")
            # by the hash as an unsigned number, then by the values
            .sortWithinPartitions("shard", F.col("row").bitwiseXOR(F.lit(-1 << 63)), "y", *reversed(names)))
    task = _Task(layers, _flatten(xavier(layers, seed)), max(1, int(epochs)), lr, momentum, dropout, dl, seed)
    flat, losses = (_train_in_barrier if mode == "barrier" else _train_in_jobs)(data, task)
    return MLP(layers, _unflatten(flat, layers), tuple(features), label, losses)


def sum_samples(spark: SparkSession, n: int = 1000, lo: float = 0.0, hi: float = 3.0, seed: int = 12345) -> DataFrame:
    """``(a, b, label = a + b)`` with a, b uniform in [lo, hi), from
    seeded hashes of the row id."""
    def u(salt: int):
        h = F.xxhash64(F.col("id"), F.lit(int(seed)), F.lit(salt))
        return F.pmod(h, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))

    a = F.lit(float(lo)) + F.lit(float(hi - lo)) * u(1)
    b = F.lit(float(lo)) + F.lit(float(hi - lo)) * u(2)
    return spark.range(int(n)).select(a.alias("a"), b.alias("b")).withColumn("label", F.col("a") + F.col("b"))


def numeric_gradient(weights, x, y, eps: float = 1e-6) -> np.ndarray:
    """Central differences of the loss, for tests."""
    layers = [weights[0][0].shape[0]] + [w.shape[1] for w, _ in weights]
    flat = _flatten(weights)
    out = np.zeros_like(flat)
    for i in range(len(flat)):
        up, dn = flat.copy(), flat.copy()
        up[i] += eps
        dn[i] -= eps
        lu = _grad(_unflatten(up, layers), x, y, None)[1]
        ld = _grad(_unflatten(dn, layers), x, y, None)[1]
        out[i] = (lu - ld) / (2 * eps)
    return out


def analytic_gradient(weights, x, y) -> np.ndarray:
    return _flatten(_grad(weights, x, y, None)[0])
