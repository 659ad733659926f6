"""Many steps of a fitted model pair in one pass over the agents.

Fitted trees become flat arrays (:class:`FlatTrees`), read from the node
table that Spark's own model writer saves.  With them, or with the weights of
the net, a task rolls its agents through all steps of a block, step by step
for a whole Arrow batch: the plan has one node however many steps there are.
The arrays hold the nodes of the model, never anything of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.session import ship_package

#: kinds of models that a task can score by itself
KINDS = ("tree", "forest", "gbt", "net")
#: cells between the thresholds that a model's predictions are written out for
TABLE = 1 << 18
#: rows that go down the trees at once
WALK = 1 << 14


class FlatTrees:
    """Trees as arrays over all nodes: feature (-1 at a leaf), threshold,
    children, prediction; ``lefts`` says per node which categories go left
    (its last column: a category the node does not know)."""

    def __init__(self, trees: dict[int, Sequence], weights: Sequence[float], mean: bool,
                 categories: dict[int, dict[float, int]] | None = None):
        based = _bases(trees)
        nodes = [(n, base) for base, tree in based for n in tree]
        self.roots = np.array([base for base, _ in based], dtype=np.int64)
        self.weights, self.mean = np.array(weights, dtype=float), mean
        #: per categorical feature: value -> index, as fitted
        self.categories = categories or {}
        self.prediction = np.array([n["prediction"] for n, _ in nodes])
        self.feature = np.array([n["split"]["featureIndex"] if n["leftChild"] >= 0 else -1 for n, _ in nodes])
        self.children = np.array([(n["leftChild"] + b, n["rightChild"] + b) for n, b in nodes], dtype=np.int64)
        arity = [n["split"]["numCategories"] for n, _ in nodes]
        self.threshold = np.full(len(nodes), np.nan)
        self.categorical = np.array([a >= 0 for a in arity])
        width = max([0, *arity]) + 1
        self.lefts = np.zeros((len(nodes), width), dtype=bool)
        for i, ((n, _), a) in enumerate(zip(nodes, arity)):
            left = n["split"]["leftCategoriesOrThreshold"]
            if a >= 0:
                self.lefts[i, [int(c) for c in left]] = True
                # Spark tests membership in the smaller of the two sides
                self.lefts[i, a:] = 2 * len(left) > a
            elif left:
                self.threshold[i] = left[0]
        self.table = self._table()

    def _table(self):
        """Sorted thresholds of each feature and the prediction of every cell
        between them, where the features are few enough; else None.  Within
        a cell all rows go the same way through all trees."""
        used = sorted(set(self.feature[self.feature >= 0].tolist()))
        cuts = [np.unique(self.threshold[self.feature == f]) for f in used]
        shape = [len(c) + 1 for c in cuts]
        if self.categories or (self.categorical & (self.feature >= 0)).any() or math.prod(shape) > TABLE:
            return None
        # the upper end of a cell belongs to it; beyond the last threshold lies any larger value, and NaN
        ends = np.meshgrid(*[np.append(c, np.nan) for c in cuts], indexing="ij")
        x = np.zeros((math.prod(shape), max([0, *used]) + 1))
        for f, e in zip(used, ends):
            x[:, f] = e.ravel()
        return used, cuts, np.concatenate([self._walk(x[a:a + WALK]) for a in range(0, len(x), WALK)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x``; a NaN goes right, as in Spark."""
        if self.table is None:
            return self._walk(x)
        used, cuts, values = self.table
        cell = np.zeros(len(x), dtype=np.int64)
        for f, c in zip(used, cuts):
            cell *= len(c) + 1
            cell += np.searchsorted(c, x[:, f], side="left")
        return values[cell]

    def _walk(self, x: np.ndarray) -> np.ndarray:
        """Predictions, node by node."""
        x = x.copy()
        for f, found in self.categories.items():
            x[:, f] = [found.get(v, len(found)) for v in (x[:, f] + 0.0).tolist()]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if (f < 0).all():
                break
            v = x[rows, np.maximum(f, 0)]
            left = v <= self.threshold[at]
            cat = self.categorical[at] & (f >= 0)
            if cat.any():
                known = np.minimum(v[cat], self.lefts.shape[1] - 1).astype(np.int64)
                left[cat] = self.lefts[at[cat], known]
            at = np.where(f < 0, at, np.where(left, self.children[at, 0], self.children[at, 1]))
        total = np.zeros(len(x))
        for t in range(len(self.roots)):
            total += self.prediction[at[:, t]] * self.weights[t]
        return total / len(self.roots) if self.mean else total


def _bases(trees: dict[int, Sequence]) -> list[tuple[int, Sequence]]:
    """Every tree with the place of its root among all nodes."""
    out, base = [], 0
    for _, tree in sorted(trees.items()):
        out.append((base, tree))
        base += len(tree)
    return out


def flat_trees(model, spark: SparkSession) -> FlatTrees:
    """The arrays of a fitted tree, forest or GBT model, alone or behind a
    ``VectorIndexer`` in a pipeline."""
    from trailframe.sources.text import scratch_path

    stages = getattr(model, "stages", [model])
    categories = {}
    for index in stages[:-1]:
        categories = {int(f): {float(v): int(i) for v, i in m.items()} for f, m in dict(index.categoryMaps).items()}
    core = stages[-1]
    path = scratch_path(spark, "model")
    core.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    alone = "nodeData" not in nodes.columns
    nodes = nodes.select(F.lit(0).alias("treeID"), "*") if alone else nodes.select("treeID", "nodeData.*")
    # the nodes of a model: bounded by its trees and their depth
    trees: dict[int, list] = {}
    for n in nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", "split").orderBy("treeID", "id").collect():
        trees.setdefault(n["treeID"], []).append(n)
    boosted = not alone and type(core).__name__.startswith("GBT")
    return FlatTrees(trees, list(core.treeWeights) if boosted else [1.0] * len(trees), not boosted, categories)


def scorers(pair, spark: SparkSession) -> list:
    """One function per label, from rows of features to predictions."""
    if pair.kind == "net":
        return [lambda x, m=m: np.asarray(m.forward(x), dtype=float).reshape(-1) for m in pair.models.values()]
    return [flat_trees(m, spark).score for m in pair.models.values()]


def rollout(agents: DataFrame, pair, key: Sequence[str], state: Sequence[str], first: int, last: int,
            speed: float, dt: float, score: list | None = None) -> DataFrame:
    """``(key..., step, state...)`` of the steps ``first + 1`` to ``last``
    (and ``first`` itself where it is 0) of agents standing at ``first``.

    ``state`` is ``cx, cy, vx, vy`` and, with a memory, ``m_x1, m_y1, ..``.
    An agent that lacks a velocity has none afterwards, and no position."""
    spark = agents.sparkSession
    ship_package(spark)
    score = score or scorers(pair, spark)
    key, state = list(key), list(state)
    memory = state[4:]
    move = float(speed) * float(dt)
    source = agents.select(*key, *[F.col(c).cast("double").alias(c) for c in state])
    fields = source.select(*key, F.lit(0).alias("step"), *state).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.columns[:len(key)]
            cols = batch.columns[len(key):]
            lost = [c.is_null().to_numpy(zero_copy_only=False) for c in cols]
            now = [c.to_numpy(zero_copy_only=False) for c in cols]

            def rows(step: int) -> pa.RecordBatch:
                n = batch.num_rows
                arrays = [*keys, pa.array(np.full(n, step, dtype=np.int32)),
                          *[pa.array(v, mask=m) for v, m in zip(now, lost)]]
                return pa.RecordBatch.from_arrays(arrays, names=[*key, "step", *state])

            if first == 0:
                yield rows(0)
            for step in range(first + 1, last + 1):
                used = range(4, len(state)) if memory else (2, 3)
                x = np.stack([now[i] for i in used], axis=1)
                gone = np.logical_or.reduce([lost[i] for i in used])
                new = [f(x) for f in score]
                now = [now[0] + new[0] * move, now[1] + new[1] * move, *new, *now[6:], *(new if memory else [])]
                lost = [lost[0] | gone, lost[1] | gone, gone, gone, *lost[6:], *([gone, gone] if memory else [])]
                yield rows(step)

    return source.mapInArrow(run, fields)
