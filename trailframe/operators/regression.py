"""Regression on transition rows.

Both labels live in one row (``next_x``, ``next_y``), so one scan, one
assembly and one split feed the x model and the y model.  Fitting uses
``pyspark.ml`` estimators; independent fits are submitted from a small
driver thread pool so Spark runs their jobs side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("next_x", "next_y")
TREES = ("tree", "forest", "gbt")


# ------------------------------------------------------------ features (M1-M3)

def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", handle_invalid: str = "error") -> DataFrame:
    """M1: ``VectorAssembler`` over ``cols`` (the reference passes all but
    the last column)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)


def l2_normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M2: unit L2 norm.  Vector columns go through ``Normalizer(p=2)``;
    ``array<float|double>`` columns are normalized with array functions
    (no conversion to vectors, no UDF).  A zero vector gives NULLs."""
    out = out or f"{col}_norm"
    dtype = dict(df.dtypes)[col]
    if dtype.startswith("array"):
        sq = F.aggregate(col, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
        norm = F.sqrt(sq)
        return df.withColumn(out, F.transform(col, lambda v: F.try_divide(v.cast("double"), norm)))
    from pyspark.ml.feature import Normalizer

    return Normalizer(inputCol=col, outputCol=out, p=2.0).transform(df)


def index_categories(df: DataFrame, col: str = "features", out: str = "indexed", max_categories: int = 4):
    """M3: ``VectorIndexer``; features with at most ``max_categories``
    distinct values become categorical.  Unseen values map to an extra
    index (``handleInvalid="keep"``) instead of failing at scoring time."""
    from pyspark.ml.feature import VectorIndexer

    return VectorIndexer(inputCol=col, outputCol=out, maxCategories=max_categories,
                         handleInvalid="keep").fit(df)


# ------------------------------------------------------------------ split

#: values the split hash can take: 15 hex digits of an md5
SPLIT_RANGE = 1 << 60


def hash_split_flag(key: Column, seed: int, fraction: float = 0.7) -> Column:
    """True for training rows: the first 15 hex digits of
    ``md5("<seed>:<key>")`` as a number below ``fraction * 2**60``.  Same
    rows on every run and every partitioning, any fraction."""
    h = F.md5(F.concat(F.lit(f"{int(seed)}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long") < F.lit(int(fraction * SPLIT_RANGE))


def train_test_split(df: DataFrame, fraction: float = 0.7, seed: int = 42,
                     key: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``.  With a key the split is a deterministic hash
    of it; without, ``randomSplit([fraction, 1-fraction], seed)``."""
    if key is None:
        a, b = df.randomSplit([fraction, 1.0 - fraction], seed)
        return a, b
    k = F.col(key) if isinstance(key, str) else key
    flag = hash_split_flag(k, seed, fraction)
    return df.where(flag), df.where(~flag)


# ------------------------------------------------------------- metrics

def rmse(df: DataFrame, pairs: Sequence[tuple[str, str]], names: Sequence[str] | None = None) -> DataFrame:
    """Root mean squared error for several (prediction, label) pairs in
    one aggregate."""
    names = names or [f"rmse_{lab}" for _, lab in pairs]
    aggs = []
    for (p, lab), n in zip(pairs, names):
        d = F.col(p) - F.col(lab)
        aggs.append(F.sqrt(F.avg(d * d)).alias(n))
    return df.agg(*aggs)


# ------------------------------------------------------------ estimators

def _linear(label: str, pred: str, seed: int):
    from pyspark.ml.regression import GeneralizedLinearRegression

    return GeneralizedLinearRegression(family="gaussian", link="identity", featuresCol="features",
                                       labelCol=label, predictionCol=pred)


def _tree_pipeline(est_cls, label: str, pred: str, seed: int, max_categories: int = 4,
                   indexed: str | None = None, **kw):
    """M3 + M4: ``VectorIndexer(maxCategories)`` then the tree estimator; the
    indexed column is named per label so two pipelines can score one
    DataFrame.  With ``indexed`` that column is taken as it is (indexed
    before, once for several fits)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorIndexer

    if indexed:
        return est_cls(featuresCol=indexed, labelCol=label, predictionCol=pred, seed=seed, **kw)
    col = f"indexed_{label}"
    idx = VectorIndexer(inputCol="features", outputCol=col, maxCategories=max_categories,
                        handleInvalid="keep")
    est = est_cls(featuresCol=col, labelCol=label, predictionCol=pred, seed=seed, **kw)
    return Pipeline(stages=[idx, est])


def _tree(label: str, pred: str, seed: int, **kw):
    from pyspark.ml.regression import DecisionTreeRegressor

    return _tree_pipeline(DecisionTreeRegressor, label, pred, seed, **kw)


def _forest(label: str, pred: str, seed: int, **kw):
    from pyspark.ml.regression import RandomForestRegressor

    return _tree_pipeline(RandomForestRegressor, label, pred, seed, **kw)


def _gbt(label: str, pred: str, seed: int, **kw):
    from pyspark.ml.regression import GBTRegressor

    return _tree_pipeline(GBTRegressor, label, pred, seed, **kw)


def _isotonic(label: str, pred: str, seed: int, feature_index: int = 0):
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol="features", labelCol=label, predictionCol=pred,
                              featureIndex=feature_index)


ESTIMATORS: dict[str, Callable] = {
    "linear": _linear,
    "tree": _tree,
    "forest": _forest,
    "gbt": _gbt,
    "isotonic": _isotonic,
}


def estimator(kind: str, label: str, pred: str | None = None, seed: int = 42, **kw):
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown model kind {kind!r}; one of {sorted(ESTIMATORS)}")
    return ESTIMATORS[kind](label, pred or f"pred_{label}", seed, **kw)


#: rows of a part that a tree estimator keeps and reads again at every level
TREE_ROWS = 1 << 20


def _tree_parts(train: DataFrame) -> DataFrame:
    """``train`` in parts of about ``TREE_ROWS`` rows.  The tree estimators
    keep their rows by the parts they come in, many times as large as in
    the files, so parts that grow with the input would not fit a task."""
    parts = -(-train.count() // TREE_ROWS)
    return train.repartition(parts) if parts > train.sparkSession.sparkContext.defaultParallelism else train


#: first rows looked at before the rows of a boosted fit are grouped
PROBE_ROWS = 1 << 10
#: options under which a boosted fit reads nothing of its rows but the bins
#: of their features and, per bin, weight, sum and sum of squares
MOMENT_OPTIONS = {"indexed", "max_categories", "maxBins", "maxDepth", "maxIter", "stepSize"}


def _moment_rows(train: DataFrame, col: str, label: str, bins: int) -> DataFrame | None:
    """All rows of ``train``, summed up by their vector in ``col``: weighted
    rows at mean and deviation of its labels on either side, which have the
    count, the sum and the sum of squares of the labels.  Trees boosted on
    squared error see no more of them, as a residual is a label less a
    function of the vector.  A vector gets several rows where there would be
    fewer than ``bins``, to which the estimator lowers its bins.

    None, if there are more than ``bins`` vectors (thresholds then depend on
    a draw of rows), few rows, or labels that have no mean."""
    first = train.select(col).take(max(PROBE_ROWS, bins))
    if len(first) < max(PROBE_ROWS, bins) or len(set(first)) > bins:
        return None
    if not isinstance(train.schema[label].dataType, T.NumericType):
        return None
    y = F.col(label).cast("double")
    groups = (train.groupBy(col).agg(F.count(F.lit(1)), F.count(y), F.avg(y), F.stddev_pop(y))
              .limit(bins + 1).collect())
    if len(groups) > bins or any(n != known or not math.isfinite(mean) or not math.isfinite(dev)
                                 for _, n, known, mean, dev in groups):
        return None
    copies = 1
    while 2 * copies * len(groups) < bins:
        copies *= 2
    rows = [(v, mean + side * dev, n / (2 * copies))
            for v, n, _, mean, dev in groups for side in (-1.0, 1.0) for _ in range(copies)]
    schema = T.StructType([train.schema[col], T.StructField(label, T.DoubleType()), T.StructField(f"{label}_weight", T.DoubleType())])
    return train.sparkSession.createDataFrame(rows, schema).coalesce(1)


def fit(kind: str, train: DataFrame, label: str, seed: int = 42, **kw):
    """One fitted model (``train`` must hold ``features``)."""
    if kind in TREES:
        col = kw.get("indexed") or "features"
        train = train.select(col, label)
        if kind == "gbt" and kw.keys() <= MOMENT_OPTIONS:
            rows = _moment_rows(train, col, label, kw.get("maxBins", 32))
            if rows is not None:
                return estimator(kind, label, seed=seed, weightCol=f"{label}_weight", **kw).fit(rows)
        train = _tree_parts(train)
    return estimator(kind, label, seed=seed, **kw).fit(train)


def fit_linear_coefficients(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """M11 as a table: ``(intercept, coef_<feature>...)`` of a gaussian /
    identity GLR fitted on the whole input."""
    m = fit("linear", assemble(df, features), label)
    row = [float(m.intercept)] + [float(c) for c in m.coefficients]
    names = ["intercept"] + [f"coef_{f}" for f in features]
    return df.sparkSession.createDataFrame([tuple(row)], names)


# ------------------------------------------------------------- pairs

@dataclass
class ModelPair:
    kind: str
    features: tuple[str, ...]
    models: dict[str, object]

    def predict(self, df: DataFrame) -> DataFrame:
        """Both predictions from the SAME input features (each model is
        a projection; no shuffle).  Gaussian / identity linear models are
        scored with a column expression (``dot(coef, x) + intercept`` in the
        estimator's own order of operations), so no feature vector is built;
        other models go through their ``transform``."""
        if self.kind == "net":
            for lab, m in self.models.items():
                df = m.transform(df, f"pred_{lab}")
            return df
        if self.kind == "linear" and "features" not in df.columns:
            return df.withColumns({f"pred_{lab}": self._linear_expr(m) for lab, m in self.models.items()})
        out = df if "features" in df.columns else assemble(df, self.features)
        for m in self.models.values():
            out = m.transform(out)
        drop = [c for c in out.columns if (c == "features" or c.startswith("indexed")) and c not in df.columns]
        return out.drop(*drop)

    def _linear_expr(self, model):
        dot = None
        for f, c in zip(self.features, model.coefficients):
            term = F.lit(float(c)) * F.col(f).cast("double")
            dot = term if dot is None else dot + term
        return dot + F.lit(float(model.intercept))


def fit_pair(kind: str, train: DataFrame, features: Sequence[str] = ("x", "y"),
             labels: Sequence[str] = LABELS, seed: int = 42, parallel: bool = True, **kw) -> ModelPair:
    """Both models of one kind (M11-M15, ``"net"`` for M16) on the same rows."""
    data = train if kind == "net" else assemble(train, features)

    def one(lab: str):
        if kind == "net":
            from trailframe.operators.mlp import fit_mlp

            return fit_mlp(data, features, lab, seed=seed, **kw)
        return fit(kind, data, lab, seed, **kw)

    with ThreadPoolExecutor(max_workers=len(labels) if parallel else 1) as pool:
        models = dict(zip(labels, pool.map(one, labels)))
    return ModelPair(kind, tuple(features), models)


def evaluate_pair(pair: ModelPair, test: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """``(rmse_x, rmse_y)`` in one aggregate over the test rows."""
    scored = pair.predict(test)
    return rmse(scored, [(f"pred_{lab}", lab) for lab in labels],
                [f"rmse_{lab.replace('next_', '')}" for lab in labels])


def model_report(transitions: DataFrame, kinds: Sequence[str] = ("linear", "tree", "forest", "gbt", "isotonic"),
                 features: Sequence[str] = ("x", "y"), train_fraction: float = 0.7, seed: int = 42,
                 key: Column | None = None, as_coded: bool = False,
                 options: dict[str, dict] | None = None) -> DataFrame:
    """Every model kind on both labels, one ``(model, rmse_x,
    rmse_y)`` table; ``"net"`` (M16) is a kind too.  ``as_coded=True`` trains
    on the 30 % part and scores on the 70 % part, as the reference's swapped
    unpacking does.  ``options`` holds keyword arguments per kind.

    The rows are split, assembled and indexed once and kept for all fits."""
    spark = transitions.sparkSession
    options = options or {}
    train, test = train_test_split(transitions, train_fraction, seed, key)
    if as_coded:
        train, test = test, train
    train, test = (assemble(d.select(*features, *LABELS), features) for d in (train, test))
    train = train.persist()
    if set(kinds) & set(TREES):
        index = index_categories(train, out="indexed")
        train.unpersist()
        train, test = index.transform(train).persist(), index.transform(test)
    test = test.persist()
    try:
        def run(kind: str):
            kw = dict(options.get(kind, {}))
            if kind == "net":
                from trailframe.operators.mlp import fit_mlp

                out = test
                with ThreadPoolExecutor(max_workers=len(LABELS)) as pool:
                    nets = list(pool.map(lambda lab: fit_mlp(train, features, lab, **kw), LABELS))
                for lab, net in zip(LABELS, nets):
                    out = net.transform(out, f"pred_{lab}")
            else:
                if kind in TREES:
                    kw["indexed"] = "indexed"
                with ThreadPoolExecutor(max_workers=len(LABELS)) as pool:
                    models = list(pool.map(lambda lab: fit(kind, train, lab, seed, **kw), LABELS))
                out = test
                for m in models:
                    out = m.transform(out)
            r = rmse(out, [(f"pred_{lab}", lab) for lab in LABELS], ["rmse_x", "rmse_y"]).first()
            return kind, float(r["rmse_x"]), float(r["rmse_y"])

        # every kind and both labels are fitted at the same time: the fits
        # are many small jobs, and Spark interleaves them across the cores
        with ThreadPoolExecutor(max_workers=len(kinds)) as pool:
            rows = list(pool.map(run, kinds))
    finally:
        train.unpersist()
        test.unpersist()
    return spark.createDataFrame(rows, "model string, rmse_x double, rmse_y double")
