"""Operator 1: a compression classifier of text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A text is compressed with each, in blocks of ``BLOCK`` bytes that
cover all of it.  The difference of the two sizes per byte of text says which
dictionary fits better; a logistic curve of it, fitted on labelled rows that
the dictionaries have not seen, is the score.  The curve also has the size
per byte (how far a text compresses at all: mere repetition fits either
dictionary equally well) and the logarithm of the length.  Its rows are
weighted so that the classes have their true shares, which calibrates the
score.

Fitting uses at most about ``rows_per_class`` labelled rows of each class,
chosen by a hash of the id, in one task; the two dictionaries and the curve
(at most 2 x ``dict_bytes``, plus a few numbers) are broadcast.  Scoring is
one pass over the scan without a shuffle.

Cases: null and empty texts have difference, size and length 0, and the
score of the curve there; repeated rows get equal scores; documents labelled both
ways and null labels teach nothing; with no labelled row of one class every
score is near that class (0.5 without any); an empty table gives no
rows; columns named like the new ones are replaced, others are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.llm.columns import append_columns
from trailframe.llm.common import crc_mod

BLOCK = 1024
DICT_BYTES = 65_536
ROWS_PER_CLASS = 2_000
LEVEL = 3


def blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    return [data[i:i + size] for i in range(0, len(data), size)]


class Measure:
    """Size difference per byte between the two dictionaries (positive where
    the good one fits better), size per byte, logarithm of the length."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        import zstandard as z

        par = z.ZstdCompressionParameters.from_level(level, write_content_size=0, write_dict_id=0,
                                                     format=z.FORMAT_ZSTD1_MAGICLESS)
        self.by = []
        for d in (good, bad):
            kind = z.DICT_TYPE_AUTO
            held = z.ZstdCompressionDict(d, dict_type=kind)
            held.precompute_compress(compression_params=par)
            self.by.append(z.ZstdCompressor(dict_data=held, compression_params=par).compress)

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        data = text.encode() if text else b""
        good, bad = self.by
        size = diff = 0
        for b in blocks(data):
            n = len(good(b))
            size += n
            diff += len(bad(b)) - n
        return diff / (len(data) + 16), size / (len(data) + 16), math.log(len(data) + 1)


def train_dictionary(texts: list[str], size: int) -> bytes:
    import zstandard as z

    parts = [b for t in texts for b in blocks(t.encode())]
    try:
        return z.train_dictionary(size, parts, k=64, d=8, f=18, accel=1, level=LEVEL).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself is the dictionary
        return (b"\n".join(parts) or b"\n")[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4,
             rounds: int = 60) -> list[float]:
    """Coefficients and offset of the weighted logistic curve (Newton steps
    on scaled variables, a small ridge)."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    a = np.column_stack(((x - mu) / sd, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    reg = ridge * weight.sum() * np.eye(len(w))
    reg[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + reg
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), a.T @ (weight * (p - y)) + reg @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return [*(w[:-1] / sd).tolist(), float(w[-1] - (w[:-1] * mu / sd).sum())]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS, dict_bytes: int = DICT_BYTES,
        level: int = LEVEL) -> dict:
    """The model, from documents whose ``label_col`` is 0 or 1.  The caller
    leaves rows out of ``labels`` that must not be learned from."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id_"))
             .agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi"))
             .filter("lo = hi").select("id_", F.col("lo").cast("int").alias("y_")))
    n = {r["y_"]: r["count"] for r in known.groupBy("y_").count().collect()}
    cut = [int(min(1.0, rows_per_class / n.get(c, 1)) * (1 << 62)) for c in (0, 1)]
    # ids of a bounded sample (about rows_per_class of each class): small by construction
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(11), "id_"), F.lit(1 << 62))
                          < F.when(F.col("y_") == 0, F.lit(cut[0])).otherwise(F.lit(cut[1])))
    sample = (docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
              .join(F.broadcast(chosen), "id_").select("id_", "y_", "text_").repartition(1))

    def run(it):
        rows = sorted((i, y, t or "") for b in it
                      for i, y, t in zip(*(c.to_pylist() for c in b.columns)))
        # of each class, three rows go to the dictionary, the fourth to the curve
        by = {c: [t for _, y, t in rows if y == c] for c in (0, 1)}
        fit_on = {c: [t for k, t in enumerate(v) if k % 4 < 3] for c, v in by.items()}
        test_on = {c: [t for k, t in enumerate(v) if k % 4 == 3] or v for c, v in by.items()}
        good = bad = b""
        if not by[0] or not by[1]:
            p = 0.5 if not rows else float(len(by[1]) > 0) * 0.98 + 0.01
            curve = [0.0, 0.0, 0.0, math.log(p / (1 - p))]
        else:
            good, bad = (train_dictionary(fit_on[c], dict_bytes) for c in (1, 0))
            m = Measure(good, bad, level)
            x = np.array([m(t) for c in (0, 1) for t in test_on[c]])
            y = np.array([float(c) for c in (0, 1) for _ in test_on[c]])
            share = {c: n.get(c, 0) / len(test_on[c]) / sum(n.values()) * len(y) for c in (0, 1)}
            curve = logistic(x, y, np.where(y == 1, share[1], share[0]))
        yield pa.RecordBatch.from_arrays([pa.array([good], pa.binary()), pa.array([bad], pa.binary()),
                                          pa.array([curve], pa.list_(pa.float64()))], names=["good", "bad", "curve"])

    r = sample.mapInArrow(run, "good binary, bad binary, curve array<double>").collect()
    if not r:
        return {"good": b"", "bad": b"", "curve": [0.0] * 4, "level": level}
    return {"good": bytes(r[0]["good"]), "bad": bytes(r[0]["bad"]), "curve": list(r[0]["curve"]), "level": level}


def score(docs: DataFrame, model: dict, text_col: str = "text",
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on),
    under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        measure = Measure(m["good"], m["bad"], m["level"]) if m["good"] and m["bad"] else lambda t: (0.0, 0.0, 0.0)
        *slope, offset = m["curve"]

        def run(texts):
            out = []
            for t in texts:
                v = sum(c * x for c, x in zip(slope, measure(t))) + offset
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, v)))))
            return [out, [int(s >= 0.5) for s in out]]

        return run

    return append_columns(docs, text_col, [(names[0], T.DoubleType(), pa.float64()),
                                           (names[1], T.IntegerType(), pa.int32())], make)


def teaching(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The label rows a model may be fitted on: ``crc32(id) mod 3`` is not 1."""
    return labels.filter(crc_mod(id_col, 3) != 1)
