"""Operator 6: language identification by sparse logistic regression.

Features are the TF-IDF weights of character n-grams (one to three
characters, lower case, runs of non-letters as one boundary), hashed into
``BUCKETS`` buckets and scaled to length 1.  Document frequencies are
counted over all documents that may be learned from.  The weights are fitted
with follow-the-regularised-leader (per-coordinate steps, elastic-net
penalty) on at most about ``rows_per_class`` documents of each language, and
the scores are calibrated with one temperature on a part of these that the
weights have not seen.

Counting is one pass that shuffles at most one row per bucket and task; the
fit is one task on the bounded sample; the weights (buckets x languages)
are broadcast; predicting is one pass over the scan without a shuffle.

Cases: null text and text without a letter are ``und`` with score 0; rows
with a null language or a null id are predicted, not learned from; the
weights, their broadcast and the plan grow with the number of distinct
languages (a few hundred at most are meant); repeated rows get equal results; without any row to learn from everything is
``und``; an empty table gives no rows; columns named like the new ones are
replaced, others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.llm.columns import append_columns
from trailframe.llm.segments import slices

BUCKETS = 1 << 16
ROWS_PER_CLASS = 1_500
UND = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: the code point, or 0 if it is no letter."""
    if not _LETTER:
        n = 0x110000
        _LETTER.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(n)), dtype=np.uint32, count=n))
    return _LETTER[0]


def grams(text: str | None) -> np.ndarray:
    """Bucket of every n-gram of the text; empty if it has no letter."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    c = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    c = np.concatenate(([0], c[keep], [0])).astype(np.uint32)
    if not c.any():
        return np.zeros(0, dtype=np.int64)
    mul, shift = np.uint32(2654435761), np.uint32(16)
    one = c * mul
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[1:]
    two *= mul
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + c[2:]
    three *= mul
    out = np.concatenate((one[c != 0], two, three))
    return ((out ^ (out >> np.uint32(11))) * mul >> shift).astype(np.int64)


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF weights, scaled to length 1."""
    g = grams(text)
    if not g.size:
        return g, np.zeros(0)
    n = np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    return at, x / np.sqrt(x @ x)


def ftrl(rows: list, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02,
         epochs: int = 4, seed: int = 5) -> np.ndarray:
    """Weights ``BUCKETS x classes`` of a multinomial logistic regression."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            gg = g * g
            z[at] = zz + g - (np.sqrt(nn + gg) - np.sqrt(nn)) / alpha * w
            n[at] = nn + gg
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss (golden section)."""
    def loss(log_t):
        s = logits / np.exp(log_t)
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text holds a letter."""
    return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents with a letter, over all
    rows; every task sends one row per bucket it has met at most."""
    def run(it):
        df = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in it:
            texts = batch.column(0).to_pylist()
            for _, part in slices(texts):
                for t in part:
                    g = grams(t)
                    if g.size:
                        seen = np.bincount(g, minlength=BUCKETS)
                        df[:BUCKETS] += seen > 0
                        df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["bucket", "n"])

    got = (docs.select(text_col).mapInArrow(run, "bucket int, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    if got.num_rows:
        out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_class: int = ROWS_PER_CLASS) -> dict:
    """The model.  The caller leaves rows out of ``docs`` that must not be
    learned from."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    df, n_docs = document_frequencies(known, text_col)
    counts = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().collect()}
    classes = sorted(counts)
    if not classes or not n_docs:
        return {"classes": []}
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((classes, idf))
    cuts = F.create_map(*[F.lit(v) for c in classes
                          for v in (c, int(min(1.0, rows_per_class / counts[c]) * (1 << 62)))])
    sample = (known.filter(F.pmod(F.xxhash64(F.lit(13), F.col(id_col)), F.lit(1 << 62)) < cuts[F.col(lang_col)])
              .select(F.col(id_col).alias("i"), F.col(lang_col).alias("y"), F.col(text_col).alias("t")).repartition(1))

    def run(it):
        names, weight = shared.value
        number = {c: k for k, c in enumerate(names)}
        rows = []
        for b in it:
            for i, y, t in zip(*(c.to_pylist() for c in b.columns)):
                at, x = features(t, weight)
                if at.size:
                    rows.append((i, at.astype(np.int32), x.astype(np.float32), number[y]))
        rows.sort(key=lambda r: r[0])
        rows = [r[1:] for r in rows]
        learn = [r for k, r in enumerate(rows) if k % 5] or rows
        test = [r for k, r in enumerate(rows) if k % 5 == 0]
        w = ftrl(learn, len(names))
        t = 1.0
        if test:
            t = temperature(np.stack([x @ w[at] for at, x, _ in test]), np.array([y for *_, y in test]))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()),
                                          pa.array([t], pa.float64())], names=["w", "t"])

    r = sample.mapInArrow(run, "w binary, t double").collect()
    if not r:
        return {"classes": []}
    w = np.frombuffer(bytes(r[0]["w"]), dtype="<f4").reshape(BUCKETS, len(classes))
    return {"classes": classes, "idf": idf, "w": w, "t": r[0]["t"]}


def predict(docs: DataFrame, model: dict, text_col: str = "text",
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (its probability), under
    ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            pred, score = [], []
            for t in texts:
                at, x = features(t, m["idf"]) if m["classes"] else ((), None)
                if not len(at):
                    pred.append(UND)
                    score.append(0.0)
                    continue
                s = (x @ m["w"][at]) / m["t"]
                p = np.exp(s - s.max())
                k = int(p.argmax())
                pred.append(m["classes"][k])
                score.append(float(p[k] / p.sum()))
            return [pred, score]

        return run

    return append_columns(docs, text_col, [(names[0], T.StringType(), pa.string()),
                                           (names[1], T.DoubleType(), pa.float64())], make)
