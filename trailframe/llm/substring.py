"""Operator 10: substring dedup with fixed-block anchors.

A window is ``WINDOW`` consecutive words of a document; a word goes if it
lies in a window whose words also start in a document of smaller id.

* Index: the non-overlapping blocks of ``BLOCK`` words of every document,
  one Bloom filter of them (of bounded size; more blocks than one filter
  holds are taken in several passes over the key space).
* Probe: every rolling block of every document against the filter.  Block
  keys met in two documents are shared; a window that occurs twice holds at
  least one shared block, since ``WINDOW >= 2 * BLOCK - 1``.
* Thin: of the shared blocks in each window only the one with the least key
  stays, so a passage of many documents is a few hits in each of them.  The
  choice depends on the window's words alone, so two documents that hold a
  window keep the same block of it.
* Extend: a hit is such a block with up to ``WINDOW - BLOCK`` words on
  either side, its context.  Hits with equal contexts agree in all their
  windows, so only the smallest id keeps them: the inner hits of long
  repeats end here, one row per block.  Where a block stands in several
  contexts, the windows of the first hit of each context are compared one by
  one (128-bit hashes), by grouped minima, never as pairs.  Covered stretches
  are joined into maximal repeats.

Every step is a pass over the texts that sends only hashes and positions of
hits, or a grouped minimum and an equi-join on hashes; texts are shuffled
only for documents that lose words.

Cases: null text and text without words has 0 words; rows with a null
``doc_id`` neither lose words nor make others lose them; repeated rows lose
the same words (an equal id is not a smaller one); texts of fewer than
``WINDOW`` words stay; an empty table gives no rows; columns named like the
new ones are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.llm import words as W
from trailframe.llm.common import bloom_hits, bloom_words, drop_scratch, materialize

WINDOW, BLOCK = 50, 25
MAX_BITS = 28
BITS_PER_KEY = 12


class Rolled:
    """Words of several texts with rolling block keys."""

    def __init__(self, part: list[bytes], window: int, block: int):
        self.data, self.start, self.end, h, self.bounds = W.batch_words(part)
        self.window, self.block = window, block
        count = np.diff(self.bounds)
        n = h.size - block + 1
        self.doc = np.repeat(np.arange(len(part)), count)
        self.inv = W.powers(W.P_WORD, h.size)[1]
        self.sums = [self._prefix(h), self._prefix(W.mix(h + W.U(W.SEEDS[1])))]
        if n <= 0:
            self.at = np.zeros(0, dtype=np.int64)
            self.key = np.zeros(0, dtype=W.U)
            return
        d = self.doc[:n]
        q = np.arange(n)
        self.at = q[(q + block <= self.bounds[d + 1]) & (count[d] >= window)]
        self.key = self.span(self.at, self.at + block)

    @staticmethod
    def _prefix(h):
        total = np.zeros(h.size + 1, dtype=W.U)
        np.cumsum(h * W.powers(W.P_WORD, h.size)[0][:h.size], out=total[1:])
        return total

    def span(self, a, b, seed=0):
        t = self.sums[seed]
        return W.mix((t[b] - t[a]) * self.inv[a])

    def first(self):
        """Start of the text of each block position."""
        return self.bounds[self.doc[self.at]]

    def keep(self, mask):
        self.at, self.key = self.at[mask], self.key[mask]

    def winnow(self, chunk: int = 1 << 16):
        """Keeps, of each window, the least of the keys left (the first of
        equal ones): every window that holds a key keeps one, and windows of
        equal words keep the same one, whatever stands around them."""
        if not self.at.size:
            return
        span, n = self.window - self.block + 1, self.doc.size
        keys = np.full(n + span, np.iinfo(W.U).max, dtype=W.U)
        keys[self.at] = self.key
        held = np.zeros(n + span, dtype=np.int64)
        held[self.at + 1] = 1
        held = np.cumsum(held)
        s = np.arange(max(0, n - self.window + 1))
        s = s[(self.doc[s] == self.doc[s + self.window - 1]) & (held[s + span] > held[s])]
        least = np.zeros(n, dtype=bool)
        view = np.lib.stride_tricks.sliding_window_view(keys, span)
        for a in range(0, s.size, chunk):
            part = s[a:a + chunk]
            least[part + view[part].argmin(axis=1)] = True
        self.keep(least[self.at])

    def context(self):
        """Range and digest of the words around each block position."""
        side = self.window - self.block
        d = self.doc[self.at]
        a = np.maximum(self.at - side, self.bounds[d])
        b = np.minimum(self.at + self.block + side, self.bounds[d + 1])
        shape = (self.at - a) * (2 * self.window) + (b - a)
        return a, b, W.mix(self.span(a, b) + shape.astype(W.U) * W.U(W.SEEDS[0]))


def _long(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == W.U else x.astype(np.int64))


def _rolled(batch, window, block):
    """``(row numbers in the batch, Rolled)`` slices of a batch ending in a text column."""
    for first, part in W.batches(batch.column(batch.num_columns - 1)):
        yield first, Rolled(part, window, block)


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(max(1, n) * BITS_PER_KEY))))
    return bloom_words(keys, "key", bits)


def index_blocks(src: DataFrame, window: int, block: int) -> DataFrame:
    """``key`` of every non-overlapping block."""
    def run(it):
        for batch in it:
            for _, r in _rolled(batch, window, block):
                yield pa.RecordBatch.from_arrays([_long(r.key[(r.at - r.first()) % block == 0])], names=["key"])

    return src.select("text").mapInArrow(run, "key long")


def shared_blocks(src: DataFrame, keys: DataFrame, n_keys: int, window: int, block: int) -> DataFrame:
    """Keys of index blocks that occur in two documents or more."""
    spark = src.sparkSession
    passes = max(1, math.ceil(n_keys * BITS_PER_KEY / (1 << MAX_BITS)))
    out = None
    for k in range(passes):
        mine = keys.filter(F.pmod(F.shiftrightunsigned("key", 8), F.lit(passes)) == k)
        bits = spark.sparkContext.broadcast(_filter(mine, n_keys // passes + 1))

        def run(it, bits=bits, k=k):
            filt = bits.value
            for batch in it:
                for first, r in _rolled(batch, window, block):
                    if passes > 1:
                        r.keep((r.key >> W.U(8)) % W.U(passes) == W.U(k))
                    r.keep(bloom_hits(filt, r.key))
                    if r.at.size:
                        yield pa.RecordBatch.from_arrays(
                            [_long(r.key), batch.column(0).take(pa.array(first + r.doc[r.at])),
                             pa.array((r.at - r.first()) % block == 0)], names=["key", "doc_id", "aligned"])

        hits = (src.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, aligned boolean")
                .groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                                    F.max("aligned").alias("aligned"))
                .filter("lo < hi and aligned").select("key"))
        out = hits if out is None else out.union(hits)
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``rid, a, b``: word ranges to remove, by the row id of ``docs(doc_id,
    rid, text)``."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at every offset")
    spark = docs.sparkSession
    src = docs.filter("doc_id is not null and text is not null").select("doc_id", "rid", "text")
    keys = materialize(index_blocks(src, window, block), "blocks")
    shared = materialize(shared_blocks(src, keys, keys.count(), window, block), "shared")
    drop_scratch(keys)
    n_shared = shared.count()
    bits = spark.sparkContext.broadcast(_filter(shared, n_shared))

    def hits(it):
        filt = bits.value
        for batch in it:
            for first, r in _rolled(batch, window, block):
                r.keep(bloom_hits(filt, r.key))
                r.winnow()
                if not r.at.size:
                    continue
                a, b, c = r.context()
                rows = pa.array(first + r.doc[r.at])
                base = r.first()
                yield pa.RecordBatch.from_arrays(
                    [_long(r.key), _long(c), batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array((r.at - base).astype(np.int32)), pa.array((a - base).astype(np.int32)),
                     pa.array((b - base).astype(np.int32))], names=["key", "c", "doc_id", "rid", "at", "a", "b"])

    found = materialize(src.mapInArrow(hits, "key long, c long, doc_id long, rid long, at int, a int, b int"), "hits")
    lowest = materialize(found.groupBy("key", "c").agg(F.min("doc_id").alias("least"),
                                                       F.max("doc_id").alias("most")), "contexts")
    # equal contexts: all but the smallest id lose the whole context
    agreed = (found.join(lowest.filter("least < most").select("key", "c", "least"), ["key", "c"])
              .filter("doc_id > least").select("rid", "a", "b"))
    # several contexts: windows of the first hit of each are compared
    several = lowest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    heads = (found.join(lowest.select("key", "c", "least"), ["key", "c"]).filter("doc_id = least")
             .join(several, "key").select(F.xxhash64("rid", "at").alias("key")))
    heads = materialize(heads, "heads")
    near = spark.sparkContext.broadcast(_filter(heads, heads.count()))

    def spelled(it):
        shared_filt, head_filt = bits.value, near.value
        for batch in it:
            rid = batch.column(1).to_numpy()
            for first, r in _rolled(batch, window, block):
                r.keep(bloom_hits(shared_filt, r.key))
                if not r.at.size:
                    continue
                base = r.first()
                r.keep(bloom_hits(head_filt, xxhash64_pair(rid[first + r.doc[r.at]], (r.at - base).astype(np.int32))))
                if not r.at.size:
                    continue
                a, b, _ = r.context()
                mark = np.zeros(r.doc.size + 1, dtype=np.int32)
                ok = b - a >= window
                np.add.at(mark, a[ok], 1)
                np.add.at(mark, (b - window + 1)[ok], -1)
                s = np.flatnonzero(np.cumsum(mark[:-1]))
                d = r.doc[s]
                rows = pa.array(first + d)
                yield pa.RecordBatch.from_arrays(
                    [_long(r.span(s, s + window)), _long(r.span(s, s + window, 1)), batch.column(0).take(rows),
                     batch.column(1).take(rows), pa.array((s - r.bounds[d]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "rid", "a"])

    windows = materialize(src.mapInArrow(spelled, "h1 long, h2 long, doc_id long, rid long, a int"), "windows")
    least = (windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .filter("least < most").select("h1", "h2", "least"))
    single = (windows.join(least, ["h1", "h2"]).filter("doc_id > least")
              .select("rid", "a", (F.col("a") + window).alias("b")))
    return agreed.union(single)


def xxhash64_pair(rid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(rid, at)`` for a long and an int column, in numpy."""
    p1, p2, p3, p4, p5 = (W.U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                           0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def rot(x, r):
        return (x << W.U(r)) | (x >> W.U(64 - r))

    def last(h):
        h = (h ^ (h >> W.U(33))) * p2
        h = (h ^ (h >> W.U(29))) * p3
        return h ^ (h >> W.U(32))

    h = W.U(42) + p5 + W.U(8)
    h = last(rot(h ^ (rot(rid.view(W.U) * p2, 31) * p1), 27) * p1 + p4)
    h = h + p5 + W.U(4)
    return last(rot(h ^ (at.view(np.uint32).astype(W.U) * p1), 23) * p2 + p3)


FIELDS = ("n_words", "n_removed", "kept_sha256")


def cut(text: str | None, spans: list, with_text: bool) -> tuple:
    """``(n_words, n_removed, kept_sha256, text)`` of one text; an untouched
    text comes back as it was, runs of kept words otherwise joined by a
    space."""
    data, start, end, _, _ = W.batch_words([(text or "").encode()])
    n = start.size
    words = data.split() if data.isascii() else None
    mark = np.zeros(n + 1, dtype=np.int32)
    for a, b in spans:
        mark[a] += 1
        mark[b] -= 1
    gone = np.cumsum(mark[:n]) > 0
    at = np.flatnonzero(~gone)
    if words is None or len(words) != n:
        words = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
    kept = b" ".join([words[i] for i in at.tolist()] if at.size < n else words)
    out = text
    if with_text and at.size < n:
        edge = np.flatnonzero(np.diff(at) > 1)
        heads = np.concatenate((at[:1], at[edge + 1]))
        tails = np.concatenate((at[edge], at[-1:]))
        out = b" ".join(data[start[i]:end[j]] for i, j in zip(heads.tolist(), tails.tolist())).decode()
    return n, n - at.size, hashlib.sha256(kept).hexdigest(), out


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = True, names: tuple[str, str, str] = FIELDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` (kept words
    joined by one space), under ``names``, and, with ``with_text``, the
    cleaned text in place of the text (without, the text column goes)."""
    spark = docs.sparkSession
    base = docs.drop(*names)
    row, lists = "trailframe_row_", "trailframe_spans_"
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    src = base.select(F.col(id_col).cast("long").alias("doc_id"), rid.alias("rid"), F.col(text_col).alias("text"))
    spans = materialize(repeated_spans(src, window, block), "spans")
    by_row = spans.distinct().groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias(lists))
    touched = spark.sparkContext.broadcast(_filter(spans.select(F.col("rid").alias("key")).distinct(),
                                                   spans.select("rid").distinct().count()))
    wide = base.withColumn(row, F.when(F.col(id_col).isNotNull(), rid))
    own = base.columns
    at = own.index(text_col)
    kinds = T.StructType([f for f in base.schema.fields if with_text or f.name != text_col]
                         + [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.StringType()))])

    def result(batch, spans_of):
        texts = batch.column(at).to_pylist()
        got = [cut(t, s, with_text) for t, s in zip(texts, spans_of)]
        cols = []
        for k, name in enumerate(own):
            if name != text_col:
                cols.append(batch.column(k))
            elif with_text:
                cols.append(pa.array([g[3] for g in got], pa.string()))
        cols += [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array([g[2] for g in got], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=kinds.names)

    def split(batch):
        key = batch.column(len(own))
        known = np.asarray(key.is_valid())
        hit = np.zeros(batch.num_rows, dtype=bool)
        at_ = np.flatnonzero(known)
        hit[at_] = bloom_hits(touched.value, key.take(pa.array(at_)).to_numpy().view(np.uint64))
        return hit

    def parts(batch, step=512):
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)

    def untouched(it):
        for batch in it:
            for b in parts(batch.take(pa.array(np.flatnonzero(~split(batch))))):
                yield result(b, [()] * b.num_rows)

    def candidates(it):
        for batch in it:
            yield batch.take(pa.array(np.flatnonzero(split(batch))))

    def with_spans(it):
        for batch in it:
            for b in parts(batch):
                found = b.column(len(own) + 1).to_pylist()
                yield result(b, [[(x["a"], x["b"]) for x in s] if s else () for s in found])

    rest = wide.mapInArrow(untouched, kinds)
    mine = (wide.mapInArrow(candidates, wide.schema)
            .join(by_row.withColumnRenamed("rid", row), row, "left")
            .select(*own, row, lists).mapInArrow(with_spans, kinds))
    return rest.unionByName(mine)
