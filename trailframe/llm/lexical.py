"""Operator 12: ranked lexical search by multi-query common-subexpression
evaluation.

All items of a query set are answered in one pass over the documents:

* every block of items is mined for shared term sets: while two sets of
  accumulators (at first single terms) stand together in two items or more,
  the pair that stands in most becomes a node of its own, and the items use
  the node in its place.  The result is a sharing graph, each node the sum of
  two others, each item the sum of a few nodes;
* the documents are cut into terms once; what is left of a document is its
  length and the frequencies of the query set's terms, written as a table;
* a task takes documents in batches, fills the accumulators of single terms,
  adds up the shared ones once in the order of the graph, and sums each item
  from its nodes.  It keeps the best ``top`` documents of each item, so what
  it sends does not grow with its rows; the rest is a grouped top-n.

Items are blocks of about ``BLOCK_BYTES`` of text, mined in parallel and
taken one after another, so neither the graph that is broadcast nor the
accumulators of a task grow with the query set (an item longer than that is
a block with those that fall to it).  Terms are maximal runs of characters
other than ASCII controls, blanks and punctuation; only A-Z is lower-cased.

Cases: null and empty texts and texts without a term rank nowhere and do not
count; an item without terms, or whose terms no document holds, gives no
rows; a row with a null ``doc_id`` counts in the statistics but is not
ranked; repeated documents rank once each, repeated items are answered once
each; ties go to the smaller id; empty tables give no rows; very long texts
are cut in parts; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import materialize
from trailframe.session import ensure_checkpoint_dir

TOP = 50
BLOCK_BYTES = 1 << 18
#: nodes of an item that take part in mining, the most shared ones (decides
#: only how much is shared, never a score)
MINED = 96
#: accumulators of a task, in bytes
MATRIX_BYTES = 1 << 25
SLICE = 1 << 20

_TERMS = bytearray(range(256))
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERMS[_a:_b + 1] = b" " * (_b + 1 - _a)
_TERMS[0x41:0x5B] = bytes(range(0x61, 0x7B))
_TERMS = bytes(_TERMS)


def term_parts(text: str):
    """The terms of a text in order, as UTF-8, part by part."""
    b = text.encode("utf-8").translate(_TERMS)
    a = 0
    while len(b) - a > SLICE:
        z = b.find(b" ", a + SLICE)
        if z < 0:
            break
        yield b[a:z].split()
        a = z
    yield (b[a:] if a else b).split()


def share(items: list[list[int]], n_terms: int, mined: int = MINED) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The sharing graph of sets of terms: pairs of nodes (node ``n_terms +
    j`` is the sum of pair j) and the nodes that make up each item.  Every
    node stands for a set of terms, those of an item are disjoint."""
    spread = Counter(t for s in items for t in s)
    active = [set(heapq.nsmallest(mined, (t for t in s if spread[t] > 1), key=lambda t: (-spread[t], t)))
              for s in items]
    rest = [sorted(set(s) - a) for s, a in zip(items, active)]
    holders: dict[int, set[int]] = defaultdict(set)
    for i, s in enumerate(active):
        for t in s:
            holders[t].add(i)
    together: Counter = Counter()
    for s in active:
        order = sorted(s)
        together.update((a, b) for k, a in enumerate(order) for b in order[k + 1:])
    heap = [(-c, p) for p, c in together.items() if c > 1]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap:
        c, pair = heapq.heappop(heap)
        now = together[pair]
        if now < 2:
            continue
        if now != -c:
            heapq.heappush(heap, (-now, pair))
            continue
        a, b = pair
        node = n_terms + len(merges)
        merges.append(pair)
        grown: Counter = Counter()
        for i in holders[a] & holders[b]:
            s = active[i]
            s -= {a, b}
            holders[a].discard(i), holders[b].discard(i)
            for x in s:
                together[(min(a, x), max(a, x))] -= 1
                together[(min(b, x), max(b, x))] -= 1
                grown[(x, node)] += 1
            s.add(node)
            holders[node].add(i)
        together[pair] = 0
        together.update(grown)
        for p, k in grown.items():
            if k > 1:
                heapq.heappush(heap, (-k, p))
    return merges, [sorted(a) + r for a, r in zip(active, rest)]


GRAPH = ("block int, vocabulary array<binary>, left array<int>, right array<int>, items array<long>, "
         "nodes array<array<int>>")


def graphs(items: DataFrame, blocks: int) -> DataFrame:
    """One row per block of ``items(item, text)``: its sharing graph."""
    def mine(t: pa.Table) -> pa.Table:
        sets = [sorted({w for part in term_parts(x or "") for w in part}) for x in t.column("text").to_pylist()]
        vocabulary = sorted({w for s in sets for w in s})
        number = {w: i for i, w in enumerate(vocabulary)}
        merges, nodes = share([[number[w] for w in s] for s in sets], len(vocabulary))
        return pa.table([
            pa.array([t.column("block")[0].as_py()], pa.int32()), pa.array([vocabulary], pa.list_(pa.binary())),
            pa.array([[a for a, _ in merges]], pa.list_(pa.int32())),
            pa.array([[b for _, b in merges]], pa.list_(pa.int32())),
            pa.array([t.column("item").to_pylist()], pa.list_(pa.int64())),
            pa.array([nodes], pa.list_(pa.list_(pa.int32())))],
            names=["block", "vocabulary", "left", "right", "items", "nodes"])

    return (items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int"))
            .groupBy("block").applyInArrow(mine, GRAPH))


def frequencies(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs``: length of each document with a term, and
    the terms of the vocabulary in it with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(it):
        number = shared.value
        wanted = number.keys()
        for b in it:
            rows, n, at, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found: Counter = Counter()
                total = 0
                for part in term_parts(text or ""):
                    total += len(part)
                    found.update(part)
                if total:
                    hit = wanted & found.keys()
                    terms += [number[w] for w in hit]
                    tfs += [found[w] for w in hit]
                    rows.append(i), n.append(total), at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weights(n_docs: int, df: dict[int, int], n_terms: int) -> np.ndarray:
    """``floor(1000 ln((2N + 2) / (2 df + 1)))`` of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
                     for t in range(n_terms)], np.int64)


def score_batches(freq: DataFrame, graph, w: np.ndarray, n_docs: int, n_terms_all: int, top: int) -> DataFrame:
    """``place, doc_id, score``: the best documents of each item (by its
    place in the block), task by task."""
    left = np.array(graph.left, np.int64)
    right = np.array(graph.right, np.int64)
    nodes = [np.array(x, np.int64) for x in graph.nodes]
    shared = freq.sparkSession.sparkContext.broadcast((w, left, right, nodes))

    def best(scores, ids):
        keep = np.lexsort((ids, -scores))[:top]
        return scores[keep], ids[keep]

    def run(it):
        w, left, right, nodes = shared.value
        size = w.size + left.size
        step = max(16, MATRIX_BYTES // (8 * max(1, size)))
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(nodes)
        least = np.ones(len(nodes), np.int64)
        for b in it:
            ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = b.column(2).offsets.to_numpy().astype(np.int64)
            terms, tfs = (b.column(k).values.to_numpy().astype(np.int64) for k in (2, 3))
            m = 50 + (50 * n * n_docs) // n_terms_all
            for a in range(0, b.num_rows, step):
                z = min(b.num_rows, a + step)
                part = slice(ends[a], ends[z])
                col = np.repeat(np.arange(z - a), np.diff(ends[a:z + 1]))
                t, tf = terms[part], tfs[part]
                acc = np.zeros((size, z - a), np.int64)
                acc[t, col] = w[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[a:z][col]))
                for j, (x, y) in enumerate(zip(left.tolist(), right.tolist()), w.size):
                    np.add(acc[x], acc[y], out=acc[j])
                for k, own in enumerate(nodes):
                    total = acc[own].sum(axis=0) if own.size else acc[:0].sum(axis=0)
                    hit = np.flatnonzero(total >= least[k])
                    if hit.size:
                        s, d = kept[k]
                        kept[k] = s, d = best(np.concatenate((s, total[hit])), np.concatenate((d, ids[a:z][hit])))
                        if s.size == top:
                            least[k] = s[-1]
        places = np.repeat(np.arange(len(kept)), [s.size for s, _ in kept])
        if places.size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), pa.array(np.concatenate([d for _, d in kept])),
                 pa.array(np.concatenate([s for s, _ in kept]))], names=["place", "doc_id", "score"])

    return (freq.filter("doc_id is not null and size(terms) > 0")
            .mapInArrow(run, "place int, doc_id long, score long"))


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each
    item."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    queries = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    total = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    made = materialize(graphs(queries, max(1, math.ceil(total / block_bytes))), "graphs")
    numbers = [r.block for r in made.select("block").collect()]  # one for each block of BLOCK_BYTES
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trailframe-llm/ranked-{uuid.uuid4().hex}"
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(root)
    for block in sorted(numbers):
        graph = made.filter(F.col("block") == block).first()
        freq = materialize(frequencies(src, graph.vocabulary), "frequencies")
        n_docs, n_all = freq.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = {r.t: r.c for r in freq.select(F.explode("terms").alias("t")).groupBy("t")
              .agg(F.count(F.lit(1)).alias("c")).collect()}  # at most the block's terms
        found = score_batches(freq, graph, weights(n_docs, df, len(graph.vocabulary)), n_docs, n_all, top)
        order = [F.desc("score"), "doc_id"]
        some = Window.partitionBy("place", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
        every = Window.partitionBy("place").orderBy(*order)
        ranked = (found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
                  .withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= top))
        names = F.from_json(F.lit(str([-1 if i is None else i for i in graph["items"]])), "array<long>")
        unnamed = F.from_json(F.lit(str([int(i is None) for i in graph["items"]])), "array<int>")
        (ranked.select(F.when(unnamed[F.col("place")] == 0, names[F.col("place")]).alias("item_id"),
                       F.col("rank").cast("int").alias("rank"), "doc_id", "score")
         .write.mode("append").parquet(root))
    return spark.read.schema(schema).parquet(root)
