"""Operator 7: n-gram Jaccard join by a grouped prefix join.

The set of a document holds its distinct word n-grams (64-bit hashes).  With
the n-grams of every set in one global order, rare ones first, two sets of
Jaccard similarity ``t`` or more share an n-gram among their first
``n - ceil(t n) + 1``.  Documents with the same first n-grams and the same
size form a group and stand in the inverted lists once; pairs of groups are
filtered by size and by position; what is left is expanded to members and
verified on whole sets.

* The order comes from a count sketch over all documents (``SKETCH``
  counters; its size is fixed, it is broadcast, and it decides speed only).
* Equal sets are one class (its smallest id stands for it).
* Lists are first searched as stars: each entry against the most central one
  of its size range, the one with the largest share of its first n-grams in
  lists at all.  In a group of near copies that is the text they were made
  from, so the group is linked in linear time.  The lists that still hold
  more than one component are then searched in full: entries outside the
  component of the list's most central entry against all, so a pair is left
  out only when its members are already linked.
* An n-gram of a prefix is live if its list holds another group.  Of two
  sets, what the one whose prefix ends first in the order shares lies among
  its live n-grams and its rest, so it can be alike only to sets up to a size
  that follows from their number.  In the full search it goes to the size
  classes of that range only: near copies with too many edits meet none of
  the many sets of their own size.
* Each set has a parity bitmap of ``PARITY`` bits.  Two sets differ in at
  least as many n-grams as their bitmaps differ in bits, so pairs whose
  bitmaps differ too much go before any set is moved.
* Sets are made again from the texts for the documents in the pairs that are
  left only, found in the scan with a Bloom filter of fixed size and joined
  exactly.

Cases: null text and text without words has 0 n-grams and links with
nothing; a text of fewer words than ``n`` is one n-gram; a null ``doc_id``
keeps its row, with a null component; repeated rows share their component;
rows that share an id are one document; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm import words as W
from trailframe.llm.common import (bloom_hits, bloom_words, connected_components, drop_scratch, materialize)

SKETCH = 20
CHUNK = 4096
PARITY = 1024
BLOOM_BITS = 24
#: ratio of the sizes in a size class
SIZE_CLASS = 1.1


def shingle_sets(part: list[bytes], n: int):
    """The sorted distinct n-gram hashes of each text."""
    _, _, _, h, bounds = W.batch_words(part, lower=True)
    grams = W.windows(h, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            yield W.mix(W.windows(h[a:b], b - a) + W.U(b - a))
        else:
            yield h[:0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_sketch(docs: DataFrame, n: int, log2_size: int = SKETCH) -> np.ndarray:
    """Documents per counter, over all documents; each task sends its
    counters in chunks, which are added up."""
    size = 1 << log2_size
    mask = W.U(size - 1)

    def run(it):
        counts = np.zeros(size, dtype=np.int64)
        for batch in it:
            for _, part in W.batches(batch.column(0)):
                hs = [s for s in shingle_sets(part, n) if s.size]
                if hs:
                    counts += np.bincount((np.concatenate(hs) & mask).astype(np.int64), minlength=size)
        step = min(CHUNK, size)
        rows = [(i, _packed(counts[i * step:(i + 1) * step])) for i in range(size // step)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                          pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "c"])

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(c, dtype=f"<u{len(c) // min(CHUNK, size)}").astype("<u8")
                sums[i] = sums[i] + v if i in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["chunk", "c"])

    got = (docs.select("text").mapInArrow(run, "chunk int, c binary")
           .repartition(8, "chunk").mapInArrow(add, "chunk int, c binary").toArrow())
    out = np.zeros(size, dtype=np.uint64)
    step = min(CHUNK, size)
    for i, c in zip(got.column("chunk").to_pylist(), got.column("c").to_pylist()):
        out[i * step:(i + 1) * step] = np.frombuffer(c, dtype="<u8")
    # only the order of the counters matters, so they may be saturated
    return np.minimum(out, np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _packed(counts: np.ndarray) -> bytes:
    """Counters in the fewest bytes that hold the largest."""
    top = int(counts.max())
    return counts.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def parity(s: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of the set's members fall on each bit."""
    odd = (np.bincount((s >> W.U(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def signatures(docs: DataFrame, n: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """``doc_id, n, f1, f2`` (digest of the set), ``bits`` (its parity
    bitmap), ``g`` (digest of prefix and size), ``prefix`` and ``last`` (the
    place of its end in the order); the prefix stands once per group and
    task, with a document that has an id (rows without one are in no list)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    mask = W.U(sketch.size - 1)

    def run(it):
        freq = shared.value
        sent: set[int] = set()
        for batch in it:
            ids = batch.column(0)
            for first, part in W.batches(batch.column(1)):
                size, f1, f2, bits, g, prefix, last = [], [], [], [], [], [], []
                named = ids.slice(first, len(part)).is_valid().to_pylist()
                for s, has_id in zip(shingle_sets(part, n), named):
                    k = s.size
                    size.append(k)
                    if not k:
                        f1.append(0), f2.append(0), bits.append(None), g.append(0), prefix.append(None), last.append(None)
                        continue
                    bits.append(parity(s))
                    f1.append(int(_signed(W.mix(s).sum(keepdims=True))[0]))
                    f2.append(int(_signed(W.mix(s ^ W.U(W.SEEDS[1])).sum(keepdims=True))[0]))
                    p = k - -(-num * k // den) + 1
                    order = np.lexsort((s, freq[(s & mask).astype(np.int64)]))[:p]
                    pre = s[order]
                    gid = int(_signed(W.mix(W.mix(pre).sum(keepdims=True) + W.U(k)))[0])
                    g.append(gid)
                    last.append(int(freq[int(pre[-1] & mask)]).to_bytes(4, "big") + int(pre[-1]).to_bytes(8, "big"))
                    if has_id and gid not in sent:
                        prefix.append(_signed(pre))
                        sent.add(gid)
                    else:
                        prefix.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(part)), pa.array(size, pa.int32()), pa.array(f1, pa.int64()),
                     pa.array(f2, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(g, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64())), pa.array(last, pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "bits", "g", "prefix", "last"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n int, f1 long, f2 long, bits array<long>, g long, prefix array<long>, last binary")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``doc_id, f1, grams`` of the documents whose id is in ``wanted(x)``
    (and of a few others, which later joins drop)."""
    bits = docs.sparkSession.sparkContext.broadcast(
        bloom_words(wanted.select(F.xxhash64("x").alias("k")), "k", BLOOM_BITS))

    def run(it):
        filt = bits.value
        for batch in it:
            hit = np.flatnonzero(bloom_hits(filt, batch.column(1).to_numpy().view(np.uint64)))
            if not hit.size:
                continue
            batch = batch.take(pa.array(hit))
            for first, part in W.batches(batch.column(2)):
                sets = list(shingle_sets(part, n))
                f1 = [int(_signed(W.mix(s).sum(keepdims=True))[0]) if s.size else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(f1, pa.int64()),
                     pa.array([_signed(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "f1", "grams"])

    return (docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("k"), "text")
            .mapInArrow(run, "doc_id long, f1 long, grams array<long>"))


def _alike(n1: Column, n2: Column, num: int, den: int) -> Column:
    return den * F.least(n1, n2) >= num * F.greatest(n1, n2)


def _reach(one: dict[str, Column], two: dict[str, Column], num: int, den: int, *bounds: Column) -> Column:
    """A common n-gram of two entries leaves room for enough of them: before
    it the live n-grams, after it the rest of both sets (and other
    ``bounds``)."""
    rest = F.least(one["n"] - one["p"] - 1, two["n"] - two["p"] - 1, *bounds)
    return (num + den) * (F.least(one["before"], two["before"]) + 1 + rest) >= num * (one["n"] + two["n"])


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(SIZE_CLASS)))).cast("int")


def _partner_classes(num: int, den: int) -> Column:
    """Size classes of the sets that an entry ``(n, live)`` may be alike to
    if its prefix ends first: at least ``num / den`` of its size, at most
    what its live n-grams and its rest allow."""
    n, live = F.col("n").cast("long"), F.col("live")
    rest = F.expr(f"({num}L * n + {den - 1}) div {den} - 1")
    low = F.expr(f"({num}L * n + {den - 1}) div {den}")
    high = F.least(F.expr(f"{den}L * n div {num}"),
                   F.floor((num + den) * (live + rest) / F.lit(num)) - n)
    return F.when(high >= low, F.sequence(_size_class(low), _size_class(high))).otherwise(F.array().cast("array<int>"))


def _promising(found: DataFrame, one: str, two: str, num: int, den: int) -> DataFrame:
    """Pairs ``(one, two)`` from one row per n-gram that both prefixes hold,
    with positions ``p, p2`` and sizes ``n, n2``.  No common n-gram lies
    before the first one; beyond the last one at most the rest is common."""
    c = F.col
    pairs = found.groupBy(one, two).agg(
        F.count(F.lit(1)).alias("c"), F.min("p").alias("a"), F.min("p2").alias("a2"), F.max("p").alias("z"),
        F.max("p2").alias("z2"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    most = F.least(1 + F.least(c("n") - c("a") - 1, c("n2") - c("a2") - 1),
                   c("c") + F.least(c("n") - c("z") - 1, c("n2") - c("z2") - 1))
    return pairs.filter((num + den) * most >= num * (c("n") + c("n2"))).select(one, two)


def _verified(docs: DataFrame, pairs: DataFrame, sig: DataFrame, classes: DataFrame, n: int, num: int,
              den: int) -> DataFrame:
    """Links ``(a, b)`` among candidate pairs ``(x, y)`` of class ids."""
    one = sig.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    two = one.withColumnsRenamed({"x": "y", "nx": "ny", "bx": "by"})
    apart = F.aggregate(F.zip_with("bx", "by", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    # common members are at most half of what both sets hold beyond the difference
    pairs = materialize(
        pairs.join(one, "x").join(two, "y")
        .filter((num + den) * (F.col("nx") + F.col("ny") - apart) >= 2 * num * (F.col("nx") + F.col("ny")))
        .select("x", "y").distinct(), "pairs")
    wanted = pairs.select("x").union(pairs.select(F.col("y").alias("x"))).distinct()
    keys = wanted.join(classes.select(F.col("rep").alias("x"), "f1"), "x")
    sets = materialize(
        sets_of(docs, wanted, n).join(keys.withColumnRenamed("x", "doc_id"), ["doc_id", "f1"])
        .select(F.col("doc_id").alias("x"), "grams"), "sets")
    both = (pairs.join(sets, "x")
            .join(sets.select(F.col("x").alias("y"), F.col("grams").alias("other")), "y"))
    common = F.size(F.array_intersect("grams", "other"))
    links = (both.filter((num + den) * common >= num * (F.size("grams") + F.size("other")))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = materialize(links, "links")
    drop_scratch(sets)
    drop_scratch(pairs)
    return links


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents whose sets have a
    Jaccard similarity of ``num / den`` or more are linked; the component is
    the smallest id reachable."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = count_sketch(src, n)
    made = materialize(signatures(src, n, num, den, sketch), "prefixes")
    sig = materialize(made.drop("prefix", "last"), "signatures")
    ends = materialize(made.filter("prefix is not null").groupBy("g").agg(F.min("last").alias("last")), "ends")
    classes = materialize(
        sig.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n", "g")
        .agg(F.min("doc_id").alias("rep")), "classes")
    # inverted lists of groups; lists of one group go
    w = Window.partitionBy("token")
    lists = (made.filter("prefix is not null and doc_id is not null")
             .select("g", "n", F.posexplode("prefix").alias("p", "token"))
             .select("token", "g", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("p")).alias("np")))
    # the live n-grams of a group: those with another group in their list
    own = Window.partitionBy("g")
    live = materialize(
        lists.withColumns({"lo": F.min("g").over(w), "hi": F.max("g").over(w)}).filter("lo <> hi")
        .select("token", "g", F.shiftright("np", 32).cast("int").alias("n"),
                F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("p")).distinct()
        .withColumns({"live": F.count(F.lit(1)).over(own).cast("int"),
                      "before": (F.row_number().over(own.orderBy("p")) - 1).cast("int")}), "lists")
    drop_scratch(made)
    groups = classes.groupBy("g").agg(F.min("rep").alias("gid"))

    # stars: each entry of a list against the most central of its size range
    c = F.col
    entry = ("g", "n", "p", "before")
    length = c("n") - F.expr(f"({num}L * n + {den - 1}) div {den}") + 1
    central = c("live") / length
    near = Window.partitionBy("token", F.floor(F.log("n") / np.log(1.25)))
    hub = F.min(F.struct((-central).alias("k"), *entry)).over(near)
    stars = (live.withColumn("h", hub)
             .filter((c("g") != c("h.g")) & _alike(c("n"), c("h.n"), num, den)
                     & _reach({x: c(x) for x in entry}, {x: c(f"h.{x}") for x in entry}, num, den))
             .select("g", c("h.g").alias("hg")).distinct())
    first = (stars.join(groups.select("g", F.col("gid").alias("x")), "g")
             .join(groups.select(F.col("g").alias("hg"), F.col("gid").alias("y")), "hg").select("x", "y")
             .union(classes.join(groups, "g").filter("rep <> gid").select(F.col("rep").alias("x"),
                                                                          F.col("gid").alias("y"))))
    links = _verified(src, first.filter("x <> y"), sig, classes, n, num, den)
    label = connected_components(links)

    # the lists that still hold several components
    named = materialize(
        classes.join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "g", F.coalesce("component", "rep").alias("label")), "labels")
    of_group = named.groupBy("g").agg(F.min("label").alias("lmin"), F.max("label").alias("lmax"))
    # of each list, the component of its most central entry stays among itself
    main = F.min(F.struct((-central).alias("k"), "g", "lmin")).over(w)
    entry += ("lmin", "lmax", "last")
    open_ = materialize(
        live.join(of_group.join(ends, "g"), "g")
        .withColumns({"lo": F.min("lmin").over(w), "hi": F.max("lmax").over(w), "main": main}).filter("lo <> hi")
        .select("token", *entry, "live",
                ((c("lmin") != c("main.lmin")) | (c("lmax") != c("main.lmin"))).alias("few")), "open")
    # each entry under its size and whether it is outside that component; the
    # one whose prefix ends first looks for its partners, at least one of them outside
    stands = open_.select("token", _size_class(c("n")).alias("class"), "few", *[c(x).alias(f"{x}2") for x in entry])
    looks = (open_.withColumn("class", F.explode(_partner_classes(num, den)))
             .withColumnRenamed("few", "out")
             .withColumn("few", F.explode(F.when(c("out"), F.array(F.lit(True), F.lit(False)))
                                          .otherwise(F.array(F.lit(True))))))
    # what the one whose prefix ends first shares after an n-gram is live or behind its prefix
    after = F.expr(f"live - before - 2 + ({num}L * n + {den - 1}) div {den}")
    found = (looks.join(stands, ["token", "class", "few"])
             .filter((c("g") != c("g2")) & ((c("last") < c("last2")) | ((c("last") == c("last2")) & (c("g") < c("g2"))))
                     & ((c("lmin") != c("lmin2")) | (c("lmax") != c("lmax2")) | (c("lmin") != c("lmax")))
                     & _alike(c("n"), c("n2"), num, den)
                     & _reach({x: c(x) for x in entry}, {x: c(f"{x}2") for x in entry}, num, den, after)))
    side = c("g") < c("g2")
    group_pairs = _promising(found.select(
        F.least("g", "g2").alias("g"), F.greatest("g", "g2").alias("g2"),
        F.when(side, c("p")).otherwise(c("p2")).alias("p"), F.when(side, c("p2")).otherwise(c("p")).alias("p2"),
        F.when(side, c("n")).otherwise(c("n2")).alias("n"), F.when(side, c("n2")).otherwise(c("n")).alias("n2")),
        "g", "g2", num, den)
    member = named.select("g", c("rep").alias("x"), c("label").alias("lx"))
    other = named.select(c("g").alias("g2"), c("rep").alias("y"), c("label").alias("ly"))
    split = of_group.filter("lmin <> lmax").select("g", c("g").alias("g2"))
    second = materialize(
        group_pairs.union(split).join(member, "g").join(other, "g2").filter("lx <> ly and x <> y")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    if not second.isEmpty():
        more = _verified(src, second, sig, classes, n, num, den)
        name = named.select("rep", "label")
        bridge = (more.join(name.withColumnsRenamed({"rep": "a", "label": "la"}), "a")
                  .join(name.withColumnsRenamed({"rep": "b", "label": "lb"}), "b")
                  .select(c("la").alias("a"), c("lb").alias("b")))
        top = connected_components(bridge)
        named = (named.join(top.withColumnRenamed("node", "label"), "label", "left")
                 .select("rep", "g", F.coalesce("component", "label").alias("label")))
    final = classes.join(named.select("rep", "g", "label"), ["rep", "g"]).select("f1", "f2", "n", "label")
    return (sig.select("doc_id", "n", "f1", "f2").join(final, ["f1", "f2", "n"], "left")
            .select("doc_id", c("n").cast("long").alias("n_shingles"),
                    F.when(c("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that stand for their component (the row with the
    smallest id; rows without an id stay)."""
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("doc_id_")).distinct()
    return (docs.filter("doc_id is null")
            .unionByName(docs.join(keep, docs["doc_id"] == keep["doc_id_"], "left_semi")))
