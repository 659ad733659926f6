"""Operator 13: spelling variants by a frequency-vector trie.

A word's vector holds its number of letters in each of ``len(GROUPS)`` letter
groups.  One inserted, deleted or replaced letter changes the vector by at
most one surplus and one deficit, so near words lie close together in a trie
over the word's length and its successive group counts.

* The top of the trie is dealt out by Spark: a bucket is a length and the
  counts of the first ``k`` groups.  A word lives in its own bucket and
  visits the buckets that its budget reaches; of two buckets only one is
  visited, and what is found there counts for both words.
* Below that, every bucket is a trie in a task.  A depth-first search carries
  the set of words that can still reach a node, with what they have spent of
  one surplus and one deficit, and verifies words letter by letter where
  few pairs are left.
* ``k`` is the depth with the least estimated work over the counted buckets.
  A bucket of more than ``BLOCK`` words, or with more than ``BLOCK`` visitors,
  is cut into blocks, and every two blocks meet in a task of their own, so no
  task holds more than that, whatever share of the words one bucket has.
* Pairs never leave a task: for each word and task its number of near words
  and the best of them is sent on.
* Forms are followed by pointer doubling; every form has at least twice the
  occurrences, so that is a few rounds.

Letters are U+0041-5A, 61-7A and C0-FF, one Latin-1 byte each, so words are
cut, counted and compared as bytes.

Cases: null and empty texts have no words; a run of a row with a null
``doc_id`` is taken as it is (no checksum, no deletion); repeated rows count
again; ties of forms go to the smallest word; a word without near words has
``n_near`` 0, no form, and is its own root; very long texts are cut in parts,
very long words are only compared in their own length; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import materialize
from trailframe.session import cut_lineage

#: letter groups, most telling first; fixed values.  Letters that are named
#: in none go to a group by their code
GROUPS = ("eé", "nñ", "tdß", "aàáâä", "rl", "ioíóö", "shcç", "umpuüú", "gfbv")
#: most words, and most visitors, of a task
BLOCK = 1 << 14
#: pairs of a node below which words are compared at once
FEW_PAIRS = 4096
#: words a task counts before it sends its counts on
MAX_COUNTED = 200_000
SLICE = 1 << 20

_LETTERS = bytearray(b" " * 256)
_LETTERS[0x61:0x7B] = bytes(range(0x61, 0x7B))
_LETTERS[0x41:0x5B] = bytes(range(0x61, 0x7B))
_LETTERS[0xC0:] = bytes(range(0xC0, 0x100))
_LETTERS = bytes(_LETTERS)
_GROUP_OF = np.arange(256) % len(GROUPS)
for _g, _letters in enumerate(GROUPS):
    _GROUP_OF[[ord(c) for c in _letters]] = _g


def cut_slices(b: bytes, size: int = SLICE):
    """Parts of about ``size`` bytes, cut at blanks."""
    a = 0
    while len(b) - a > size:
        z = b.find(b" ", a + size)
        if z < 0:
            break
        yield b[a:z]
        a = z
    yield b[a:] if a else b


def runs_of(text: str) -> Counter:
    """Letter runs of a text, A-Z lower-cased, as Latin-1 bytes (every other
    character, also one outside Latin-1, ends a run)."""
    found: Counter = Counter()
    for part in cut_slices(text.encode("latin-1", "replace").translate(_LETTERS)):
        found.update(part.split())
    return found


def misspell(doc_id: int | None, found: Counter, every: int) -> Counter:
    """Runs whose checksum with the document's id is divisible by ``every``
    lose one letter."""
    if doc_id is None:
        return found
    seed = zlib.crc32(b"%d:" % doc_id)
    lost = []
    for run in found:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % every == 0:
            lost.append((run, h % len(run)))
    moved = [(run[:at] + run[at + 1:], found.pop(run)) for run, at in lost]
    for run, n in moved:
        found[run] += n
    return found


def count_words(docs: DataFrame, every: int = 97, min_len: int = 5, min_n: int = 3) -> DataFrame:
    """``word`` (Latin-1 bytes), ``n``, ``len`` and ``c`` (group counts) of
    ``docs(doc_id, text)``.  Tasks add up their own counts first."""
    def batch(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                           pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(it):
        total: Counter = Counter()
        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    for w, n in misspell(doc_id, runs_of(text), every).items():
                        if len(w) >= min_len:
                            total[w] += n
                    if len(total) >= MAX_COUNTED:
                        yield batch(total)
                        total.clear()
        yield batch(total)

    def vectors(it):
        for b in it:
            words = b.column(0).to_pylist()
            c = group_counts(words)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * len(GROUPS), pa.int32()),
                                            pa.array(c.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int32()), flat],
                names=["word", "n", "len", "c"])

    counted = (docs.select("doc_id", "text").mapInArrow(run, "word binary, n long")
               .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_n))
    return counted.mapInArrow(vectors, "word binary, n long, len int, c array<int>")


def group_counts(words: list[bytes]) -> np.ndarray:
    """Letters per group, one row for each word."""
    g = len(GROUPS)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    letters = _GROUP_OF[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(len(words)), lens)
    return np.bincount(row * g + letters, minlength=len(words) * g).reshape(-1, g)


def visits(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of the key (length, k counts) from a word's bucket to those it
    visits: one letter fewer, or as many and a smaller key."""
    out = []
    for lost in [None, *range(k)]:
        step = np.zeros(k + 1, np.int64)
        step[0] = -1
        if lost is not None:
            step[lost + 1] = -1
        out.append(step)
    for up in [None, *range(k)]:
        for down in [None, *range(k)]:
            step = np.zeros(k + 1, np.int64)
            if up is not None:
                step[up + 1] += 1
            if down is not None:
                step[down + 1] -= 1
            first = step[np.flatnonzero(step)[:1]]
            if first.size and first[0] < 0:
                out.append(step)
    return np.unique(np.array(out), axis=0)


def choose_depth(words: DataFrame, block: int = BLOCK) -> int:
    """The depth with the least rows sent to tasks."""
    g = len(GROUPS)
    n = F.col("n")
    sizes = (words.select("len", F.posexplode(F.array([F.slice("c", 1, k) for k in range(1, g + 1)])).alias("k", "p"))
             .groupBy("k", "len", "p").agg(F.count(F.lit(1)).alias("n")))
    rows = sizes.groupBy("k").agg(F.sum(n).alias("words"), F.sum(n * F.ceil(n / F.lit(block))).alias("blocks"),
                                  F.sum(n * n).alias("pairs")).collect()
    cost = {r.k + 1: (1 + len(visits(r.k + 1))) * (r.blocks + r.pairs / 4096) for r in rows}
    return min(cost, key=lambda k: (cost[k], k), default=1)


def deal(words: DataFrame, k: int) -> DataFrame:
    """``key, home, word, n``: each word in its own bucket and in those it
    visits."""
    steps = visits(k)

    def run(it):
        for b in it:
            m = b.num_rows
            if not m:
                continue
            c = b.column(3).flatten().to_numpy().reshape(m, -1)[:, :k]
            own = np.concatenate((b.column(2).to_numpy()[:, None], c), axis=1).astype(np.int64)
            all_keys = (own[:, None, :] + np.concatenate((np.zeros((1, k + 1), np.int64), steps))[None]).reshape(-1, k + 1)
            row = np.repeat(np.arange(m), len(steps) + 1)
            home = np.tile(np.arange(len(steps) + 1) == 0, m)
            keep = np.flatnonzero((all_keys >= 0).all(axis=1) & (all_keys[:, 1:].sum(axis=1) <= all_keys[:, 0]))
            keys = [",".join(map(str, r)) for r in all_keys[keep].tolist()]
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(home[keep]), b.column(0).take(at), b.column(1).take(at)],
                names=["key", "home", "word", "n"])

    return words.select("word", "n", "len", "c").mapInArrow(run, "key string, home boolean, word binary, n long")


def blocks(dealt: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``i, q`` (blocks of inhabitants and of seekers), ``indexed`` and
    ``seeks``; buckets without inhabitants go."""
    size = dealt.groupBy("key").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("a")).filter("h > 0")
    cut = dealt.join(size.select("key", F.ceil(F.col("h") / block).cast("int").alias("ni"),
                                 F.ceil(F.col("a") / (4 * block)).cast("int").alias("nq")), "key")
    own_i = F.pmod(F.xxhash64("word"), F.col("ni")).cast("int")
    own_q = F.pmod(F.xxhash64(F.lit(1), "word"), F.col("nq")).cast("int")
    return (cut.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("ni") * F.col("nq") - 1)))
            .withColumns({"i": F.col("cell") % F.col("ni"), "q": F.floor(F.col("cell") / F.col("ni")).cast("int")})
            .withColumns({"indexed": F.col("home") & (F.col("i") == own_i), "seeks": F.col("q") == own_q})
            .filter("indexed or seeks").select("key", "i", "q", "home", "indexed", "seeks", "word", "n"))


def search(index: list[bytes], seekers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(s, i)`` of all near pairs; words of ``index`` have one
    length, those of ``seekers`` that length or one more."""
    width = len(index[0])
    chars = np.frombuffer(b"".join(index), np.uint8).reshape(len(index), width)
    longer = np.fromiter((len(s) > width for s in seekers), bool, len(seekers))
    padded = np.frombuffer(b"".join(s if len(s) > width else s + b"\0" for s in seekers), np.uint8)
    padded = padded.reshape(len(seekers), width + 1)
    iv, sv = group_counts(index), group_counts(seekers)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def verify(i, s):
        step = max(1, (1 << 21) // (width * max(1, s.size)))
        for a in range(0, i.size, step):
            part = i[a:a + step]
            for long in (False, True):
                who = s[longer[s] == long]
                if not who.size:
                    continue
                x, y = padded[who][:, None, :], chars[part][None]
                same = x[..., :width] == y
                if long:  # the longer word without one letter is the other
                    ahead = np.logical_and.accumulate(same, axis=2).sum(axis=2)
                    back = (x[..., 1:] == y)[..., ::-1]
                    near = ahead + np.logical_and.accumulate(back, axis=2).sum(axis=2) >= width
                else:
                    near = same.sum(axis=2) == width - 1
                r, c = np.nonzero(near)
                if r.size:
                    out.append((who[r], part[c]))

    def descend(level, i, s, surplus, deficit):
        if i.size * s.size <= FEW_PAIRS or level == iv.shape[1]:
            verify(i, s)
            return
        counts, seek = iv[i, level], sv[s, level]
        order = np.argsort(counts, kind="stable")
        values, first = np.unique(counts[order], return_index=True)
        for v, child in zip(values.tolist(), np.split(i[order], first[1:])):
            more = seek - v
            ok = np.flatnonzero((more == 0) | ((more == 1) & ~surplus) | ((more == -1) & ~deficit))
            if ok.size:
                descend(level + 1, child, s[ok], surplus[ok] | (more[ok] == 1), deficit[ok] | (more[ok] == -1))

    # a longer word has no deficit to spend
    descend(0, np.arange(len(index)), np.arange(len(seekers)), np.zeros(len(seekers), bool), longer.copy())
    if not out:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _best(place: np.ndarray, other: np.ndarray, words: list[bytes], n: np.ndarray):
    """Per place: how many others, and the best of them (most occurrences,
    then smallest word)."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    order = np.lexsort((rank[other], place))
    who, first, count = np.unique(place[order], return_index=True, return_counts=True)
    return who, count, other[order][first]


NEAR = "word binary, near long, best struct<less:long, word:binary>"


def near_words(dealt: DataFrame) -> DataFrame:
    """``word, near, best``: parts of each word's near words, by task."""
    best_type = pa.struct([("less", pa.int64()), ("word", pa.binary())])

    def rows(words, who, count, best_words, best_n):
        best = pa.StructArray.from_arrays([pa.array(-best_n, pa.int64()), pa.array(best_words, pa.binary())],
                                          fields=list(best_type))
        return pa.table([pa.array([words[w] for w in who.tolist()], pa.binary()), pa.array(count, pa.int64()), best],
                        names=["word", "near", "best"])

    def task(t: pa.Table) -> pa.Table:
        at = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("indexed", "seeks", "home", "n")}
        words = t.column("word").to_pylist()
        i, s = np.flatnonzero(at["indexed"]), np.flatnonzero(at["seeks"])
        parts = []
        if i.size and s.size:
            index, seekers = [words[x] for x in i.tolist()], [words[x] for x in s.tolist()]
            n_i, n_s = at["n"][i], at["n"][s]
            a, b = search(index, seekers)
            if a.size:
                who, count, best = _best(a, b, index, n_i)
                parts.append(rows(seekers, who, count, [index[x] for x in best.tolist()], n_i[best]))
                guest = ~at["home"][s][a].astype(bool)  # a pair of two buckets is found here only
                if guest.any():
                    who, count, best = _best(b[guest], a[guest], seekers, n_s)
                    parts.append(rows(index, who, count, [seekers[x] for x in best.tolist()], n_s[best]))
        if parts:
            return pa.concat_tables(parts)
        return pa.table([pa.array([], pa.binary()), pa.array([], pa.int64()), pa.array([], best_type)],
                        names=["word", "near", "best"])

    return dealt.groupBy("key", "i", "q").applyInArrow(task, NEAR)


def follow_forms(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``word, root`` of ``forms(word, form)`` by pointer doubling."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    for _ in range(max_rounds):
        if roots.filter("open").isEmpty():
            return roots.drop("open")
        nxt = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut_lineage(roots.join(nxt, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
    raise RuntimeError("forms do not end")


def variants(docs: DataFrame, every: int = 97, min_len: int = 5, min_n: int = 3, factor: int = 2,
             id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    if min_len < 1:
        raise ValueError("min_len must be positive")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = materialize(count_words(src, every, min_len, min_n), "words")
    dealt = blocks(deal(words, choose_depth(words, block)), block)
    found = near_words(dealt).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best_n = -F.col("best.less")
    good = best_n >= factor * F.col("n")
    out = materialize(
        words.select("word", "n").join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(good, F.col("best.word")).alias("form"), F.when(good, best_n).alias("form_n")), "forms")
    roots = follow_forms(out.filter("form is not null"))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return (out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
            .select(text("word"), text("form"), text("root"), "n", "n_near", "form_n"))
