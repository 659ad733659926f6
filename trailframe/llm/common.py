"""Helpers shared by the operators of this subpackage.

* scratch tables live under the folder named by ``spark.checkpoint.dir``
  (read from the session), never in a machine-local folder of a cluster;
* ``bloom_words`` builds a filter of a fixed number of bits, so what is
  broadcast never grows with the input; it only ever prunes, an exact join
  or comparison follows;
* ``connected_components`` runs on edge tables, nothing is collected.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.session import cut_lineage, ensure_checkpoint_dir, ship_package


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, code for the Python workers, and Arrow batches of
    2,000 rows where the session has Spark's default of 10,000 (a batch of
    whole texts is held in memory on both sides)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back
    (lineage cut that survives lost executors and keeps column pruning)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trailframe-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`materialize`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/trailframe-llm/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(id_col: str | Column, m: int) -> Column:
    """``crc32(id as text) mod m`` (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def hash_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows spread evenly over the ids (all rows, if there are
    fewer): the share kept is ``rows / count``, decided by a 64-bit hash of
    the id.  Used only to fit models and to warm caches."""
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * (1 << 62))
    return df.filter(F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << 62)) < F.lit(cut))


def bloom_words(keys: DataFrame, col: str, log2_bits: int) -> np.ndarray:
    """Bits of a two-probe Bloom filter over a long column: ``2**log2_bits``
    bits as little-endian 64-bit words.  The filter has that size whatever
    the number of keys (more keys: more false hits, never a miss)."""
    mask = (1 << log2_bits) - 1
    c = F.col(col)
    probes = F.array(c.bitwiseAND(F.lit(mask)),
                     F.shiftrightunsigned(c, 64 - log2_bits).bitwiseAND(F.lit(mask)))
    rows = (keys.select(F.explode(probes).alias("p"))
            .select(F.shiftright("p", 6).alias("w"),
                    F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")))
    got = rows.toArrow()
    out = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    if got.num_rows:
        out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def bloom_hits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Boolean mask of the ``uint64`` keys that the filter may hold."""
    log2_bits = int(words.size).bit_length() - 1 + 6
    mask = np.uint64((1 << log2_bits) - 1)
    six, sixty_three, one = np.uint64(6), np.uint64(63), np.uint64(1)
    p = keys & mask
    hit = (words[(p >> six).astype(np.int64)] >> (p & sixty_three)) & one
    found = np.flatnonzero(hit)
    q = keys[found] >> np.uint64(64 - log2_bits)
    second = (words[(q >> six).astype(np.int64)] >> (q & sixty_three)) & one
    out = np.zeros(keys.size, dtype=bool)
    out[found[second.astype(bool)]] = True
    return out


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is
    the smallest node reachable.

    Alternating large-star / small-star rounds over the edge table: every
    round is two grouped minima and two joins on the node, so no adjacency
    list is ever held in one place.  A round that changes nothing ends it
    (checked by count and hash sum); ``max_rounds`` raises, it never cuts.
    """
    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large_star(e):
        n = both(e)
        m = n.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return (n.join(m, "a").filter("b > a")
                .select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                .filter("a <> b").distinct())

    def small_star(e):  # a > b in every row
        m = e.groupBy("a").agg(F.min("b").alias("m"))
        j = e.join(m, "a")
        return (j.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("r"))
                .select("r.a", "r.b").filter("a <> b").distinct())

    def state(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct())
    before = state(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = cut_lineage(small_star(large_star(e)))
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
