"""Registered queries at the reference's full size: every kind of model and
the net on both coordinates, a memory of four steps, balanced next to plain
clusters, 20 clusters a frame until settled.  Those that SQL cannot follow
have none; ``tests/test_full_queries.py`` recomputes them on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe import fixtures as fx
from trailframe.functions.scalar import rounded
from trailframe.operators import clustering as C
from trailframe.operators import forecast as FC
from trailframe.operators import matching
from trailframe.operators import regression as RG
from trailframe.plans import cluster_queries as CQ
from trailframe.plans import jobs
from trailframe.plans import model_queries as MQ
from trailframe.sources import text as TX

KINDS = ("linear", "tree", "forest", "gbt", "isotonic", "net")
#: bounds that raise, they never cut
SETTLE = 1000
BALANCED_K, BALANCED_ROUNDS = 20, 10
STEPS = 50


def _r(name: str, digits: int = 4):
    return F.round(F.col(name), digits).alias(name)


def q_model_report_full(spark: SparkSession, sf: str) -> DataFrame:
    """M19 on (x, y): five kinds of models and the 200-epoch net."""
    rep = RG.model_report(MQ.transitions(spark, sf), kinds=KINDS, key=MQ.split_key(), seed=MQ.SPLIT_SEED)
    return rep.select("model", _r("rmse_x"), _r("rmse_y"))


def q_model_report_files_full(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 on (x, y) from the two transition files, all kinds."""
    xp, yp = TX.scratch_path(spark, "tx"), TX.scratch_path(spark, "ty")
    TX.write_transitions(MQ.transitions(spark, sf), xp, yp)
    rep = jobs.model_report_from_files(spark, xp, yp, seed=MQ.SPLIT_SEED, kinds=KINDS)
    return rep.select("model", _r("rmse_x"), _r("rmse_y"))


MEMORY = tuple(f"{a}{i}" for i in range(1, 5) for a in ("x", "y"))


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    return matching.memory_features(fx.tracks(spark, sf), k=4)


def q_memory_fit_linear_4(spark: SparkSession, sf: str) -> DataFrame:
    """Linear models on a memory of four steps (eight features)."""
    pair = RG.fit_pair("linear", _memory(spark, sf), MEMORY)
    rows = [(lab, float(m.intercept), *[float(c) for c in m.coefficients]) for lab, m in pair.models.items()]
    df = spark.createDataFrame(rows, "label string, intercept double, " + ", ".join(f"{c} double" for c in MEMORY))
    return df.select("label", *[_r(c) for c in ("intercept", *MEMORY)])


def q_memory_forecast_4(spark: SparkSession, sf: str) -> DataFrame:
    """M20 with a memory of four steps: every row of the features moves on."""
    mem = _memory(spark, sf)
    pair = RG.fit_pair("linear", mem, MEMORY)
    held = [F.col(f"{a}{i + 1}").alias(f"m_{a}{i}") for i in range(1, 4) for a in ("x", "y")]
    agents = mem.select("track", F.col("step").alias("origin"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"),
                        F.col("next_x").alias("vx"), F.col("next_y").alias("vy"), *held,
                        F.col("next_x").alias("m_x4"), F.col("next_y").alias("m_y4"))
    f = FC.forecast(agents, pair, n_steps=3, dt=1.0, speed=1.0, key=("track", "origin"), block=2)
    return f.select("track", "origin", "step", *[_r(c) for c in ("cx", "cy", "vx", "vy")])


def _forecast(spark: SparkSession, sf: str, kind: str, **kw) -> DataFrame:
    m = MQ.matched(spark, sf)
    pair = RG.fit_pair(kind, MQ.transitions(spark, sf, m), ("x", "y"), **kw)
    f = FC.forecast(MQ.moving_agents(spark, sf, m), pair, n_steps=STEPS, dt=1.0, speed=1.0, key=("frame", "slot"), block=STEPS,
                    write=False)
    return f.select("frame", "slot", "step", *[rounded(c).alias(c) for c in ("cx", "cy", "vx", "vy")])


def q_forecast_forest(spark: SparkSession, sf: str) -> DataFrame:
    """M20 with forests: every matched detection moves on for 50 steps."""
    return _forecast(spark, sf, "forest")


def q_forecast_net(spark: SparkSession, sf: str) -> DataFrame:
    """M20 with the net of the model report."""
    return _forecast(spark, sf, "net")


def q_balanced_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: the sizes and centres of similar-size k-means, run until balanced,
    until nothing is oversized or for ten rounds, next to plain k-means."""
    pts = fx.points(spark, sf)
    out = jobs.balanced_clusters(pts, k=BALANCED_K, breakpoint=CQ.BREAK, seed=CQ.SEED, max_rounds=BALANCED_ROUNDS)
    plain = [(i, x, y) for i, (x, y) in enumerate(out["kmeans_centers"])]
    kinds = (("balanced", out["balanced"].centers), ("plain", plain))
    found = None
    for kind, centers in kinds:
        sizes = C.assign_nearest(pts, centers).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
        rows = spark.createDataFrame([(kind, int(c), float(x), float(y)) for c, x, y in centers],
                                     "kind string, cid int, x double, y double")
        rows = rows.join(sizes, "cid", "left").select("kind", "cid", F.coalesce("n", F.lit(0)).alias("n"), _r("x", 6), _r("y", 6))
        found = rows if found is None else found.unionByName(rows)
    return found


def wide_images(spark: SparkSession, sf: str, frames: int = 64) -> DataFrame:
    """Decoded images from the line items: every supplier number modulo
    ``frames`` is a frame of one row of pixels."""
    li = fx.table(spark, sf, "lineitem")
    rgb = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 16777216
    hex6 = F.lpad(F.hex(rgb), 6, "0")
    bgr = F.concat(F.substring(hex6, 5, 2), F.substring(hex6, 3, 2), F.substring(hex6, 1, 2))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bgr.alias("b"))
    return (li.groupBy((F.col("l_suppkey") % frames).cast("long").alias("frame"))
            .agg(F.array_sort(F.collect_list(order)).alias("p"))
            .select("frame", F.lit(1).alias("height"), F.size("p").alias("width"), F.lit(3).alias("nChannels"),
                    F.unhex(F.array_join(F.transform("p", lambda e: e["b"]), "")).alias("data")))


def q_extract_detections_full(spark: SparkSession, sf: str) -> DataFrame:
    """Q1: dark pixels, then 20 clusters a frame until none of them moves."""
    det = jobs.detect(wide_images(spark, sf), k=20, passes=SETTLE, threshold=100.0, seed=7, tol=CQ.FRAME_TOL)
    return det.select("frame", "slot", _r("x", 6), _r("y", 6))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = CQ._init(spark, sf)
    centers = CQ._passes(pts, init, CQ.PASSES - 1)[-1]
    return C.assign_nearest(pts, centers).withColumn("cid", F.col("cid").cast("long"))


def q_cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    """The points of one cluster."""
    return C.cluster_members(_assigned(spark, sf), 3).select("id", "x", "y")


def q_uneven_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters far above and below the mean size."""
    sizes = C.cluster_sizes(_assigned(spark, sf))
    over, under = (f(sizes, 0.25).select("cid", "n", F.lit(name).alias("kind"))
                   for f, name in ((C.oversized, "oversized"), (C.undersized, "undersized")))
    return over.unionByName(under)


def q_lloyd_converged(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each of five passes kept every centre within 5 of one of
    the pass before."""
    pts, init = CQ._init(spark, sf)
    hist = CQ._passes(pts, init, CQ.PASSES)
    rows = [(i, C.same_centers(new, old, 5.0)) for i, (old, new) in enumerate(zip(hist, hist[1:]), 1)]
    return spark.createDataFrame(rows, "pass int, converged boolean")


def q_cluster_centers(spark: SparkSession, sf: str) -> DataFrame:
    """M10 as a check that holds for any settled k-means result: the centres
    are numbered from 0, and each is the mean of the points assigned to it."""
    pts = fx.points(spark, sf)
    model = C.kmeans(pts, k=CQ.K, seed=1, max_iter=500, tol=0.0)
    means = (C.cluster_assign(model, pts).groupBy(F.col("prediction").alias("cid"))
             .agg(F.avg("x").alias("x"), F.avg("y").alias("y")))
    far = F.greatest(F.abs(F.col("x") - F.col("c0")), F.abs(F.col("y") - F.col("c1")))
    return (C.cluster_centers(model, spark).join(means, "cid", "left")
            .select(F.col("cid").cast("int").alias("cid"), F.coalesce(far < 1e-6, F.lit(False)).alias("is_mean")))


QUERIES = {
    "model_report_full": q_model_report_full,
    "model_report_files_full": q_model_report_files_full,
    "memory_fit_linear_4": q_memory_fit_linear_4,
    "memory_forecast_4": q_memory_forecast_4,
    "forecast_forest": q_forecast_forest,
    "forecast_net": q_forecast_net,
    "balanced_clusters": q_balanced_clusters,
    "extract_detections_full": q_extract_detections_full,
    "cluster_members": q_cluster_members,
    "uneven_clusters": q_uneven_clusters,
    "lloyd_converged": q_lloyd_converged,
    "cluster_centers": q_cluster_centers,
}

_A4 = f"with {CQ.PTS}, {CQ.C0}, {CQ._lloyd_ctes(CQ.PASSES)}"
_MOVES = " union all ".join(
    f"""select {i}::int pass, bool_and(near) converged from (select n.c, max(abs(n.x - o.x) <= 5 and abs(n.y - o.y) <= 5) near
  from c{i} n, c{i - 1} o group by 1)""" for i in range(1, CQ.PASSES + 1))

SQL = {
    "cluster_members": f"{_A4} select id, x, y from a4 where c = 3",
    "uneven_clusters": f"""{_A4}, {CQ.SIZES}, m as (select avg(n) mu, sum(n) t from z),
s as (select mu, (select sum((mu - n) * (mu - n)) from z) / t * 0.25 w from m)
select c cid, n, case when n > mu then 'oversized' else 'undersized' end kind from z, s where n > mu + w or n < mu - w""",
    "lloyd_converged": f"{_A4} {_MOVES}",
    "cluster_centers": f"select r::int cid, true is_mean from range({CQ.K}) t(r)",
}
