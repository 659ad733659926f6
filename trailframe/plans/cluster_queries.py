"""Registered clustering queries (J3, M5-M10, A4-A7, A10, L1, L2) and SQL.

Points are the ``points`` fixture (all embeddings).  Initial centres are
the first 8 points by ``md5("7:<id>")``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe import fixtures as fx
from trailframe.operators import clustering as C

K = 8
SEED = 7
PICK_SEED = 11
PASSES = 5
BREAK = 2.0
FRAME_K, FRAME_PASSES, FRAME_TOL = 20, 26, 1e-6
#: the query runs until FRAME_TOL is met and raises at this many passes; only its SQL unrolls FRAME_PASSES
#: (22 settle every frame of the largest shared table)
FRAME_BOUND = 1000


def _centers_df(spark: SparkSession, centers) -> DataFrame:
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("x", T.DoubleType()),
                           T.StructField("y", T.DoubleType())])
    df = spark.createDataFrame([(int(c), float(x), float(y)) for c, x, y in centers], schema)
    return df.select("cid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _init(spark, sf):
    pts = fx.points(spark, sf)
    return pts, C.initial_centers(pts, K, SEED)


def _passes(pts, init, n):
    """Exactly ``n`` Lloyd passes (no early stop), empty clusters keep their centre."""
    cs = list(init)
    hist = [cs]
    p = pts.select("x", "y").persist()
    try:
        for _ in range(n):
            cs = C.lloyd_step(p, cs, on_empty="keep")
            hist.append(cs)
    finally:
        p.unpersist()
    return hist


def q_random_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.random_rows(fx.points(spark, sf), K, SEED).select("id", "x", "y")


def q_assign_nearest(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = _init(spark, sf)
    return C.assign_nearest(pts, init).select("id", F.col("cid").cast("long").alias("cid"),
                                              F.round("d2", 6).alias("d2"))


def q_lloyd_centers(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = _init(spark, sf)
    return _centers_df(spark, _passes(pts, init, PASSES)[-1])


def q_cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = _init(spark, sf)
    c4 = _passes(pts, init, PASSES - 1)[-1]
    a = C.assign_nearest(pts, c4).withColumn("cid", F.col("cid").cast("long"))
    return C.cluster_sizes(a)


def q_cluster_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = _init(spark, sf)
    c4 = _passes(pts, init, PASSES - 1)[-1]
    im = C.imbalance(C.assign_nearest(pts, c4))
    return im.select("k", F.round("mean_size", 6).alias("mean_size"),
                     F.round("imbalance", 6).alias("imbalance"), "n_points")


def q_clustering_cost(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = _init(spark, sf)
    c5 = _passes(pts, init, PASSES)[-1]
    cost = C.clustering_cost(pts, c5)
    return cost.select(F.round("cost", 4).alias("cost"), F.round("cost_distance", 6).alias("cost_distance"), "n")


def q_random_member(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = _init(spark, sf)
    c4 = _passes(pts, init, PASSES - 1)[-1]
    a = C.assign_nearest(pts, c4).withColumn("cid", F.col("cid").cast("long"))
    return C.random_member(a, PICK_SEED)


def q_frame_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    det = fx.detections(spark, sf)
    cs = C.frame_kmeans(det, k=FRAME_K, passes=FRAME_BOUND, seed=SEED, key="slot", tol=FRAME_TOL, with_flag=True,
                        settle=True)
    return cs.select("frame", "cid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "converged")


MANY = 2000


def _many(spark: SparkSession, sf: str):
    li = fx.table(spark, sf, "lineitem")
    x, y = F.col("l_partkey") % 720, F.col("l_suppkey") % 480
    pts = li.select((x * 480 + y).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    return pts, C.initial_centers(pts.distinct(), MANY, SEED)


def q_assign_nearest_2000(spark: SparkSession, sf: str) -> DataFrame:
    """J3 at the reference's number of centres, over every line item."""
    pts, cs = _many(spark, sf)
    return C.assign_nearest(pts, cs).select("id", F.col("cid").cast("long").alias("cid"), "d2")


MANY_PASSES = 4


def q_lloyd_2000(spark: SparkSession, sf: str) -> DataFrame:
    """M6 at the reference's number of centres: four passes with bounds."""
    pts, cs = _many(spark, sf)
    return _centers_df(spark, C.lloyd(pts, cs, max_iter=MANY_PASSES, tol=-1.0).centers)


def q_similar_size_round(spark: SparkSession, sf: str) -> DataFrame:
    pts, init = _init(spark, sf)
    p = pts.persist()
    try:
        out = C.similar_size_round(p, init, passes=3, tolerance=0.5, seed=PICK_SEED)
    finally:
        p.unpersist()
    return _centers_df(spark, out)


def q_similar_size_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    pts = fx.points(spark, sf)
    res = C.similar_size_kmeans(pts, k=K, breakpoint=BREAK, tolerance=1.0, seed=SEED, max_rounds=2, max_iter=PASSES)
    rows = [(int(c), float(x), float(y), int(res.sizes.get(c, 0)), bool(res.converged), float(res.imbalance))
            for c, x, y in res.centers]
    df = spark.createDataFrame(rows, "cid long, x double, y double, n long, converged boolean, imbalance double")
    return df.select("cid", "n", "converged", *[F.round(c, 6).alias(c) for c in ("x", "y", "imbalance")])


def q_kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    """M5 and M9 as checks that hold for any good k-means result: every point
    goes to a nearest centre, and k clusters cost less than one."""
    pts = fx.points(spark, sf)
    model = C.kmeans(pts, k=K, seed=1)
    one = pts.agg((F.var_pop("x") + F.var_pop("y")) * F.count(F.lit(1))).first()[0]
    cheaper = bool(model.summary.trainingCost < one)
    return C.cluster_assign(model, pts).select("id", C.is_nearest(model, ("x", "y")).alias("nearest"),
                                               F.lit(cheaper).alias("cheaper"))


QUERIES = {
    "random_rows": q_random_rows,
    "assign_nearest": q_assign_nearest,
    "lloyd_centers": q_lloyd_centers,
    "cluster_sizes": q_cluster_sizes,
    "cluster_imbalance": q_cluster_imbalance,
    "clustering_cost": q_clustering_cost,
    "random_member": q_random_member,
    "frame_kmeans": q_frame_kmeans,
    "similar_size_round": q_similar_size_round,
    "similar_size_kmeans": q_similar_size_kmeans,
    "kmeans_assign": q_kmeans_assign,
    "assign_nearest_2000": q_assign_nearest_2000,
    "lloyd_2000": q_lloyd_2000,
}


# ------------------------------------------------------------------------ SQL

PTS = """pts as (select vec_id id, 360 + 720 * embedding[1]::double x, 240 + 480 * embedding[2]::double y
        from embeddings)"""

C0 = f"""c0 as (select * from (
  select (row_number() over (order by md5('{SEED}:' || id::varchar), id) - 1)::bigint c, x, y from pts)
  where c < {K})"""


def _lloyd_ctes(n: int, by: str = "", a: str = "a", c: str = "c") -> str:
    """CTEs a0..a{n-1}, c1..c{n}; empty clusters keep their centre."""
    parts = []
    g = f"{by}, " if by else ""
    using = f"using ({by})" if by else "on true"
    for i in range(n):
        d2 = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)"
        parts.append(f"""{a}{i} as materialized (select {'p.' + by + ', ' if by else ''}p.id, p.x, p.y, arg_min(c.c, ({d2}, c.c)) c
  from pts p join {c}{i} c {using} group by all)""")
        parts.append(f"""{c}{i + 1} as materialized (select {'c.' + by + ', ' if by else ''}c.c, coalesce(m.x, c.x) x, coalesce(m.y, c.y) y
  from {c}{i} c left join (select {g}c, avg(x) x, avg(y) y from {a}{i} group by all) m using ({g}c))""")
    return ",\n".join(parts)


def _moved_ctes(n: int, seed: int) -> str:
    """Sizes of the assignment to c{n}, then d0: c{n} with the centres of
    small clusters moved onto members of oversized ones."""
    return f"""f1 as materialized (select p.id, p.x, p.y,
  arg_min(c.c, ((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.c)) c from pts p, c{n} c group by all),
z1 as (select c, count(*) n from f1 group by 1),
s1 as materialized (select mu, (select sum((mu - n) * (mu - n)) from z1) / t s from (select avg(n) mu, sum(n) t from z1)),
donor as (select c, row_number() over (order by n desc, c) r from z1, s1 where n > mu + s * 1.0 and s >= {BREAK}),
victim as (select c, row_number() over (order by coalesce(n, 0), c) r from c{n} left join z1 using (c)
  where c not in (select c from donor)),
pick as (select c, arg_min({{'x': x, 'y': y}}, (md5('{seed}:' || id::varchar), id)) p from f1 group by 1),
d0 as materialized (select k.c, coalesce(pick.p.x, k.x) x, coalesce(pick.p.y, k.y) y
  from c{n} k left join victim v on v.c = k.c left join donor d on d.r = v.r left join pick on pick.c = d.c)"""


SIZES = "z as (select c, count(*) n from a4 group by 1)"
STATS = "m as (select avg(n) mu, sum(n) t, count(*) k from z)"

FRAME_PTS = """pts as (
  select (dense_rank() over (order by h) - 1)::bigint as frame,
         (row_number() over (partition by h order by event_id) - 1)::bigint as id, x, y
  from (select date_trunc('hour', ts) h, event_id, cast(user_id as double) x, value y from events))"""

FRAME_C0 = f"""c0 as (select * from (
  select frame, (row_number() over (partition by frame order by md5('{SEED}:' || id::varchar), id) - 1)::int c, x, y
  from pts) where c < {FRAME_K})"""

def _many_ctes(n: int) -> str:
    """c0 .. c{n} of the many centres, over distinct points with weights."""
    d2 = "(q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y)"
    parts = [f"""q as materialized (select l_partkey % 720 * 480 + l_suppkey % 480 id, (l_partkey % 720)::double x,
  (l_suppkey % 480)::double y, count(*) w from lineitem group by all),
c0 as materialized (select (row_number() over (order by md5('{SEED}:' || id::varchar), id) - 1)::bigint c, x, y from q
  qualify c < {MANY})"""]
    for i in range(n):
        parts.append(f"""a{i} as materialized (select q.x, q.y, q.w, arg_min(c.c, ({d2}, c.c)) c from q, c{i} c group by q.id, 1, 2, 3),
c{i + 1} as materialized (select c.c, coalesce(m.x, c.x) x, coalesce(m.y, c.y) y from c{i} c
  left join (select c, sum(x * w) / sum(w) x, sum(y * w) / sum(w) y from a{i} group by 1) m using (c))""")
    return ",\n".join(parts)


SQL = {
    "lloyd_2000": f"with {_many_ctes(MANY_PASSES)} select c cid, round(x, 6) x, round(y, 6) y from c{MANY_PASSES}",
    "random_rows": f"""with {PTS} select id, x, y from pts order by md5('{SEED}:' || id::varchar), id limit {K}""",
    "assign_nearest": f"""with {PTS}, {C0}
select p.id, arg_min(c.c, ((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.c)) cid,
       round(min((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), 6) d2
from pts p, c0 c group by p.id""",
    "lloyd_centers": f"""with {PTS}, {C0}, {_lloyd_ctes(PASSES)}
select c cid, round(x, 6) x, round(y, 6) y from c{PASSES}""",
    "cluster_sizes": f"""with {PTS}, {C0}, {_lloyd_ctes(PASSES)}, {SIZES} select c cid, n from z""",
    "cluster_imbalance": f"""with {PTS}, {C0}, {_lloyd_ctes(PASSES)}, {SIZES}, {STATS}
select k, round(max(mu), 6) mean_size, round(sum((mu - n) * (mu - n)) / max(t), 6) imbalance, max(t)::bigint n_points
from z, m group by k""",
    "clustering_cost": f"""with {PTS}, {C0}, {_lloyd_ctes(PASSES)},
d as (select p.id, min((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) d2 from pts p, c{PASSES} c group by 1)
select round(sum(d2), 4) cost, round(sqrt(sum(d2) / count(*)), 6) cost_distance, count(*) n from d""",
    "random_member": f"""with {PTS}, {C0}, {_lloyd_ctes(PASSES)},
r as (select c, arg_min({{'id': id, 'x': x, 'y': y}}, (md5('{PICK_SEED}:' || id::varchar), id)) p from a4 group by 1)
select c cid, p.id id, p.x x, p.y y from r""",
    "frame_kmeans": f"""with {FRAME_PTS}, {FRAME_C0}, {_lloyd_ctes(FRAME_PASSES, by='frame')}
select n.frame, n.c cid, round(n.x, 6) x, round(n.y, 6) y,
  max(greatest(abs(n.x - o.x), abs(n.y - o.y))) over (partition by n.frame) <= {FRAME_TOL} converged
from c{FRAME_PASSES} n join c{FRAME_PASSES - 1} o using (frame, c)""",
    "assign_nearest_2000": f"""with p as (select l_partkey % 720 * 480 + l_suppkey % 480 id,
  (l_partkey % 720)::double x, (l_suppkey % 480)::double y from lineitem),
q as (select distinct id, x, y from p),
u as (select (row_number() over (order by md5('{SEED}:' || id::varchar), id) - 1)::bigint c, x, y from q
  qualify row_number() over (order by md5('{SEED}:' || id::varchar), id) <= 2000),
n as (select q.id, arg_min(u.c, ((q.x - u.x) * (q.x - u.x) + (q.y - u.y) * (q.y - u.y), u.c)) cid,
  min((q.x - u.x) * (q.x - u.x) + (q.y - u.y) * (q.y - u.y)) d2 from q, u group by all)
select id, cid, d2 from p join n using (id)""",
    "similar_size_kmeans": f"""with {PTS}, {C0}, {_lloyd_ctes(PASSES)}, {_moved_ctes(PASSES, SEED + 1)},
{_lloyd_ctes(PASSES, a='b', c='d')},
f2 as materialized (select p.id, arg_min(c.c, ((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.c)) c
  from pts p, d{PASSES} c group by all),
z2 as (select c, count(*) n from f2 group by 1),
s2 as (select (select sum((mu - n) * (mu - n)) from z2) / t s from (select avg(n) mu, sum(n) t from z2)),
stay as (select count(*) = 0 stays from donor)
select c cid, coalesce(n, 0) n, s < {BREAK} converged, round(x, 6) x, round(y, 6) y, round(s, 6) imbalance
from c{PASSES} left join z1 using (c), s1, stay where stays
union all
select c, coalesce(n, 0), s < {BREAK}, round(x, 6), round(y, 6), round(s, 6)
from d{PASSES} left join z2 using (c), s2, stay where not stays""",
    "kmeans_assign": f"""with {PTS} select id, true nearest, true cheaper from pts""",
    "similar_size_round": f"""with {PTS}, {C0}, {_lloyd_ctes(3)},
z as (select c.c, coalesce(s.n, 0) n from c2 c left join (select c, count(*) n from a2 group by 1) s using (c)),
zs as (select * from z where n > 0),
m as (select avg(n) mu, sum(n) t from zs),
im as (select mu, (select sum((mu - n) * (mu - n)) from zs) / t s from m),
donor as (select c, row_number() over (order by n desc, c) r from zs, im where n > mu + s * 0.5),
victim as (select c, row_number() over (order by n, c) r from z where c not in (select c from donor)),
pick as (select c, arg_min({{'x': x, 'y': y}}, (md5('{PICK_SEED}:' || id::varchar), id)) p from a2 group by 1)
select k.c cid, round(coalesce(pick.p.x, k.x), 6) x, round(coalesce(pick.p.y, k.y), 6) y
from c3 k left join victim v on v.c = k.c left join donor d on d.r = v.r left join pick on pick.c = d.c""",
}
