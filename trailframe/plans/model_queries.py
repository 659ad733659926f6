"""Registered regression / forecast queries (M2, M3, L5, A9, M11-M20) and SQL.

Transition rows come from the detections (delta mode, unmatched rows
dropped, gate 25); they are split by a hash of ``frame*1000003 + slot``.
Linear fits are checked against closed-form least squares in SQL
(``var_pop`` / ``covar_pop``); tree and boosted fits on a single
categorical feature against group means; isotonic fits against the
max-min formula of the pooled adjacent violators solution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe import fixtures as fx
from trailframe.operators import forecast as FC
from trailframe.operators import matching, mlp
from trailframe.operators import regression as RG
from trailframe.plans.sql_common import BEST, DET, MATCHED, NFRAMES

SPLIT_SEED = 42
GATE = 25.0
STEPS = 5


def _r4(c):
    return F.round(F.col(c), 4).alias(c)


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Every detection with its match in the next frame, written once per
    application."""
    return fx.written(spark, "matched", sf, lambda: matching.match_next_frame(fx.detections(spark, sf), on_miss="null"))


def transitions(spark: SparkSession, sf: str, matches: DataFrame | None = None) -> DataFrame:
    """Training rows for the model queries, written once per application:
    every fit reads them several times."""
    def build():
        det = fx.detections(spark, sf)
        return matching.build_transitions(det, hops=2, gate_limit=GATE, mode="delta", on_miss="null", matched=matches)

    return fx.written(spark, "transitions", sf, build)


def split_key():
    return F.col("frame") * F.lit(1000003) + F.col("slot")


def q_fit_linear(spark: SparkSession, sf: str) -> DataFrame:
    cf = RG.fit_linear_coefficients(fx.regression(spark, sf), ["l_quantity", "l_discount"], "l_extendedprice")
    return cf.select(*[_r4(c) for c in cf.columns])


def _per_value(spark, sf, kind, fixture, feature_cols, label, key, **kw):
    df = fixture(spark, sf)
    data = RG.assemble(df, feature_cols)
    model = RG.fit(kind, data, label, seed=SPLIT_SEED, **kw)
    pred = f"pred_{label}"
    return (model.transform(data).select(F.col(key).alias("x"), F.col(pred).alias("prediction"))
            .distinct().select("x", F.round("prediction", 4).alias("prediction")))


def q_fit_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _per_value(spark, sf, "tree", fx.categorical, ["x"], "label", "x")


def q_fit_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return _per_value(spark, sf, "gbt", fx.categorical, ["x"], "label", "x")


def q_fit_forest(spark: SparkSession, sf: str) -> DataFrame:
    # without resampling every tree of the forest is the same exact tree
    return _per_value(spark, sf, "forest", fx.categorical, ["x"], "label", "x",
                      bootstrap=False, featureSubsetStrategy="all", numTrees=5)


def q_fit_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    # the vector holds two features; as in the reference only feature 0 is used
    return _per_value(spark, sf, "isotonic", fx.regression, ["l_quantity", "l_discount"],
                      "l_extendedprice", "l_quantity")


def q_index_categories(spark: SparkSession, sf: str) -> DataFrame:
    data = RG.assemble(fx.categorical(spark, sf), ["x"])
    m = RG.index_categories(data, max_categories=4)
    from pyspark.ml.functions import vector_to_array

    return (m.transform(data).select("x", vector_to_array("indexed")[0].alias("idx")).distinct())


def q_train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    ev = fx.table(spark, sf, "events").select("event_id")
    return ev.select("event_id", RG.hash_split_flag(F.col("event_id"), SPLIT_SEED, 0.7).alias("is_train"))


def q_l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = RG.l2_normalize(fx.vectors(spark, sf), "embedding", "unit")
    return (v.select("id", F.posexplode("unit").alias("pos", "e"))
            .select("id", F.col("pos").cast("long").alias("pos"), (F.round("e", 6) + F.lit(0.0)).alias("e")))


def q_evaluate_linear(spark: SparkSession, sf: str) -> DataFrame:
    tr = transitions(spark, sf)
    train, test = RG.train_test_split(tr, 0.7, SPLIT_SEED, split_key())
    pair = RG.fit_pair("linear", train, ("x", "y"))
    res = RG.evaluate_pair(pair, test).first()
    return spark.createDataFrame([(round(res["rmse_x"], 4), round(res["rmse_y"], 4))], "rmse_x double, rmse_y double")


def q_model_report(spark: SparkSession, sf: str) -> DataFrame:
    """M19 on one categorical feature, the direction of the x displacement,
    where every kind of model has a closed form."""
    tr = transitions(spark, sf).withColumn("side", (F.signum("x") + F.lit(1.0)))
    rep = RG.model_report(tr, features=("side",), key=split_key(), seed=SPLIT_SEED,
                          options={"forest": {"bootstrap": False, "featureSubsetStrategy": "all", "numTrees": 5}})
    return rep.select("model", _r4("rmse_x"), _r4("rmse_y"))


def q_model_report_files(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 from the two transition files."""
    from trailframe.plans import jobs
    from trailframe.sources import text as TX

    xp, yp = TX.scratch_path(spark, "tx"), TX.scratch_path(spark, "ty")
    TX.write_transitions(transitions(spark, sf), xp, yp)
    rep = jobs.model_report_from_files(spark, xp, yp, seed=SPLIT_SEED, kinds=("linear",))
    return rep.select("model", _r4("rmse_x"), _r4("rmse_y"))


MEMORY = ("x1", "y1", "x2", "y2")


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    return matching.memory_features(fx.tracks(spark, sf), k=2)


def q_memory_fit_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Linear models on memory features (W3 into M11)."""
    pair = RG.fit_pair("linear", _memory(spark, sf), MEMORY)
    rows = [(lab, float(m.intercept), *[float(c) for c in m.coefficients]) for lab, m in pair.models.items()]
    df = spark.createDataFrame(rows, "label string, intercept double, x1 double, y1 double, x2 double, y2 double")
    return df.select("label", *[_r4(c) for c in ("intercept", *MEMORY)])


def q_memory_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """M20 with a memory of two steps: every row of the features moves on."""
    mem = _memory(spark, sf)
    pair = RG.fit_pair("linear", mem, MEMORY)
    agents = mem.select("track", "step", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"),
                        F.col("next_x").alias("vx"), F.col("next_y").alias("vy"),
                        F.col("x2").alias("m_x1"), F.col("y2").alias("m_y1"),
                        F.col("next_x").alias("m_x2"), F.col("next_y").alias("m_y2")).withColumnRenamed("step", "origin")
    f = FC.forecast(agents, pair, n_steps=3, dt=1.0, speed=1.0, key=("track", "origin"), block=2)
    return f.select("track", "origin", "step", *[_r4(c) for c in ("cx", "cy", "vx", "vy")])


def q_forecast_paths(spark: SparkSession, sf: str) -> DataFrame:
    pair = RG.fit_pair("linear", transitions(spark, sf), ("x", "y"))
    f = FC.forecast(moving_agents(spark, sf), pair, n_steps=STEPS, dt=1.0, speed=1.0, key=("frame", "slot"))
    return f.select("frame", "slot", "step", *[_r4(c) for c in ("cx", "cy", "vx", "vy")])


def moving_agents(spark: SparkSession, sf: str, matches: DataFrame | None = None) -> DataFrame:
    """Every matched detection as an agent that goes on moving."""
    m = (matches.where(F.col("nslot").isNotNull()) if matches is not None
         else matching.match_next_frame(fx.detections(spark, sf), on_miss="drop"))
    return m.select("frame", "slot", F.col("nx").alias("cx"), F.col("ny").alias("cy"),
                    (F.col("nx") - F.col("x")).alias("vx"), (F.col("ny") - F.col("y")).alias("vy"))


NET_EPOCHS, NET_RATE, NET_MOMENTUM = 3, 0.001, 0.9


def q_fit_mlp(spark: SparkSession, sf: str) -> DataFrame:
    """M16 on the transitions: one 2-2-1 net per label, test-row predictions
    after a few full-batch epochs."""
    from concurrent.futures import ThreadPoolExecutor

    tr = transitions(spark, sf)
    train, test = RG.train_test_split(tr, 0.7, SPLIT_SEED, split_key())
    with ThreadPoolExecutor(max_workers=2) as pool:
        nets = list(pool.map(lambda lab: mlp.fit_mlp(train, ("x", "y"), lab, layers=(2, 2, 1), epochs=NET_EPOCHS,
                                                     lr=NET_RATE, momentum=NET_MOMENTUM, dropout=0.0),
                             ("next_x", "next_y")))
    out = nets[0].transform(test, "pred_next_x")
    out = nets[1].transform(out, "pred_next_y")
    return out.select("frame", "slot", *[_r4(c) for c in ("pred_next_x", "pred_next_y")])


QUERIES = {
    "fit_mlp": q_fit_mlp,
    "fit_linear": q_fit_linear,
    "fit_tree": q_fit_tree,
    "fit_gbt": q_fit_gbt,
    "fit_forest": q_fit_forest,
    "fit_isotonic": q_fit_isotonic,
    "index_categories": q_index_categories,
    "train_test_split": q_train_test_split,
    "l2_normalize": q_l2_normalize,
    "evaluate_linear": q_evaluate_linear,
    "model_report": q_model_report,
    "forecast_paths": q_forecast_paths,
    "model_report_files": q_model_report_files,
    "memory_fit_linear": q_memory_fit_linear,
    "memory_forecast": q_memory_forecast,
}


# ------------------------------------------------------------------------ SQL

def _split(key: str, fraction: float = 0.7) -> str:
    return (f"('0x' || substr(md5('{SPLIT_SEED}:' || ({key})::varchar), 1, 15))::bigint "
            f"< {int(fraction * RG.SPLIT_RANGE)}")


TRANS = f"""{DET}, {BEST}, {MATCHED},
tr as (select a.frame, a.slot, a.bx - a.x x, a.by_ - a.y y, b.bx - b.x next_x, b.by_ - b.y next_y
  from mt a join mt b on b.frame = a.frame + 1 and b.slot = a.slot
  where a.frame < {NFRAMES} - 5 and a.nslot is not null and b.nslot is not null
    and abs(b.bx - a.bx) <= {GATE} and abs(b.by_ - a.by_) <= {GATE}),
sp as (select *, {_split('frame * 1000003 + slot')} is_train from tr)"""


def _coef(name: str, y: str, where: str = "") -> str:
    body = f"""select avg_y - b1 * avg_x1 - b2 * avg_x2 i, b1, b2 from (
  select (p * b - q * c) / (a * b - c * c) b1, (q * a - p * c) / (a * b - c * c) b2, avg_x1, avg_x2, avg_y
  from (select var_pop(x) a, var_pop(y) b, covar_pop(x, y) c, covar_pop(x, {y}) p, covar_pop(y, {y}) q,
               avg(x) avg_x1, avg(y) avg_x2, avg({y}) avg_y from sp{' where ' + where if where else ''}))"""
    return f"{name} as ({body})"


def _net_ctes(tag: str, label: str) -> str:
    """Full-batch Nesterov epochs of a 2-2-1 tanh net as CTEs ``{tag}0`` ..;
    a row holds the nine weights and their velocities."""
    (w1, b1), (w2, b2) = mlp.xavier((2, 2, 1), 12345)
    start = [w1[0, 0], w1[0, 1], w1[1, 0], w1[1, 1], b1[0], b1[1], w2[0, 0], w2[1, 0], b2[0]]
    w = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]
    parts = [f"{tag}0 as materialized (select " + ", ".join(
        f"{float(v)!r}::double {n}, 0::double v{n}" for n, v in zip(w, start)) + ")"]
    for k in range(NET_EPOCHS):
        parts.append(f"""{tag}h{k} as (select x, y, g, h, tanh(x * a + y * c + e) p, tanh(x * b + y * d + f) q, i, {label} t
  from sp, {tag}{k} where is_train)""")
        parts.append(f"""{tag}e{k} as (select *, (p * g + q * h + i) - t r from {tag}h{k})""")
        parts.append(f"""{tag}g{k} as materialized (select sum(x * r * g * (1 - p * p)) / count(*) a, sum(x * r * h * (1 - q * q)) / count(*) b,
  sum(y * r * g * (1 - p * p)) / count(*) c, sum(y * r * h * (1 - q * q)) / count(*) d,
  sum(r * g * (1 - p * p)) / count(*) e, sum(r * h * (1 - q * q)) / count(*) f,
  sum(p * r) / count(*) g, sum(q * r) / count(*) h, sum(r) / count(*) i from {tag}e{k})""")
        m, lr = NET_MOMENTUM, NET_RATE
        parts.append(f"{tag}{k + 1} as materialized (select " + ", ".join(
            f"o.{n} - {m} * o.v{n} + (1 + {m}) * ({m} * o.v{n} - {lr} * s.{n}) {n}, "
            f"({m} * o.v{n} - {lr} * s.{n}) v{n}" for n in w) + f" from {tag}{k} o, {tag}g{k} s)")
    return ",\n".join(parts)


def _net_out(tag: str) -> str:
    n = f"{tag}{NET_EPOCHS}"
    return (f"round(tanh(x * {n}.a + y * {n}.c + {n}.e) * {n}.g + tanh(x * {n}.b + y * {n}.d + {n}.f) * {n}.h "
            f"+ {n}.i, 4)")


def _least_squares(tag: str, src: str, y: str, xs=MEMORY) -> str:
    """Coefficients of ``y`` on ``xs`` (one row ``{tag}``): the centred
    features are made orthogonal one after the other, then solved back."""
    n = len(xs)
    parts = [f"{tag}c as (select " + ", ".join(f"{x} - avg({x}) over () u{i}" for i, x in enumerate(xs))
             + f", {y} - avg({y}) over () t from {src})"]
    prev = f"{tag}c"
    for j in range(1, n):
        cur = f"{tag}o{j}"
        proj = ", ".join(f"sum(u{j} * u{i}) / sum(u{i} * u{i}) r{j}_{i}" for i in range(j))
        parts.append(f"{cur}p as materialized (select {proj} from {prev})")
        resid = f"u{j}" + "".join(f" - r{j}_{i} * u{i}" for i in range(j))
        keep = [f"u{i}" for i in range(n) if i != j]
        parts.append(f"{cur} as materialized (select {', '.join(keep)}, {resid} u{j}, t from {prev}, {cur}p)")
        prev = cur
    # the residual of u_j is already orthogonal to the earlier ones, so the
    # projections taken one by one are those of the original feature
    parts.append(f"{tag}g as (select " + ", ".join(f"sum(t * u{i}) / sum(u{i} * u{i}) g{i}" for i in range(n))
                 + f" from {prev})")
    src_cols = ", ".join([f"{tag}g"] + [f"{tag}o{j}p" for j in range(1, n)])
    sel, prev = None, None
    for j in range(n - 1, -1, -1):
        expr = f"g{j}" + "".join(f" - r{k}_{j} * k{k}" for k in range(j + 1, n))
        if prev is None:
            parts.append(f"{tag}k{j} as (select *, {expr} k{j} from {src_cols})")
        else:
            parts.append(f"{tag}k{j} as (select *, {expr} k{j} from {prev})")
        prev = f"{tag}k{j}"
    means = ", ".join(f"avg({x}) m{i}" for i, x in enumerate(xs))
    parts.append(f"{tag} as materialized (select " + ", ".join(f"k{i}" for i in range(n)) + ", mt"
                 + "".join(f" - k{i} * m{i}" for i in range(n))
                 + f" k from {prev}, (select {means}, avg({y}) mt from {src}))")
    return ",\n".join(parts)


MEM = """mem as materialized (select * from (select user_id track, event_id origin,
    lag(value, 2) over w x1, lag(minute(ts)::double, 2) over w y1,
    lag(value, 1) over w x2, lag(minute(ts)::double, 1) over w y2, value next_x, minute(ts)::double next_y
  from events window w as (partition by user_id order by event_id))
  where x1 is not null and y1 is not null and x2 is not null and y2 is not null)"""

# group means, the straight line and the monotone fit of three groups
REPORT = """tr3 as (select *, sign(x) + 1.0 side from sp),
gm as (select side, count(*) w, avg(next_x) mx, avg(next_y) my, sum(next_x) sx, sum(next_y) sy
  from tr3 where is_train group by 1),
ln as (select regr_slope(next_x, side) bx, regr_intercept(next_x, side) ax,
  regr_slope(next_y, side) by_, regr_intercept(next_y, side) ay from tr3 where is_train),
iv as (select a.side lo, b.side hi, sum(c.sx) / sum(c.w) vx, sum(c.sy) / sum(c.w) vy
  from gm a join gm b on a.side <= b.side join gm c on c.side between a.side and b.side group by 1, 2),
ih as (select g.side, iv.lo, min(vx) vx, min(vy) vy from gm g join iv on lo <= g.side and hi >= g.side group by 1, 2),
iso as (select side, max(vx) ix, max(vy) iy from ih group by 1),
te as (select t.*, mx, my, ix, iy, ax + bx * side lx, ay + by_ * side ly
  from tr3 t join gm using (side) join iso using (side), ln where not is_train)"""


def _rmse(px: str, py: str) -> str:
    return (f"round(sqrt(avg(({px} - next_x) ** 2)), 4) rmse_x, round(sqrt(avg(({py} - next_y) ** 2)), 4) rmse_y")


def _file_split(label: str) -> str:
    cols = " || ',' || ".join(f"round({c} * 1000000)::bigint::varchar" for c in ("x", "y", label))
    return f"({_split(cols)})"


def _file_ctes(tag: str, label: str) -> str:
    return (f"{tag}r as (select x, y, {label}, {_file_split(label)} is_train from tr),\n"
            + _least_squares(tag, f"(select * from {tag}r where is_train)", label, ("x", "y")))


SQL = {
    "fit_linear": """select round(avg_y - b1 * avg_x1 - b2 * avg_x2, 4) intercept, round(b1, 4) coef_l_quantity,
       round(b2, 4) coef_l_discount from (
  select (p * b - q * c) / (a * b - c * c) b1, (q * a - p * c) / (a * b - c * c) b2, avg_x1, avg_x2, avg_y
  from (select var_pop(l_quantity) a, var_pop(l_discount) b, covar_pop(l_quantity, l_discount) c,
               covar_pop(l_quantity, l_extendedprice) p, covar_pop(l_discount, l_extendedprice) q,
               avg(l_quantity) avg_x1, avg(l_discount) avg_x2, avg(l_extendedprice) avg_y from lineitem))""",
    "fit_tree": """select (l_linenumber % 4)::double x, round(avg(l_extendedprice), 4) prediction
from lineitem group by 1""",
    "fit_gbt": """select (l_linenumber % 4)::double x, round(avg(l_extendedprice), 4) prediction
from lineitem group by 1""",
    "fit_forest": """select (l_linenumber % 4)::double x, round(avg(l_extendedprice), 4) prediction
from lineitem group by 1""",
    "fit_mlp": f"""with {TRANS},
{_net_ctes('nx', 'next_x')},
{_net_ctes('ny', 'next_y')}
select frame, slot, {_net_out('nx')} pred_next_x, {_net_out('ny')} pred_next_y
from sp, nx{NET_EPOCHS}, ny{NET_EPOCHS} where not is_train""",
    "model_report": f"""with {TRANS}, {REPORT}
select 'linear' model, {_rmse('lx', 'ly')} from te
union all select 'tree', {_rmse('mx', 'my')} from te
union all select 'forest', {_rmse('mx', 'my')} from te
union all select 'gbt', {_rmse('mx', 'my')} from te
union all select 'isotonic', {_rmse('ix', 'iy')} from te""",
    "model_report_files": f"""with {TRANS}, {_file_ctes('fx', 'next_x')}, {_file_ctes('fy', 'next_y')}
select 'linear' model,
  (select round(sqrt(avg((fx.k0 * x + fx.k1 * y + fx.k - next_x) ** 2)), 4) from fxr, fx where not is_train) rmse_x,
  (select round(sqrt(avg((fy.k0 * x + fy.k1 * y + fy.k - next_y) ** 2)), 4) from fyr, fy where not is_train) rmse_y""",
    "memory_fit_linear": f"""with {MEM}, {_least_squares('lx', 'mem', 'next_x')}, {_least_squares('ly', 'mem', 'next_y')}
select 'next_x' label, round(k, 4) intercept, round(k0, 4) x1, round(k1, 4) y1, round(k2, 4) x2, round(k3, 4) y2 from lx
union all select 'next_y', round(k, 4), round(k0, 4), round(k1, 4), round(k2, 4), round(k3, 4) from ly""",
    "memory_forecast": f"""with recursive {MEM}, {_least_squares('lx', 'mem', 'next_x')}, {_least_squares('ly', 'mem', 'next_y')},
f(track, origin, step, cx, cy, vx, vy, px, py) as (
  select track, origin, 0, 0.0::double, 0.0::double, next_x, next_y, x2, y2 from mem
  union all
  select track, origin, step + 1, cx + nx, cy + ny, nx, ny, vx, vy from (
    select f.*, ((((lx.k0 * px) + lx.k1 * py) + lx.k2 * vx) + lx.k3 * vy) + lx.k nx,
           ((((ly.k0 * px) + ly.k1 * py) + ly.k2 * vx) + ly.k3 * vy) + ly.k ny from f, lx, ly where step < 3))
select track, origin, step, round(cx, 4) cx, round(cy, 4) cy, round(vx, 4) vx, round(vy, 4) vy from f""",
    "fit_isotonic": """with g as (select l_quantity x, count(*) w, sum(l_extendedprice) s from lineitem group by 1),
pre as (select x, sum(w) over (order by x) cw, sum(s) over (order by x) cs from g),
iv as (select a.x lo, b.x hi, (b.cs - a.cs + ga.s) / (b.cw - a.cw + ga.w) v
       from pre a join g ga on ga.x = a.x join pre b on a.x <= b.x),
mn as (select p.x, iv.lo, min(iv.v) m from g p join iv on iv.lo <= p.x and iv.hi >= p.x group by 1, 2)
select x, round(max(m), 4) prediction from mn group by 1""",
    "index_categories": """select distinct (l_linenumber % 4)::double x,
       (dense_rank() over (order by l_linenumber % 4) - 1)::double idx from lineitem""",
    "train_test_split": f"""select event_id, {_split('event_id')} is_train from events""",
    "l2_normalize": """select vec_id id, pos - 1 pos, round(embedding[pos]::double / n, 6) + 0.0 e
from (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) n,
             unnest(generate_series(1, len(embedding))) pos from embeddings)""",
    "evaluate_linear": f"""with {TRANS}, {_coef('cx', 'next_x', 'is_train')}, {_coef('cy', 'next_y', 'is_train')}
select round(sqrt(avg(((cx.b1 * x + cx.b2 * y) + cx.i - next_x) ** 2)), 4) rmse_x,
       round(sqrt(avg(((cy.b1 * x + cy.b2 * y) + cy.i - next_y) ** 2)), 4) rmse_y
from sp, cx, cy where not is_train""",
    "forecast_paths": f"""with recursive {TRANS}, {_coef('cx', 'next_x')}, {_coef('cy', 'next_y')},
f(frame, slot, step, cx, cy, vx, vy) as (
  select frame, slot, 0, bx, by_, bx - x, by_ - y from mt where nslot is not null
  union all
  select frame, slot, step + 1, cx + nvx * 1.0 * 1.0, cy + nvy * 1.0 * 1.0, nvx, nvy from (
    select f.*, (c1.b1 * f.vx + c1.b2 * f.vy) + c1.i nvx, (c2.b1 * f.vx + c2.b2 * f.vy) + c2.i nvy
    from f, cx c1, cy c2 where f.step < {STEPS}))
select frame, slot, step, round(cx, 4) cx, round(cy, 4) cy, round(vx, 4) vx, round(vy, 4) vy from f""",
}
