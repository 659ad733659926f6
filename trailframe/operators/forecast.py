"""Multi-step forecast for many agents at once.

The reference moves each simulated agent on the driver, one model call per
agent per tick.  Here a step is one projection over the whole agent table:
both models score the current velocities and the new velocities move the
agents.  Blocks of steps (one expression for linear models, one Arrow pass
for trees and the net, chained projections otherwise) are written to a
step-partitioned table; the next block reads the last step back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions.scalar import advance
from trailframe.operators import rollout as RO
from trailframe.operators.regression import ModelPair


def initial_agents(spark: SparkSession, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` agents with whole-number positions in [200, 400) and
    velocities in [-1, 1), from seeded hashes of the agent id."""
    def u(salt: int):
        h = F.xxhash64(F.col("id"), F.lit(int(seed)), F.lit(salt))
        return F.pmod(h, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))

    return spark.range(int(n)).select(
        F.col("id").alias("agent"),
        (F.lit(200.0) + F.floor(u(1) * 200)).alias("cx"),
        (F.lit(200.0) + F.floor(u(2) * 200)).alias("cy"),
        (u(3) * 2 - 1).alias("vx"), (u(4) * 2 - 1).alias("vy"))


def forecast(agents: DataFrame, pair: ModelPair, n_steps: int, dt: float, speed: float = 3500.0,
             key: tuple[str, ...] = ("agent",), out_path: str | None = None, block: int = 10,
             write: bool = True) -> DataFrame:
    """``(key..., step, cx, cy, vx, vy)`` for steps 0..n_steps.

    Each step predicts the new velocity from the OLD velocity pair (both
    models read the same input), then moves with the NEW velocity:
    ``c += v_new * speed * dt``.

    A pair of ``2k`` features works on a memory of the k newest velocities
    (``x1, y1`` oldest .. ``xk, yk`` newest): agents then bring the columns
    ``m_x1, m_y1, .., m_xk, m_yk`` besides, each step predicts from them and
    shifts the new velocity in.

    Trees, forests, GBT models and the net run all steps of a block in one
    Arrow pass (:mod:`trailframe.operators.rollout`); an agent without a
    velocity then has NULLs after step 0.

    An agent's path depends on nothing but its own row, so ``block`` steps
    are one pass (no shuffle): each step scores the previous
    velocities and, for the other models, appends its state to a per-row
    trajectory array, which is exploded into rows.  A block is written to its own ``block=<first step>`` folder
    of a Parquet table (a fresh folder under the checkpoint folder unless
    ``out_path`` is given).  The next block starts from the last step read
    back from the previous block's folder, so plans stay bounded and a lost
    executor costs at most one block.  Only the folders that this call wrote
    are read, whatever else ``out_path`` holds.

    With ``write=False`` all steps must be one block, which is not written
    but returned as a plan: its rows are made where they are used, once for
    each use, and should start from agents that are cheap to read.
    """
    from trailframe.sources.text import scratch_path

    if n_steps < 0 or block < 1:
        raise ValueError("n_steps must be >= 0 and block >= 1")
    if not write and (out_path or block < n_steps):
        raise ValueError("write=False takes one block and no out_path")
    spark = agents.sparkSession
    out = (out_path or scratch_path(spark, "forecast")).rstrip("/") if write else None
    lx, ly = list(pair.models)[:2]
    memory = len(pair.features) // 2
    state = ["cx", "cy", "vx", "vy"]
    state += [f"m_{a}{i}" for i in range(1, memory + 1) for a in ("x", "y")] if memory > 1 else []

    def point(step):
        return F.struct(F.lit(step).alias("step"), *[F.col(c).alias(c) for c in state])

    cur = agents.select(*key, *state)
    first = 0
    folders = []
    score = RO.scorers(pair, spark) if pair.kind in RO.KINDS else None
    while True:
        last = min(first + block, n_steps)
        if score:
            df = None
            rows = RO.rollout(cur, pair, key, state, first, last, speed, dt, score)
        elif pair.kind == "linear" and memory == 1:
            traj = _linear_fold(pair, point(first), first, last, speed, dt)
            if first > 0:
                traj = F.slice(traj, 2, last - first)
            df = cur.withColumn("_traj", traj)
        else:
            df = cur.withColumn("_traj", F.array(point(first)) if first == 0 else
                                F.array().cast(f"array<struct<step:int,{','.join(c + ':double' for c in state)}>>"))
            for s in range(first + 1, last + 1):
                inputs = (dict(zip(pair.features, state[4:])) if memory > 1
                          else dict(zip(pair.features, ("vx", "vy"))))
                scored = pair.predict(df.withColumns({f: F.col(c) for f, c in inputs.items()}))
                nvx, nvy = F.col(f"pred_{lx}"), F.col(f"pred_{ly}")
                shifted = [F.col(c).alias(m) for m, c in zip(state[4:], state[6:])]
                shifted += [nvx.alias(f"m_x{memory}"), nvy.alias(f"m_y{memory}")] if memory > 1 else []
                df = scored.select(*key, advance("cx", nvx, speed, dt).alias("cx"),
                                   advance("cy", nvy, speed, dt).alias("cy"),
                                   nvx.alias("vx"), nvy.alias("vy"), *shifted, "_traj")
                df = df.withColumn("_traj", F.concat("_traj", F.array(point(s))))
        if df is not None:
            rows = df.select(*key, F.explode("_traj").alias("_p")).select(*key, "_p.*")
        if not write:
            return rows.select(*key, F.col("step").cast("int").alias("step"), *state[:4])
        folders.append(f"{out}/block={first}")
        rows.write.mode("overwrite").parquet(folders[-1])
        if last >= n_steps:
            break
        first = last
        cur = spark.read.parquet(folders[-1]).where(F.col("step") == F.lit(last)).select(*key, *state)
    return spark.read.parquet(*folders).select(*key, F.col("step").cast("int").alias("step"), *state[:4])


def _linear_fold(pair: ModelPair, start, first: int, last: int, speed: float, dt: float):
    """Trajectory of steps ``first..last`` for a linear velocity model as a
    per-row fold (``aggregate`` over the step numbers): each step reads only
    the previous element, so the expression stays linear in the number of
    steps (chained projections would inline every earlier step twice)."""
    (lx, mx), (ly, my) = list(pair.models.items())[:2]

    def lin(m, vx, vy):
        c = [float(v) for v in m.coefficients]
        return (F.lit(c[0]) * vx + F.lit(c[1]) * vy) + F.lit(float(m.intercept))

    def step(acc, s):
        p = F.element_at(acc, -1)
        nvx, nvy = lin(mx, p["vx"], p["vy"]), lin(my, p["vx"], p["vy"])
        nxt = F.struct(s.cast("int").alias("step"),
                       (p["cx"] + nvx * F.lit(float(speed)) * F.lit(float(dt))).alias("cx"),
                       (p["cy"] + nvy * F.lit(float(speed)) * F.lit(float(dt))).alias("cy"),
                       nvx.alias("vx"), nvy.alias("vy"))
        return F.concat(acc, F.array(nxt))

    if last <= first:
        return F.array(start)
    return F.aggregate(F.sequence(F.lit(first + 1), F.lit(last)), F.array(start), step)
