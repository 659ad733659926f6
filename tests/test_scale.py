"""Skew and plan-shape checks: a hot frame does not change results, and the
core plans never funnel the facts through one partition."""

import random

from pyspark.sql import functions as F

from test_matching import DET_SCHEMA, brute_match
from trailframe.operators import clustering as C
from trailframe.operators import grids, matching
from trailframe.operators.indexing import row_index


def hot_rows():
    rnd = random.Random(11)
    rows = []
    # frame 3 holds a third of all rows, half of them copies of one point
    for f in range(8):
        n = 240 if f == 3 else 60
        for s in range(n):
            if f == 3 and s % 2 == 0:
                rows.append((f, s, 30.0, 30.0))
            else:
                rows.append((f, s, round(rnd.uniform(0, 80), 1), round(rnd.uniform(0, 80), 1)))
    return rows


def test_hot_frame_matching_is_exact(spark):
    rows = hot_rows()
    det = spark.createDataFrame(rows, DET_SCHEMA).repartition(4)
    got = {(r.frame, r.slot): r.nslot for r in matching.match_next_frame(det, 12.0, "null").collect()}
    want = brute_match(rows, 12.0)
    assert got == {k: (None if w is None else w[1]) for k, w in want.items()}


def test_hot_group_numbering_is_split(spark):
    rows = [(0 if i % 3 else 1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long")
    out = row_index(df, ["g"], "o", "rn", bucket_width=128)
    got = {(r.g, r.o): r.rn for r in out.collect()}
    for g in (0, 1):
        keys = sorted(o for gg, o in rows if gg == g)
        assert [got[(g, o)] for o in keys] == list(range(len(keys)))


def test_numbering_parts_follow_rows_not_values(spark):
    """Sparse ids cost the same as dense ones, a hot group is split."""
    from trailframe.operators import indexing

    sizes = {}
    for step in (1, 10 ** 9):
        df = spark.range(20_000).select((F.col("id") % 3 > 0).cast("long").alias("g"), (F.col("id") * step).alias("o"))
        got = indexing.row_index(df, ["g"], "o", "rn", bucket_width=1000)
        want = {}
        for g, o, rn in sorted(tuple(r) for r in got.collect()):
            assert rn == want.get(g, 0)
            want[g] = rn + 1
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        # the facts meet one join, no window; the only window is over the parts
        assert plan.count("Window") == 1 and plan.count("Join") == 1
        written = [f for f in got.inputFiles()]
        rows = [r["count"] for r in spark.read.parquet(*written).groupBy(F.input_file_name()).count().collect()]
        assert max(rows) < 2500 and sum(rows) == 20_000
        sizes[step] = len(rows)
    assert abs(sizes[1] - sizes[10 ** 9]) <= 2


def test_numbering_splits_a_hot_value(spark):
    """A third of the rows share one group and one ordering value."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("o"), "id")
    got = row_index(df, [], "o", "rn", bucket_width=500)
    rows = sorted((r.rn, r.o) for r in got.collect())
    assert [r[0] for r in rows] == list(range(9000))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    sizes = [r["count"] for r in spark.read.parquet(*got.inputFiles()).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 1500


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_plans_have_no_single_partition_exchange(spark, tmp_dir):
    det = spark.createDataFrame(hot_rows(), DET_SCHEMA)
    path = f"{tmp_dir}/det"
    det.write.parquet(path)
    det = spark.read.parquet(path)
    plans = {
        "match": matching.match_next_frame(det, 12.0, "origin"),
        "transitions": matching.build_transitions(det, gate_limit=25.0, radius=12.0),
        "flow": grids.flow_field(det, radius=12.0, slow_limit=30.0),
        "heat": grids.heatmap(det, 100, 100),
        "frame_kmeans_step": C.frame_lloyd_step(*C._dealt_points(det, "frame", "slot", 100),
                                                C.frame_initial_centers(det, 3, 7)),
        "memory": matching.memory_features(det.select(F.col("frame").alias("step"), F.col("slot").alias("track"),
                                                      "x", "y")),
    }
    for name, df in plans.items():
        lines = _plan(df).split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                # allowed only for a global aggregate: one partial row per task
                below = lines[i + 1]
                assert "HashAggregate" in below and "partial_" in below, (name, below)
