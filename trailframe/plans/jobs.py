"""Composite jobs (Q1-Q9): what a user of the library calls end to end."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions import scalar as S
from trailframe.operators import clustering as C
from trailframe.operators import grids, matching
from trailframe.operators import regression as RG
from trailframe.operators.forecast import forecast, initial_agents
from trailframe.operators.mlp import fit_mlp
from trailframe.sources import frames as FR
from trailframe.sources import text as TX


def extract_detections(spark: SparkSession, frames_path: str, out_path: str | None = None,
                       start: int | None = None, stop: int | None = None, k: int = 20,
                       passes: int = 20, threshold: float = 220.0, seed: int = 7,
                       tol: float | None = None, on_invalid: str = "error",
                       mode: str = "errorifexists") -> DataFrame:
    """Q1: frames -> dark pixels -> k-means per frame -> detections.

    All frames are clustered together, one plan per Lloyd pass (the
    reference runs a separate fit per frame from the driver): at most
    ``passes`` passes, or with ``tol`` until no centre moved more than that.
    Centre ids become slots.  A missing frame would break the links to its
    neighbours, so a frame that does not decode stops the job unless
    ``on_invalid="drop"`` (:func:`frames.skipped_frames` lists them).  With
    ``out_path`` the detections are written as Parquet; a second run into the
    same folder needs ``mode="overwrite"`` (or ``"append"`` for other frames).
    """
    frames = FR.read_frames(spark, frames_path, start, stop, on_invalid=on_invalid)
    det = detect(frames, k, passes, threshold, seed, tol)
    if out_path:
        TX.write_center_lines(det, out_path, fmt="parquet", mode=mode)
    return det


def detect(frames: DataFrame, k: int = 20, passes: int = 20, threshold: float = 220.0, seed: int = 7,
           tol: float | None = None) -> DataFrame:
    """Q1 on decoded frames: ``(frame, slot, x, y)``."""
    px = FR.with_pixel_id(FR.pixels(frames, threshold))
    centers = C.frame_kmeans(px, k=k, passes=passes, seed=seed, key="pid", tol=tol)
    return centers.select("frame", F.col("cid").cast("long").alias("slot"), "x", "y")


def build_transitions(det: DataFrame, x_path: str | None = None, y_path: str | None = None,
                      **kw) -> DataFrame:
    """Q2: detections -> matched -> lookahead -> gate -> transition rows
    (optionally written as the reference's two CSV files)."""
    tr = matching.build_transitions(det, **kw)
    if x_path and y_path:
        TX.write_transitions(tr, x_path, y_path)
    return tr


def model_report(tr: DataFrame, seed: int = 42, key=None, as_coded: bool = False,
                 kinds: Sequence[str] = ("linear", "tree", "forest", "gbt", "isotonic")) -> DataFrame:
    """Q3: every regressor on both labels, ``(model, rmse_x, rmse_y)``."""
    return RG.model_report(tr, kinds=kinds, seed=seed, key=key, as_coded=as_coded)


def model_report_from_files(spark: SparkSession, x_path: str, y_path: str, seed: int = 42,
                            features: Sequence[str] = ("x", "y"),
                            kinds: Sequence[str] = ("linear", "tree", "forest", "gbt", "isotonic")) -> DataFrame:
    """Q3 from the two transition files: the x models are fitted and scored
    on the rows of one file, the y models on those of the other, split by a
    hash of the row's values; ``(model, rmse_x, rmse_y)``.  ``"net"`` (M16)
    is a kind too."""
    schema = TX.transition_schema(len(features), max(1, len(features) // 2))
    parts = {}
    for label, path in zip(RG.LABELS, (x_path, y_path)):
        rows = TX.read_transitions(spark, path, schema).withColumnRenamed("n", label)
        # millionths of the values as text: the same in every engine
        k = F.concat_ws(",", *[F.round(F.col(c) * 1_000_000).cast("long").cast("string") for c in (*features, label)])
        train, test = RG.train_test_split(rows, 0.7, seed, k)
        parts[label] = (RG.assemble(train, features).persist(), RG.assemble(test, features).persist())
    try:
        def run(job):
            kind, label = job
            train, test = parts[label]
            if kind == "net":
                scored = fit_mlp(train, features, label).transform(test, f"pred_{label}")
            else:
                scored = RG.fit(kind, train, label, seed).transform(test)
            return float(RG.rmse(scored, [(f"pred_{label}", label)], ["r"]).first()["r"])

        jobs = [(kind, label) for kind in kinds for label in RG.LABELS]
        with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
            got = dict(zip(jobs, pool.map(run, jobs)))
    finally:
        for pair in parts.values():
            for d in pair:
                d.unpersist()
    rows = [(kind, *[got[(kind, label)] for label in RG.LABELS]) for kind in kinds]
    return spark.createDataFrame(rows, "model string, rmse_x double, rmse_y double")


def heatmap(det: DataFrame, width: int = 720, height: int = 480, dense: bool = False) -> dict[str, DataFrame]:
    """Q4: visit grid, its extent and its colours."""
    grid = grids.heatmap(det, width, height, dense=dense)
    return {"grid": grid, "extent": grids.heatmap_extent(grids.heatmap(det, width, height), width, height),
            "colors": grids.heatmap_colors(grids.heatmap(det, width, height), width, height),
            "dropped": grids.out_of_bounds(det, width, height)}


def flow_field(det: DataFrame, bin_size: int = 15, **kw) -> dict[str, DataFrame]:
    """Q5: flow field and its glyph segments."""
    ff = grids.flow_field(det, bin_size=bin_size, **kw)
    return {"field": ff, "segments": grids.glyph_segments(ff, bin_size)}


# The survey's columns that are kept.
SURVEY_COLUMNS = ("GENHLTH", "PHYSHLTH", "MENTHLTH", "POORHLTH", "EDUCA", "SEX", "MARITAL", "EMPLOY1")


def survey_segments(spark: SparkSession, path: str, cols: Sequence[str] = SURVEY_COLUMNS, k: int = 5,
                    seed: int = 1, drop_subset: Sequence[str] | str | None = "kept") -> dict[str, object]:
    """Q6: survey CSV -> int columns -> drop NULL rows -> normalized vectors
    -> k-means -> cost, assignments, centres.

    ``drop_subset="kept"`` (default) drops rows with a NULL among ``cols``
    only, so unused columns are pruned from the scan; ``None`` drops on any
    column, as coded."""
    raw = TX.read_survey(spark, path)
    typed = TX.cast_columns(raw, cols, "int")
    subset = list(cols) if drop_subset == "kept" else drop_subset
    clean = TX.drop_nulls(typed, subset).select(*cols)
    vec = RG.l2_normalize(RG.assemble(clean, cols), "features", "normFeatures")
    from pyspark.ml.clustering import KMeans

    model = KMeans(k=k, seed=seed, featuresCol="normFeatures").fit(vec)
    assigned = model.transform(vec)
    cost = float(model.summary.trainingCost)
    n = assigned.count()
    return {"model": model, "assigned": assigned.select("features", "normFeatures", "prediction"),
            "cost": cost, "cost_distance": (cost / n) ** 0.5 if n else float("nan"),
            "centers": [list(map(float, c)) for c in model.clusterCenters()]}


# Colour stops of the station clusters' ids.
STATION_STOPS = ((0.0, S.BLUE_ARGB), (1000.0, S.RED_ARGB), (2000.0, S.GREEN_ARGB))


def station_clusters(spark: SparkSession, path: str, k: int = 2000, seed: int = 1,
                     with_check: bool = False) -> DataFrame:
    """Q7: fixed-width stations -> k-means on (lat, lon) ->
    ``(lon, lat, prediction, r, g, b)``; the colour of a cluster id comes
    from the three-stop ramp 0 -> blue, 1000 -> red, 2000 -> green (P13);
    ``with_check`` adds ``nearest``, whether no centre is nearer."""
    st = TX.read_stations(spark, path).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    model = C.kmeans(st, k=k, seed=seed, cols=("lat", "lon"))
    out = C.cluster_assign(model, st, cols=("lat", "lon"))
    packed = S.color_ramp("prediction", STATION_STOPS)
    r, g, b = S.rgb_channels(packed)
    more = [C.is_nearest(model, ("lat", "lon")).alias("nearest")] if with_check else []
    return out.select("lon", "lat", "prediction", r.alias("r"), g.alias("g"), b.alias("b"), *more)


def balanced_clusters(points: DataFrame, k: int = 20, breakpoint: float = 2.0, tolerance: float = 1.0,
                      seed: int = 7, max_rounds: int = 20) -> dict[str, object]:
    """Q8: similar-size k-means next to plain k-means on the same points."""
    bal = C.similar_size_kmeans(points, k=k, breakpoint=breakpoint, tolerance=tolerance, seed=seed,
                                max_rounds=max_rounds)
    km = C.kmeans(points, k=k, seed=seed)
    return {"balanced": bal, "kmeans_centers": [tuple(map(float, c)) for c in km.clusterCenters()]}


def forecast_paths(spark: SparkSession, tr: DataFrame, kind: str = "linear", n_agents: int = 20,
                   n_steps: int = 100, dt: float = 1.0 / 60.0, speed: float = 3500.0, seed: int = 42,
                   agents: DataFrame | None = None) -> DataFrame:
    """Q9: fit the model pair on transitions and move many agents at once."""
    pair = RG.fit_pair(kind, tr, ("x", "y"), seed=seed)
    ag = agents if agents is not None else initial_agents(spark, n_agents, seed)
    key = ("agent",) if "agent" in ag.columns else tuple(c for c in ag.columns if c not in ("cx", "cy", "vx", "vy"))
    return forecast(ag, pair, n_steps=n_steps, dt=dt, speed=speed, key=key)
