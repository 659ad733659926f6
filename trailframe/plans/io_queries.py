"""Registered source/sink queries.

Each query writes a file derived from a shared table into a fresh folder
under the session's checkpoint folder, reads it back with the reader under
test and returns what the reader produced.  The SQL computes the same rows
straight from the table, so a reader that loses, reorders or mis-parses a
line fails the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe import fixtures as fx
from trailframe.operators import clustering as C
from trailframe.operators import matching
from trailframe.plans import jobs
from trailframe.sources import frames as FR
from trailframe.sources import text as TX

SURVEY_COLS = jobs.SURVEY_COLUMNS
DARK, DETECT_K, DETECT_PASSES = 100.0, 2, 4


def q_center_lines_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    det = fx.detections(spark, sf)
    path = TX.scratch_path(spark, "centre-lines")
    TX.write_center_lines(det, path, fmt="text", mode="overwrite")
    return TX.read_center_lines(spark, path)


def q_center_lines_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Every second frame is empty: the others keep their numbers."""
    det = fx.detections(spark, sf).withColumn("frame", F.col("frame") * 2 + 1)
    path = TX.scratch_path(spark, "centre-lines")
    TX.write_center_lines(det, path, fmt="text")
    return TX.read_center_lines(spark, path)


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded images from the line items: an order is a frame of one row of
    pixels, a line is a pixel whose three bytes come from its keys."""
    li = fx.table(spark, sf, "lineitem")
    rgb = ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 31) % 16777216)
    hex6 = F.lpad(F.hex(rgb), 6, "0")
    bgr = F.concat(F.substring(hex6, 5, 2), F.substring(hex6, 3, 2), F.substring(hex6, 1, 2))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", bgr.alias("b"))))
    return (li.groupBy(F.col("l_orderkey").alias("frame")).agg(lines.alias("p"))
            .select("frame", F.lit(1).alias("height"), F.size("p").alias("width"), F.lit(3).alias("nChannels"),
                    F.unhex(F.array_join(F.transform("p", lambda e: e["b"]), "")).alias("data")))


def q_frame_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """S3 and P1-P3 on images: the Arrow-batched path."""
    return FR.pixels(_images(spark, sf), DARK).select("frame", "x", "y", F.round("v", 6).alias("v"))


def q_extract_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 on images: dark pixels, then k-means per frame."""
    det = jobs.detect(_images(spark, sf), k=DETECT_K, passes=DETECT_PASSES, threshold=DARK, seed=7)
    return det.select("frame", "slot", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def q_detections_parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    det = fx.detections(spark, sf)
    path = TX.scratch_path(spark, "detections")
    TX.write_center_lines(det, path, fmt="parquet", mode="overwrite", frames_per_folder=100)
    return TX.read_detections(spark, path)


def q_transitions_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    tr = matching.build_transitions(fx.detections(spark, sf), hops=2, gate_limit=25.0,
                                    mode="position", on_miss="origin")
    xp, yp = TX.scratch_path(spark, "tx"), TX.scratch_path(spark, "ty")
    TX.write_transitions(tr, xp, yp)
    both = [TX.read_transitions(spark, p).withColumn("file", F.lit(f)) for f, p in (("x", xp), ("y", yp))]
    return both[0].unionByName(both[1])


def _station_source(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("ST"), F.lpad(k.cast("string"), 9, "0")).alias("sid"),
        ((k * 37) % 18000 / F.lit(100.0) - F.lit(90.0)).alias("lat"),
        ((k * 91) % 36000 / F.lit(100.0) - F.lit(180.0)).alias("lon"),
        ((k % 4000) / F.lit(10.0) - F.lit(100.0)).alias("elev"),
        F.col("s_name").alias("name"))


def _stations(spark: SparkSession, sf: str) -> DataFrame:
    path = TX.scratch_path(spark, "stations")
    TX.station_lines(_station_source(spark, sf)).write.mode("overwrite").text(path)
    return TX.read_stations(spark, path)


def q_stations_fixed_width(spark: SparkSession, sf: str) -> DataFrame:
    st = _stations(spark, sf)
    return st.select("sid", *[F.round(c, 4).alias(c) for c in ("lat", "lon", "elev")], "name")


def q_station_clusters(spark: SparkSession, sf: str) -> DataFrame:
    path = TX.scratch_path(spark, "stations")
    TX.station_lines(_station_source(spark, sf)).write.mode("overwrite").text(path)
    out = jobs.station_clusters(spark, path, seed=1, with_check=True)
    return out.select(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "nearest")


def q_daily_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ev = fx.table(spark, sf, "events")
    daily = ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sid"),
                      F.to_date("ts").alias("date"), F.col("event_type").alias("measure"), "value")
    path = TX.scratch_path(spark, "daily")
    TX.write_daily(daily, path)
    d = TX.read_daily(spark, path)
    # dates compared as ISO strings so both engines hash them alike
    return d.select("sid", F.date_format("date", "yyyy-MM-dd").alias("date"), "measure", "value")


def _survey_csv(spark: SparkSession, sf: str) -> str:
    """Header CSV with the survey's column names, derived from customers:
    some cells are blank, some are junk, so casting and NULL dropping matter."""
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    vals = dict(zip(SURVEY_COLS, (
        k % 5 + 1, k % 31, k * 7 % 31, k * 3 % 31, F.col("c_nationkey") % 6 + 1, k % 2 + 1, k % 6 + 1,
        F.length("c_mktsegment") % 8 + 1)))
    cols = [F.col("c_custkey").cast("string").alias("ID")]
    for i, (name, v) in enumerate(vals.items()):
        s = v.cast("string")
        s = (F.when(k % (11 + i) == 0, F.lit(""))
             .when(k % (29 + 2 * i) == 0, F.lit("x"))
             .otherwise(s))
        cols.append(s.alias(name))
    cols.append(F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("NOTE"))
    path = TX.scratch_path(spark, "survey")
    c.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    return path


def q_survey_table(spark: SparkSession, sf: str) -> DataFrame:
    path = _survey_csv(spark, sf)
    raw = TX.read_survey(spark, path)
    typed = TX.cast_columns(raw, ["ID", *SURVEY_COLS], "int")
    return TX.drop_nulls(typed, list(SURVEY_COLS)).select("ID", *SURVEY_COLS)


def q_survey_segments(spark: SparkSession, sf: str) -> DataFrame:
    path = _survey_csv(spark, sf)
    res = jobs.survey_segments(spark, path, k=5, seed=1)
    from pyspark.ml.functions import vector_to_array

    # the reference's distance is that of the normalised vectors
    flat = res["assigned"].select("prediction", vector_to_array("features").alias("f"),
                                  vector_to_array("normFeatures").alias("u"))
    flat = flat.select("prediction", "f", *[F.col("u")[i].alias(f"u{i}") for i in range(len(SURVEY_COLS))])
    near = C.is_nearest(res["model"], [f"u{i}" for i in range(len(SURVEY_COLS))])
    return flat.select(*[F.col("f")[i].cast("int").alias(c) for i, c in enumerate(SURVEY_COLS)], near.alias("nearest"))


QUERIES = {
    "center_lines_roundtrip": q_center_lines_roundtrip,
    "detections_parquet_roundtrip": q_detections_parquet_roundtrip,
    "transitions_csv_roundtrip": q_transitions_csv_roundtrip,
    "stations_fixed_width": q_stations_fixed_width,
    "station_clusters": q_station_clusters,
    "daily_csv_roundtrip": q_daily_csv_roundtrip,
    "survey_table": q_survey_table,
    "survey_segments": q_survey_segments,
    "center_lines_gaps": q_center_lines_gaps,
    "frame_pixels": q_frame_pixels,
    "extract_detections": q_extract_detections,
}


def _survey_sql(ids: bool = True) -> str:
    values = ("c_custkey % 5 + 1", "c_custkey % 31", "c_custkey * 7 % 31", "c_custkey * 3 % 31",
              "c_nationkey % 6 + 1", "c_custkey % 2 + 1", "c_custkey % 6 + 1", "length(c_mktsegment) % 8 + 1")
    sel, conds = [], []
    for i, (name, e) in enumerate(zip(SURVEY_COLS, values)):
        bad = f"(c_custkey % {11 + i} = 0 or c_custkey % {29 + 2 * i} = 0)"
        sel.append(f"case when {bad} then null else ({e})::int end {name}")
        conds.append(f"not {bad}")
    more = ["c_custkey::int \"ID\""] if ids else ["true nearest"]
    return f"select {', '.join(more + sel)} from customer where {' and '.join(conds)}"


SQL = {
    "center_lines_roundtrip": """with det as (
  select (dense_rank() over (order by h) - 1)::bigint as frame,
         (row_number() over (partition by h order by event_id) - 1)::bigint as slot, x, y
  from (select date_trunc('hour', ts) h, event_id, cast(user_id as double) x, value y from events))
select frame, slot, x, y from det""",
    "detections_parquet_roundtrip": """with det as (
  select (dense_rank() over (order by h) - 1)::bigint as frame,
         (row_number() over (partition by h order by event_id) - 1)::bigint as slot, x, y
  from (select date_trunc('hour', ts) h, event_id, cast(user_id as double) x, value y from events))
select frame, slot, x, y from det""",
    "stations_fixed_width": """select 'ST' || lpad(s_suppkey::varchar, 9, '0') sid,
  round((s_suppkey * 37) % 18000 / 100.0::double - 90.0::double, 4) lat,
  round((s_suppkey * 91) % 36000 / 100.0::double - 180.0::double, 4) lon,
  round((s_suppkey % 4000) / 10.0::double - 100.0::double, 4) elev,
  trim(s_name) name from supplier""",
    "daily_csv_roundtrip": """select 'U' || user_id::varchar sid, strftime(cast(ts as date), '%Y-%m-%d') date,
       event_type measure, value from events""",
    "survey_table": _survey_sql(),
}


def _transitions_sql() -> str:
    from trailframe.plans.sql_common import TRANSITIONS_POSITION

    head = "select a.frame, a.slot, a.nx x, a.ny y, b.nx next_x, b.ny next_y"
    body = TRANSITIONS_POSITION.split(head)
    return (f"{body[0]}, t as ({head}{body[1]})\n"
            "select 'x' file, x, y, next_x n from t union all select 'y', x, y, next_y from t")


SQL["transitions_csv_roundtrip"] = _transitions_sql()

IMAGES = """px as (select l_orderkey frame,
    (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1)::double x, 0.0::double y,
    (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 16777216 rgb from lineitem),
dark as (select frame, x, y, v from (select *, 255.0::double - ((((rgb & 16711680) / 65536.0::double)
    + ((rgb & 65280) / 256.0::double)) + (rgb & 255)::double) / 3.0::double v from px) where v > 100)"""


def _detect_sql() -> str:
    from trailframe.plans.cluster_queries import _lloyd_ctes

    return f"""with {IMAGES}, pts as (select frame, x::bigint id, x, y from dark),
c0 as (select * from (select frame,
  (row_number() over (partition by frame order by md5('7:' || id::varchar), id) - 1)::int c, x, y from pts) where c < {DETECT_K}),
{_lloyd_ctes(DETECT_PASSES, by='frame')}
select frame, c::bigint slot, round(x, 6) x, round(y, 6) y from c{DETECT_PASSES}"""


SQL["frame_pixels"] = f"with {IMAGES} select frame, x, y, round(v, 6) v from dark"
SQL["extract_detections"] = _detect_sql()
SQL["center_lines_gaps"] = SQL["center_lines_roundtrip"].replace("select frame, slot,", "select frame * 2 + 1 frame, slot,")
SQL["survey_segments"] = _survey_sql(ids=False)
SQL["station_clusters"] = """select round((s_suppkey * 91) % 36000 / 100.0::double - 180.0::double, 4) lon,
  round((s_suppkey * 37) % 18000 / 100.0::double - 90.0::double, 4) lat, true nearest from supplier"""
