"""Text and CSV sources and sinks.

* centre lines: one line per frame, ``(x,y);(x,y);...``, frame = line
  number, slot = position in the line;
* transitions: headerless CSV with an explicit schema, label last;
* survey: header CSV, every column a string;
* stations: fixed-width text;
* daily measures: CSV with ``yyyyMMdd`` dates.

Lines are numbered by file name, block of the file and place in the block:
each block's lines are numbered where they are, and only the table of block
sizes is summed up.  Part files written from a sorted DataFrame come back in
order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.session import ensure_checkpoint_dir, materialize

# Column ranges of the fixed-width station file, as
# (name, start, end) with 0-based start and exclusive end.
STATION_FIELDS = (("sid", 0, 11), ("lat", 12, 20), ("lon", 21, 30), ("elev", 31, 37), ("name", 41, 71))

DAILY_SCHEMA = T.StructType([T.StructField("sid", T.StringType()), T.StructField("date", T.DateType()),
                             T.StructField("measure", T.StringType()), T.StructField("value", T.DoubleType())])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared storage
    on a cluster) for files a job writes and reads back."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/trailframe-scratch/{name}-{uuid.uuid4().hex}"


def numbered_lines(spark: SparkSession, path: str, out: str = "line_no") -> DataFrame:
    """``(line_no, value)`` with 0-based line numbers across the files of
    ``path`` in name order.  A block of a file is one scan task's stretch of
    lines, read in order, so its lines are ranked by the row id of the scan;
    the running total runs over one row per block."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    ranked = lines.withColumn("_r", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")))
    sizes = ranked.groupBy("_f", "_b").agg(F.max("_r").alias("_n"))
    before = sizes.select("_f", "_b", (F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")).alias("_before"))
    return (ranked.join(before, ["_f", "_b"])
            .select((F.col("_before") + F.col("_r") - 1).cast("long").alias(out), "value"))


# --------------------------------------------------------------- centre lines

def parse_center_lines(lines: DataFrame) -> DataFrame:
    """S5 body: ``(frame, value)`` lines -> ``(frame, slot, x, y)``."""
    items = lines.select(F.col("frame"), F.posexplode(F.split("value", ";")).alias("slot", "item"))
    inner = F.expr("substring(item, 2, length(item) - 2)")
    parts = F.split(inner, ",")
    return items.where(F.length("item") > 0).select(
        "frame", F.col("slot").cast("long").alias("slot"),
        parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y"))


def read_center_lines(spark: SparkSession, path: str) -> DataFrame:
    """Detections from centre-line text; frame = line number from 0."""
    lines = numbered_lines(spark, path, "frame")
    return parse_center_lines(lines)


def center_lines(det: DataFrame) -> DataFrame:
    """``(frame, value)``: one text line per frame from 0 to the last one,
    points in slot order; a frame without points is an empty line.  A frame's
    points are gathered into its line, so a frame is one row."""
    pt = F.concat(F.lit("("), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit(")"))
    g = det.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("slot", pt.alias("s")))).alias("p"))
    lines = g.select("frame", F.concat_ws(";", F.transform("p", lambda e: e["s"])).alias("value"))
    last = det.agg(F.max("frame")).first()[0]
    every = det.sparkSession.range(0 if last is None else int(last) + 1).withColumnRenamed("id", "frame")
    return every.join(lines, "frame", "left").select("frame", F.coalesce("value", F.lit("")).alias("value"))


def write_center_lines(det: DataFrame, path: str, fmt: str = "parquet", mode: str | None = None,
                       frames_per_folder: int = 1000) -> None:
    """S6.  ``fmt="parquet"`` (default): ``(frame, slot, x, y)`` appended,
    partitioned by ``frame div frames_per_folder`` so frame ranges prune
    folders.  ``fmt="text"``: centre lines sorted by frame (range
    partitioned, part files in frame order, an empty line for a frame without
    points) so :func:`read_center_lines` numbers them back.  A text line's
    number is its place, so text is never appended to; ``mode`` is then
    ``"errorifexists"`` unless given."""
    if fmt == "text" and mode == "append":
        raise ValueError("centre lines are numbered by place: append to the parquet form, or write a new folder")
    mode = mode or ("append" if fmt == "parquet" else "errorifexists")
    if fmt == "parquet":
        (det.select("frame", "slot", "x", "y")
         .withColumn("frame_block", (F.col("frame") / F.lit(int(frames_per_folder))).cast("long"))
         .write.mode(mode).partitionBy("frame_block").parquet(path))
    elif fmt == "text":
        center_lines(det).orderBy("frame").select("value").write.mode(mode).text(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'text'")


def read_detections(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None,
                    frames_per_folder: int = 1000) -> DataFrame:
    """Parquet detections written by :func:`write_center_lines`.  A frame
    range becomes a filter on ``frame`` (pushed to the row groups) and on
    ``frame_block`` (``frames_per_folder`` as used by the writer), which
    prunes whole folders before any file is opened."""
    df = spark.read.parquet(path)
    blocked = "frame_block" in df.columns
    if start is not None:
        df = df.where(F.col("frame") >= F.lit(int(start)))
        if blocked:
            df = df.where(F.col("frame_block") >= F.lit(int(start) // int(frames_per_folder)))
    if stop is not None:
        df = df.where(F.col("frame") < F.lit(int(stop)))
        if blocked:
            df = df.where(F.col("frame_block") <= F.lit((int(stop) - 1) // int(frames_per_folder)))
    return df.select("frame", "slot", "x", "y")


# ---------------------------------------------------------------- transitions

def transition_schema(n_features: int = 2, memory: int = 1) -> T.StructType:
    """Schemas of the transition files: ``x, y, n`` or ``x1, y1, ..., xk, yk, n``."""
    if memory == 1 and n_features == 2:
        names = ["x", "y"]
    else:
        names = [f"{a}{i}" for i in range(1, memory + 1) for a in ("x", "y")]
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names + ["n"]])


def read_transitions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Headerless comma CSV with an explicit schema (label last)."""
    return (spark.read.schema(schema or transition_schema()).option("header", False)
            .option("delimiter", ",").csv(path))


def write_transitions(tr: DataFrame, x_path: str, y_path: str, features: Sequence[str] = ("x", "y"),
                      mode: str = "overwrite") -> None:
    """The two files of the reference: features + next x, features + next
    y.  The rows are computed once."""
    tr = materialize(tr.select(*features, "next_x", "next_y"), "transitions")
    tr.select(*features, F.col("next_x").alias("n")).write.mode(mode).csv(x_path)
    tr.select(*features, F.col("next_y").alias("n")).write.mode(mode).csv(y_path)


# --------------------------------------------------------------------- survey

def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column a string."""
    return spark.read.option("header", True).csv(path)


def cast_columns(df: DataFrame, cols: Sequence[str], dtype: str = "int") -> DataFrame:
    """Cast the named columns; a value that does not parse becomes NULL
    (``try_cast``; a plain cast throws under ANSI mode)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as {dtype})") for c in cols})


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P5: drop rows with a NULL in ``subset`` (all columns when None, as
    coded: then a NULL anywhere in the file drops the row)."""
    return df.na.drop("any", subset=list(subset) if subset is not None else None)


# ------------------------------------------------------------------- stations

def parse_stations(lines: DataFrame) -> DataFrame:
    """S10 body: fixed-width ``value`` -> ``(sid, lat, lon, elev, name)``;
    a short or malformed line gives NULLs instead of failing."""
    def field(start, end):
        return F.trim(F.substring("value", start + 1, end - start))

    cols = []
    for name, start, end in STATION_FIELDS:
        c = field(start, end)
        if name in ("lat", "lon", "elev"):
            c = F.expr(f"try_cast(trim(substring(value, {start + 1}, {end - start})) as double)")
        cols.append(c.alias(name))
    return lines.select(*cols)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width station list."""
    return parse_stations(spark.read.text(path))


def station_lines(df: DataFrame) -> DataFrame:
    """Format ``(sid, lat, lon, elev, name)`` as fixed-width lines."""
    fmt = "%-11s %8.4f %9.4f %6.1f    %-30s"
    return df.select(F.format_string(fmt, "sid", "lat", "lon", "elev", "name").alias("value"))


# ---------------------------------------------------------------------- daily

def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """``(sid, date, measure, value)`` with ``yyyyMMdd`` dates."""
    return spark.read.schema(DAILY_SCHEMA).option("dateFormat", "yyyyMMdd").csv(path)


def write_daily(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("sid", F.date_format("date", "yyyyMMdd").alias("date"), "measure", "value") \
        .write.mode(mode).csv(path)


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """Local rows -> typed DataFrame (tests and tiny inputs only)."""
    return spark.createDataFrame(rows, schema)


def cached(df: DataFrame) -> DataFrame:
    """Keep a scan for several passes (memory, spilling to disk);
    call ``unpersist()`` after the iterative work."""
    return df.persist()
