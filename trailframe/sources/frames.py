"""Video frames as a DataFrame.

Frames are read with Spark's built-in ``image`` source (decoded on the
executors; one row per file with ``height, width, nChannels, mode, data``,
pixel bytes in B, G, R(, A) order, row-major).  The frame number comes from
the file name.  Pixel unpacking is the one place that needs array code: a
``mapInPandas`` function turns each image into the rows of its dark pixels
with numpy, applying the threshold inside the function so bright pixels
never leave Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.functions.scalar import frame_name
from trailframe.session import ship_package

FRAME_RE = r"(\d+)\.png$"

PIXEL_SCHEMA = "frame long, x double, y double, v double"


def frame_path(prefix: str, i: int) -> str:
    """Path of frame ``i``: ``<prefix>NNNNNNN.png`` (S2 naming)."""
    s = str(int(i))[-7:].rjust(7, "0")
    return f"{prefix}{s}.png"


def range_globs(start: int, stop: int) -> list[str]:
    """Patterns of the 7-digit names of the numbers ``start <= i < stop``:
    shared leading digits, one digit range, free trailing digits.  Their
    number depends on the digits only, never on the size of the range."""
    out = []
    lo, hi = max(0, int(start)), min(int(stop), 10_000_000)
    while lo < hi:
        size = 1
        while size < 1_000_000 and lo % (size * 10) == 0 and lo + size * 10 <= hi:
            size *= 10
        last = lo // size % 10
        top = min(9, last + (hi - lo) // size - 1)
        free = len(str(size)) - 1
        head = f"{lo // size:0{7 - free}d}"[:-1]
        out.append(f"{head}[{last}-{top}]{'?' * free}")
        lo += (top - last + 1) * size
    return out


def read_frames(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None,
                pattern: str = FRAME_RE, on_invalid: str = "drop", padded: bool = True) -> DataFrame:
    """``(frame, origin, height, width, nChannels, mode, data)`` for the
    frames with ``start <= frame < stop``.

    With both ends given and ``padded`` names (S2: seven digits), the range
    becomes a pattern on file names, so other files are listed but neither
    read nor decoded.  Files without a number are left out; a numbered file
    that does not decode is left out (``on_invalid="drop"``, see
    :func:`skipped_frames` for what that was) or stops the job
    (``"error"``)."""
    if on_invalid not in ("drop", "error"):
        raise ValueError("on_invalid must be 'drop' or 'error'")
    df = _decoded(spark, path, start, stop, pattern, padded).where(F.col("frame").isNotNull())
    bad = F.col("height") <= 0
    if on_invalid == "drop":
        return df.where(~bad)
    stop_here = F.raise_error(F.concat(F.lit("undecodable frame: "), F.col("origin"))).cast("int")
    return df.withColumn("height", F.when(bad, stop_here).otherwise(F.col("height")))


def skipped_frames(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None,
                   pattern: str = FRAME_RE, padded: bool = True) -> DataFrame:
    """``(origin, reason)`` of the files that :func:`read_frames` leaves out:
    ``"no number"`` or ``"undecodable"``."""
    df = _decoded(spark, path, start, stop, pattern, padded)
    reason = F.when(F.col("frame").isNull(), "no number").when(F.col("height") <= 0, "undecodable")
    return df.select("origin", reason.alias("reason")).where(F.col("reason").isNotNull())


def _decoded(spark, path, start, stop, pattern, padded) -> DataFrame:
    reader = spark.read.format("image").option("dropInvalid", False)
    if padded and start is not None and stop is not None:
        globs = range_globs(start, stop)
        reader = reader.option("pathGlobFilter", "*{" + ",".join(globs) + "}.png" if globs else "")
    img = reader.load(path)
    number = F.nullif(F.regexp_extract("image.origin", pattern, 1), F.lit(""))
    df = img.select(
        number.try_cast("long").alias("frame"),
        F.col("image.origin").alias("origin"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("nChannels"),
        F.col("image.mode").alias("mode"), F.col("image.data").alias("data"))
    if start is not None:
        df = df.where(F.col("frame").isNull() | (F.col("frame") >= F.lit(int(start))))
    if stop is not None:
        df = df.where(F.col("frame").isNull() | (F.col("frame") < F.lit(int(stop))))
    return df


def _gray(arr: np.ndarray, channels: int) -> np.ndarray:
    """Inverted grey ``255 - (r + g + b) / 3`` of an ``h x w x c`` array
    stored in B, G, R(, A) order; one channel means r = g = b."""
    a = arr.astype(np.float64)
    if channels == 1:
        r = g = b = a[:, :, 0]
    else:
        b, g, r = a[:, :, 0], a[:, :, 1], a[:, :, 2]
    return 255.0 - ((r + g) + b) / 3.0


#: several small frames are worked on together, about this many pixels at a time
FLUSH = 1 << 16


def _dark_of(images: list[tuple], threshold: float) -> Iterator[tuple]:
    """Frame, x, y and grey of the dark pixels of many images, those with as
    many channels laid end to end."""
    for c in sorted({i[3] for i in images}):
        frame, h, w, _, data = zip(*(i for i in images if i[3] == c))
        width = np.array(w)
        size = np.array(h) * width
        if any(len(d) != n * c for d, n in zip(data, size.tolist())):
            raise ValueError("the bytes of an image do not fit its height, width and channels")
        v = _gray(np.frombuffer(b"".join(data), dtype=np.uint8).reshape(1, -1, c), c)[0]
        at = np.flatnonzero(v > threshold)
        end = np.cumsum(size)
        image = np.searchsorted(end, at, side="right")
        place = at - (end - size)[image]
        yield (np.array(frame, dtype=np.int64)[image], (place % width[image]).astype(np.float64),
               (place // width[image]).astype(np.float64), v[at])


def _dark_pixels(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        images: list[tuple] = []
        n = 0
        for pdf in batches:
            for frame, h, w, c, data in zip(pdf["frame"], pdf["height"], pdf["width"],
                                            pdf["nChannels"], pdf["data"]):
                if data is None:
                    continue
                images.append((frame, int(h), int(w), int(c), data))
                n += int(h) * int(w)
                if n >= FLUSH:
                    yield _table(list(_dark_of(images, threshold)))
                    images, n = [], 0
        if images:
            yield _table(list(_dark_of(images, threshold)))
    return run


def _table(held: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("frame", "x", "y", "v"), (np.concatenate(c) for c in zip(*held)))))


def pixels(frames: DataFrame, threshold: float = 220.0) -> DataFrame:
    """S3 + P1-P3: ``(frame, x, y, v)`` of the pixels with inverted grey
    ``v > threshold`` (x = column, y = row)."""
    ship_package(frames.sparkSession)
    cols = frames.select("frame", "height", "width", "nChannels", "data")
    return cols.mapInPandas(_dark_pixels(float(threshold)), PIXEL_SCHEMA)


def with_pixel_id(px: DataFrame) -> DataFrame:
    """``(frame, x, y, pid)``: a pixel's id is its place in the frame
    (``y * 2**24 + x``), so starting points picked by a hash of it do not
    depend on how the rows are partitioned."""
    return px.select("frame", "x", "y",
                     (F.col("y").cast("long") * F.lit(1 << 24) + F.col("x").cast("long")).alias("pid"))


def all_pixels(frames: DataFrame) -> DataFrame:
    """S3 without a threshold (every pixel); mostly for tests."""
    return pixels(frames, threshold=-1.0)


def frame_names(df: DataFrame, col: str = "frame") -> DataFrame:
    return df.withColumn("name", frame_name(col))
