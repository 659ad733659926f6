"""Incremental Q1: new frames are processed once, restarts resume."""

import os

import numpy as np

from helpers import write_png
from trailframe.sources import frames as FR
from trailframe.sources import text as TX
from trailframe.streaming.frames import extract_detections_stream


def _frame(prefix, i, spots):
    arr = np.full((10, 12), 250, dtype=np.uint8)
    for x, y in spots:
        arr[y, x] = 5
    write_png(FR.frame_path(prefix, i), arr)


def test_stream_appends_each_frame_once(spark, tmp_dir):
    frames = os.path.join(tmp_dir, "frames")
    os.makedirs(frames)
    prefix = os.path.join(frames, "ants-")
    out, ck = os.path.join(tmp_dir, "det"), os.path.join(tmp_dir, "ck")
    _frame(prefix, 1, [(1, 1), (9, 8)])
    _frame(prefix, 2, [(2, 1), (9, 7)])
    q = extract_detections_stream(spark, frames, out, ck, k=2, passes=3, available_now=True)
    q.awaitTermination(120)
    first = sorted((r.frame, r.x, r.y) for r in TX.read_detections(spark, out).collect())
    assert first == [(1, 1.0, 1.0), (1, 9.0, 8.0), (2, 2.0, 1.0), (2, 9.0, 7.0)]
    _frame(prefix, 3, [(3, 3), (8, 8)])
    q = extract_detections_stream(spark, frames, out, ck, k=2, passes=3, available_now=True)
    q.awaitTermination(120)
    got = sorted((r.frame, r.x, r.y) for r in TX.read_detections(spark, out).collect())
    assert got == first + [(3, 3.0, 3.0), (3, 8.0, 8.0)]


def test_rerun_of_a_batch_is_idempotent(spark, tmp_dir):
    from trailframe.operators import clustering as C  # noqa: F401

    frames = os.path.join(tmp_dir, "frames")
    os.makedirs(frames)
    prefix = os.path.join(frames, "ants-")
    _frame(prefix, 1, [(1, 1), (9, 8)])
    out, ck = os.path.join(tmp_dir, "det"), os.path.join(tmp_dir, "ck")
    q = extract_detections_stream(spark, frames, out, ck, k=2, passes=2, available_now=True)
    q.awaitTermination(120)
    # a second query with a fresh checkpoint replays batch 0 into the same folder
    q = extract_detections_stream(spark, frames, out, os.path.join(tmp_dir, "ck2"), k=2, passes=2,
                                  available_now=True)
    q.awaitTermination(120)
    assert TX.read_detections(spark, out).count() == 2
