"""Frame-extraction timing against the reference's only published figure.

The reference reports about 30 s for its similar-size k-means on one
720 x 480 frame (k = 20) and extrapolates about 83 h for 10,000 frames.
This tool writes synthetic frames of that size (20 dark blobs each, PNG via
zlib), then times on ``local[N]``:

* similar-size k-means (k = 20, breakpoint 2.0, tolerance 1.0) on the dark
  pixels of one frame;
* the full extraction job Q1 (image source -> dark pixels -> k-means per
  frame, k = 20, 20 passes) over all frames in one plan.

Usage: python tools/bench_frames.py [n_frames] [cpus]; prints one JSON line.
"""

import json
import os
import sys
import tempfile
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests"))

from helpers import write_png  # noqa: E402


def make_frames(folder: str, n: int, seed: int = 0) -> str:
    from trailframe.sources.frames import frame_path

    rng = np.random.default_rng(seed)
    prefix = os.path.join(folder, "ants-")
    yy, xx = np.mgrid[0:480, 0:720]
    pos = rng.uniform([40, 40], [680, 440], size=(20, 2))
    for i in range(n):
        pos = np.clip(pos + rng.normal(0, 2, pos.shape), [20, 20], [700, 460])
        img = np.full((480, 720, 3), 235, dtype=np.uint8)
        for (cx, cy) in pos:
            m = ((xx - cx) / 8.0) ** 2 + ((yy - cy) / 4.0) ** 2 <= 1.0
            img[m] = (20, 15, 10)
        write_png(frame_path(prefix, i), img)
    return folder


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    from pyspark.sql import functions as F

    from trailframe.operators import clustering as C
    from trailframe.plans import jobs
    from trailframe.session import get_session
    from trailframe.sources import frames as FR

    folder = make_frames(tempfile.mkdtemp(prefix="run-frames-", dir="/tmp"), n)
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    one = FR.pixels(FR.read_frames(spark, folder, 0, 1)).select(
        F.monotonically_increasing_id().alias("id"), "x", "y").persist()
    n_px = one.count()
    t = time.perf_counter()
    res = C.similar_size_kmeans(one, k=20, breakpoint=2.0, tolerance=1.0, seed=7, max_rounds=20, max_iter=50)
    t_one = time.perf_counter() - t
    t = time.perf_counter()
    det = jobs.extract_detections(spark, folder, k=20, passes=20)
    rows = det.count()
    t_all = time.perf_counter() - t
    print(json.dumps({"frames": n, "cpus": cpus, "dark_pixels_frame0": n_px,
                      "similar_size_one_frame_sec": round(t_one, 2), "rounds": res.rounds,
                      "converged": res.converged, "extract_all_frames_sec": round(t_all, 2),
                      "detections": rows, "sec_per_frame": round(t_all / n, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
