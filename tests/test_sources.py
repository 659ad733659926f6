"""S1-S12, P4, P5, Q1 on files written into temp folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import write_png
from trailframe.plans import jobs
from trailframe.sources import frames as FR
from trailframe.sources import text as TX


def _frames(tmp_dir, kinds=("grey", "rgb", "rgba")):
    prefix = os.path.join(tmp_dir, "ants-")
    arrays = {}
    for i, kind in enumerate(kinds, start=1):
        h, w = 6, 8
        base = np.full((h, w), 250, dtype=np.uint8)
        base[1, 2] = 10      # dark pixel at x=2, y=1
        base[4, 7] = 20      # dark pixel at x=7, y=4
        if kind == "grey":
            arr = base
        elif kind == "rgb":
            arr = np.stack([base, base, base], axis=2)
            arr[1, 2] = (30, 0, 0)  # r=30 g=0 b=0 -> v = 245
        else:
            arr = np.dstack([base, base, base, np.full((h, w), 255, np.uint8)])
        write_png(FR.frame_path(prefix, i), arr)
        arrays[i] = arr
    return prefix, arrays


def test_read_frames_and_dark_pixels(spark, tmp_dir):
    prefix, _ = _frames(tmp_dir)
    fr = FR.read_frames(spark, tmp_dir)
    meta = {r.frame: (r.height, r.width, r.nChannels) for r in fr.select("frame", "height", "width", "nChannels").collect()}
    assert meta == {1: (6, 8, 1), 2: (6, 8, 3), 3: (6, 8, 4)}
    px = FR.pixels(fr, 220.0).toPandas().sort_values(["frame", "x", "y"])
    got = [(int(r.frame), r.x, r.y, round(r.v, 6)) for r in px.itertuples()]
    assert got == [(1, 2.0, 1.0, 245.0), (1, 7.0, 4.0, 235.0),
                   (2, 2.0, 1.0, 245.0), (2, 7.0, 4.0, 235.0),
                   (3, 2.0, 1.0, 245.0), (3, 7.0, 4.0, 235.0)]
    assert FR.read_frames(spark, tmp_dir, start=2, stop=3).count() == 1
    assert FR.all_pixels(fr).count() == 3 * 48


def test_extract_detections_job(spark, tmp_dir):
    prefix, _ = _frames(tmp_dir, ("grey", "grey"))
    out = os.path.join(tmp_dir, "det")
    det = jobs.extract_detections(spark, tmp_dir, out_path=out, k=2, passes=3)
    got = sorted((r.frame, r.x, r.y) for r in det.collect())
    assert got == [(1, 2.0, 1.0), (1, 7.0, 4.0), (2, 2.0, 1.0), (2, 7.0, 4.0)]
    back = TX.read_detections(spark, out)
    assert back.count() == 4


def test_range_globs_cover_the_range_and_nothing_else():
    import fnmatch

    for start, stop in [(0, 1), (7, 23), (95, 1210), (123, 124), (0, 10_000), (999_990, 1_000_010), (5, 5)]:
        globs = FR.range_globs(start, stop)
        lo, hi = max(0, start - 50), stop + 50
        for i in range(lo, hi):
            hit = sum(fnmatch.fnmatch(f"{i:07d}", g) for g in globs)
            assert hit == (start <= i < stop), (start, stop, i, globs)


def test_a_range_reads_only_its_files(spark, tmp_dir):
    prefix, _ = _frames(tmp_dir, ("grey",) * 5)
    fr = FR.read_frames(spark, tmp_dir, start=2, stop=4)
    assert sorted(os.path.basename(f) for f in fr.inputFiles()) == ["ants-0000002.png", "ants-0000003.png"]
    assert sorted(r.frame for r in fr.select("frame").collect()) == [2, 3]


def test_skipped_frames_are_reported(spark, tmp_dir):
    prefix, arrays = _frames(tmp_dir, ("grey", "rgb"))
    write_png(os.path.join(tmp_dir, "cover.png"), arrays[1])
    with open(FR.frame_path(prefix, 3), "wb") as f:
        f.write(b"not a picture")
    assert sorted(r.frame for r in FR.read_frames(spark, tmp_dir).collect()) == [1, 2]
    got = {(os.path.basename(r.origin), r.reason) for r in FR.skipped_frames(spark, tmp_dir).collect()}
    assert got == {("cover.png", "no number"), ("ants-0000003.png", "undecodable")}
    with pytest.raises(Exception, match="undecodable frame"):
        FR.read_frames(spark, tmp_dir, on_invalid="error").collect()
    with pytest.raises(Exception, match="undecodable frame"):
        jobs.extract_detections(spark, tmp_dir, k=2, passes=1).collect()
    assert jobs.extract_detections(spark, tmp_dir, k=2, passes=1, on_invalid="drop").count() == 4


def test_detections_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(f, 9, 11, 1, bytearray(rng.integers(0, 60, 99, dtype=np.uint8).tobytes())) for f in range(4)]
    img = spark.createDataFrame(rows, "frame long, height int, width int, nChannels int, data binary")
    a, b = (sorted((r.frame, r.slot, round(r.x, 9), round(r.y, 9)) for r in
                   jobs.detect(img.repartition(n), k=5, passes=3).collect()) for n in (1, 6))
    assert a == b and len(a) == 20


def test_text_lines_keep_frame_numbers(spark, tmp_dir):
    det = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 2.0, 2.0), (3, 0, 4.0, 4.0)],
                                "frame long, slot long, x double, y double")
    out = os.path.join(tmp_dir, "gaps")
    TX.write_center_lines(det, out, fmt="text")
    assert sorted(tuple(r) for r in TX.read_center_lines(spark, out).collect()) == sorted(tuple(r) for r in det.collect())
    with pytest.raises(Exception):
        TX.write_center_lines(det, out, fmt="text")
    with pytest.raises(ValueError):
        TX.write_center_lines(det, out, fmt="text", mode="append")


def test_job_refuses_to_double_its_output(spark, tmp_dir):
    frames = os.path.join(tmp_dir, "frames")
    os.makedirs(frames)
    _frames(frames, ("grey",))
    out = os.path.join(tmp_dir, "det")
    jobs.extract_detections(spark, frames, out_path=out, k=2, passes=1)
    with pytest.raises(Exception):
        jobs.extract_detections(spark, frames, out_path=out, k=2, passes=1)
    jobs.extract_detections(spark, frames, out_path=out, k=2, passes=1, mode="overwrite")
    assert TX.read_detections(spark, out).count() == 2


def test_frame_path():
    assert FR.frame_path("/d/ants-", 1) == "/d/ants-0000001.png"
    assert FR.frame_path("/d/ants-", 123456789) == "/d/ants-3456789.png"


def test_center_lines_parse_and_roundtrip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "lines.txt")
    with open(p, "w") as f:
        f.write("(1.0,2.0);(3.5,1.0E-4)\n(7.0,8.0)\n(9.0,9.5);(1.0,1.0);(2.0,2.0)\n")
    det = TX.read_center_lines(spark, p)
    got = sorted((r.frame, r.slot, r.x, r.y) for r in det.collect())
    assert got == [(0, 0, 1.0, 2.0), (0, 1, 3.5, 1e-4), (1, 0, 7.0, 8.0),
                   (2, 0, 9.0, 9.5), (2, 1, 1.0, 1.0), (2, 2, 2.0, 2.0)]
    out = os.path.join(tmp_dir, "lines-out")
    TX.write_center_lines(det.repartition(3), out, fmt="text", mode="overwrite")
    back = sorted((r.frame, r.slot, r.x, r.y) for r in TX.read_center_lines(spark, out).collect())
    assert back == got
    pq = os.path.join(tmp_dir, "det-pq")
    TX.write_center_lines(det, pq, fmt="parquet", frames_per_folder=2)
    assert sorted(os.listdir(pq))[:2] == ["_SUCCESS", "frame_block=0"] or "frame_block=0" in os.listdir(pq)
    assert TX.read_detections(spark, pq, start=2, frames_per_folder=2).count() == 3
    plan = TX.read_detections(spark, pq, start=2, stop=3, frames_per_folder=2)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(frame_block" in plan and "PushedFilters: [IsNotNull(frame)" in plan


def test_transitions_csv(spark, tmp_dir):
    rows = [(0.1, 0.2, 0.3, 0.4), (1.0, -2.0, 3.0, -4.0)]
    tr = spark.createDataFrame(rows, "x double, y double, next_x double, next_y double")
    xp, yp = os.path.join(tmp_dir, "x"), os.path.join(tmp_dir, "y")
    TX.write_transitions(tr, xp, yp)
    x = sorted(tuple(r) for r in TX.read_transitions(spark, xp).collect())
    y = sorted(tuple(r) for r in TX.read_transitions(spark, yp).collect())
    assert x == [(0.1, 0.2, 0.3), (1.0, -2.0, 3.0)]
    assert y == [(0.1, 0.2, 0.4), (1.0, -2.0, -4.0)]
    mem = TX.transition_schema(memory=4)
    assert [f.name for f in mem.fields] == ["x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4", "n"]


def test_survey_cast_and_drop(spark, tmp_dir):
    p = os.path.join(tmp_dir, "survey.csv")
    with open(p, "w") as f:
        f.write("A,B,C\n1,2,x\n3,,5\n6,7,8\n9, ,10\n")
    raw = TX.read_survey(spark, p)
    assert dict(raw.dtypes) == {"A": "string", "B": "string", "C": "string"}
    typed = TX.cast_columns(raw, ["A", "B"], "int")
    kept = sorted(tuple(r) for r in TX.drop_nulls(typed, ["A", "B"]).collect())
    assert kept == [(1, 2, "x"), (6, 7, "8")]
    allc = TX.drop_nulls(TX.cast_columns(raw, ["A", "B", "C"]), None)
    assert sorted(tuple(r) for r in allc.collect()) == [(6, 7, 8)]


def test_stations_fixed_width(spark, tmp_dir):
    p = os.path.join(tmp_dir, "stations.txt")
    lines = ["ACW00011604  17.1167  -61.7833   10.1    ST JOHNS COOLIDGE FLD",
             "SHORT"]
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    st = TX.read_stations(spark, p).collect()
    assert (st[0].sid, st[0].lat, st[0].lon, st[0].elev, st[0].name) == \
        ("ACW00011604", 17.1167, -61.7833, 10.1, "ST JOHNS COOLIDGE FLD")
    assert st[1].lat is None and st[1].sid == "SHORT"


def test_station_clusters_job(spark, tmp_dir):
    rows = [(f"S{i:010d}", float(i % 7), float(i % 5), 1.0, f"N{i}") for i in range(40)]
    src = spark.createDataFrame(rows, "sid string, lat double, lon double, elev double, name string")
    p = os.path.join(tmp_dir, "st")
    TX.station_lines(src).write.text(p)
    out = jobs.station_clusters(spark, p, k=3, seed=1)
    assert out.columns == ["lon", "lat", "prediction", "r", "g", "b"] and out.count() == 40
    assert {(r.r, r.g, r.b) for r in out.where("prediction = 0").collect()} == {(0, 0, 255)}


def test_daily_dates(spark, tmp_dir):
    p = os.path.join(tmp_dir, "daily.csv")
    with open(p, "w") as f:
        f.write("USC001,20170102,TMAX,12.5\nUSC001,20170103,PRCP,0\n")
    d = TX.read_daily(spark, p).collect()
    assert str(d[0].date) == "2017-01-02" and d[1].value == 0.0


def test_survey_segments_job(spark, tmp_dir):
    p = os.path.join(tmp_dir, "s.csv")
    cols = jobs.SURVEY_COLUMNS
    rnd = np.random.default_rng(0)
    with open(p, "w") as f:
        f.write(",".join(cols) + ",EXTRA\n")
        for i in range(60):
            vals = [str(int(v)) for v in rnd.integers(1, 9, len(cols))]
            if i % 10 == 0:
                vals[2] = ""
            f.write(",".join(vals) + ("," if i % 7 == 0 else ",e") + "\n")
    res = jobs.survey_segments(spark, p, k=3, seed=1)
    assert res["assigned"].count() == 54
    assert res["cost"] >= 0 and len(res["centers"]) == 3
    coded = jobs.survey_segments(spark, p, k=3, seed=1, drop_subset=None)
    assert coded["assigned"].count() < 54


def test_from_rows_and_cached(spark):
    df = TX.from_rows(spark, [(1.0, 2.0)], "x double, y double")
    c = TX.cached(df)
    assert c.is_cached and c.count() == 1
    c.unpersist()
    assert df.select(F.col("x")).first().x == 1.0


def test_scratch_path_under_checkpoint_dir(spark):
    from trailframe.session import ensure_checkpoint_dir

    p = TX.scratch_path(spark, "t")
    assert p.startswith(ensure_checkpoint_dir(spark).rstrip("/"))


@pytest.mark.parametrize("n", [0, 5])
def test_numbered_lines_dense(spark, tmp_dir, n):
    d = os.path.join(tmp_dir, f"nl{n}")
    os.makedirs(d)
    for i in range(3):
        with open(os.path.join(d, f"part-{i:05d}"), "w") as f:
            f.write("".join(f"{i}-{j}\n" for j in range(n + i)))
    got = [(r.line_no, r.value) for r in TX.numbered_lines(spark, d).orderBy("line_no").collect()]
    want = [f"{i}-{j}" for i in range(3) for j in range(n + i)]
    assert [v for _, v in got] == want and [k for k, _ in got] == list(range(len(want)))


def test_small_images_are_unpacked_together(spark, monkeypatch):
    """One array call for a block of images, with any sizes and channels."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, h, w, c, bytearray(rng.integers(0, 256, h * w * c).astype(np.uint8).tobytes()))
            for i, (h, w, c) in enumerate([(1, 4, 3), (2, 3, 3), (0, 5, 3), (3, 2, 1), (1, 1, 4), (5, 7, 3)])]
    df = spark.createDataFrame(rows, "frame long, height int, width int, nChannels int, data binary")
    want = set()
    for i, h, w, c, data in rows:
        v = FR._gray(np.frombuffer(bytes(data), dtype=np.uint8).reshape(h, w, c), c)
        want |= {(i, float(x), float(y), v[y, x]) for y in range(h) for x in range(w) if v[y, x] > 100}
    assert {tuple(r) for r in FR.pixels(df, 100.0).collect()} == want
    calls = []
    monkeypatch.setattr(FR, "_gray", lambda a, c, f=FR._gray: calls.append(c) or f(a, c))
    list(FR._dark_of([r[:4] + (bytes(r[4]),) for r in rows], 100.0))
    assert calls == [1, 3, 4]
