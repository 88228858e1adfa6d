import zipfile

import numpy as np
import pytest

from trialspark.sources import sinks
from trialspark.vision import detect, image, maze


def naive(mask, r, op):
    h, w = mask.shape
    at = lambda y, x: 0 <= y < h and 0 <= x < w and mask[y, x]
    return np.array([[op(at(y + j, x + i) for j in range(-r, r + 1) for i in range(-r, r + 1)) for x in range(w)] for y in range(h)])


def test_morphology_equals_brute_force():
    mask = np.random.RandomState(12345).random_sample((17, 23)) < 0.6
    assert (image.erode(mask, 2) == naive(mask, 2, all)).all()
    assert (image.dilate(mask, 2) == naive(mask, 2, any)).all()


def test_components_equal_flood_fill():
    mask = np.random.RandomState(7).random_sample((40, 50)) < 0.45
    labels, n = image.label_components(mask)
    seen, count = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 40 and 0 <= b < 50 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = count
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == count and (labels == seen).all()


def scene(x=None, y=20):
    img = np.full((60, 60), 180, np.uint8)
    img[5:9, 5:9] = 30
    if x is not None:
        img[y : y + 6, x : x + 10] = 25
    return img


def test_detects_the_animal():
    got = detect.DifferenceDetector(detect.DetectionParams(min_area=20)).detect(scene(25), scene(), None)
    assert got["found"] and (got["cx"], got["cy"], got["candidate_count"]) == (29.5, 22.5, 1)
    assert not detect.DifferenceDetector().detect(scene(), scene(), None)["found"]


def test_upper_median_and_samples():
    stack = np.array([[[1]], [[2]], [[3]], [[4]]], np.uint8)
    assert image.upper_median(stack)[0, 0] == 3
    assert detect.sample_indices(5, 30) == [0, 1, 2, 3, 4] and detect.sample_indices(100, 3) == [0, 50, 99]


def test_otsu_splits_and_handles_one_class():
    assert image.otsu_threshold(np.array([[10, 10, 200, 200]], np.uint8)) == 10
    assert image.otsu_threshold(np.full((2, 2), 7, np.uint8)) == 0


def test_maze():
    y, x = np.mgrid[:240, :320]
    img = np.where((x - 160) ** 2 + (y - 120) ** 2 <= 10_000, 190, 40).astype(np.uint8)
    for k in range(20):
        a = 0.1 + k * 2 * np.pi / 20
        img[(x - 160 - 82 * np.cos(a)) ** 2 + (y - 120 - 82 * np.sin(a)) ** 2 <= 25] = 55
    got = maze.detect_maze(img)
    assert got["ok"] and (got["hole_count"], got["matched_holes"]) == (20, 20)
    assert got["rotation"] % (2 * np.pi / 20) == pytest.approx(0.1, abs=0.01)
    assert not maze.detect_maze(np.zeros((50, 50), np.uint8))["ok"]


def test_ring_counts():
    a = 0.1 + np.arange(20) * 2 * np.pi / 20
    assert maze.estimate_ring(a)[0] == maze.estimate_ring(np.append(a, a[3] + 0.02))[0] == maze.estimate_ring(np.delete(a, [2, 9, 15]))[0] == 20
    assert maze.estimate_ring(np.array([0.0, 0.1, 0.15, 3.0, 3.05]))[0] == 20


def test_frames_to_detections_and_otsu_in_sql(spark):
    rows = [(1, i, 60, 60, scene(10 + 4 * i if i % 3 else None).tobytes()) for i in range(9)]
    frames = spark.createDataFrame([(a, b, c, d, bytearray(p)) for a, b, c, d, p in rows], "trial_id long, frame_index long, width int, height int, pixels binary")
    got = {r.frame_index: r.found for r in detect.detect(frames, detect.backgrounds(frames), detector=detect.DifferenceDetector(detect.DetectionParams(min_area=20))).collect()}
    assert got == {i: bool(i % 3) for i in range(9)}
    own = {r.frame_index: r.threshold for r in detect.otsu(detect.histogram(frames), ["trial_id", "frame_index"]).collect()}
    assert own == {i: image.otsu_threshold(np.frombuffer(p, np.uint8).reshape(60, 60)) for _, i, _, _, p in rows}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", None, True), ("b<", 1.5, False)], "n string, v double, ok boolean")
    sinks.write_csv(d, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ["n,v,ok", "a,,TRUE", "b<,1.5,FALSE"]
    sinks.write_workbook({"One": d, "Two": d}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert "b&lt;" in z.read("xl/worksheets/sheet2.xml").decode()
    assert "<rect" in sinks.bar_chart_svg([("a", 1.0)])


def test_every_event_is_drawn_and_detected(spark):
    from trialspark.plans.fixture import Trials
    from trialspark.plans.registry import detect_frames

    sf = "/root/testdata/sf0.001"
    drawn = Trials(spark, sf).detections.select("trial_id", "frame_index", "found", "cx", "cy").collect()
    want = {(r.trial_id, r.frame_index): (True, int(r.cx) % 120 + 21.5, int(r.cy) % 80 + 18.5, 112.0) if r.found else (False, None, None, 0.0) for r in drawn}
    got = {(r.trial_id, r.frame_index): (r.found, r.cx, r.cy, r.area) for r in detect_frames(spark, sf).collect()}
    assert got == want and len(want) == 1000


def test_detected_frames_equal_the_sql(spark):
    import duckdb

    from trialspark.plans.registry import SQL, detect_frames

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = set(con.execute(SQL["detect_frames"]).fetchall())
    rows = detect_frames(spark, sf).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
