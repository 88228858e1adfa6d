import math

import pytest
from pyspark.sql import functions as F

from trialspark.functions.formula import Formula, FormulaError, formula_column
from trialspark.operators import investigations, measures, occupancy, overlays, report, roi, stats, strategy

FRAMES = "trial_id long, frame_index long, state string, cx double, cy double, nx double, ny double, area double, hole_index long, t double, duration double"
ROI = "trial_id long, center_x double, center_y double, platform_radius double, holes array<struct<x:double,y:double>>, target_hole long, platform_diameter_cm double, hole_radius double"
COMPASS = [(100.0, 0.0), (0.0, 100.0), (-100.0, 0.0), (0.0, -100.0)]


def frames(spark, rows, rate=30):
    """rows: (state, x, hole) or (state, x, y, hole) at frames 0, 1, ...; None skips one."""
    out = []
    for i, r in enumerate(rows):
        if r is not None:
            state, x, *rest = r
            y, hole = (rest if len(rest) == 2 else (100.0, rest[0]))
            x = None if x is None else float(x)
            y = None if x is None else float(y)
            out.append((1, i, state, x, y, x, y, 100.0, hole, i / rate, 1 / rate))
    return spark.createDataFrame(out, FRAMES)


def region(spark, holes=COMPASS, target=0, diameter=20.0, center=(0.0, 0.0), radius=10.0):
    return spark.createDataFrame([(1, *center, 100.0, holes, target, diameter, radius)], ROI)


T, L, O, E = "TRACKED", "LOST", "OCCLUDED_IN_HOLE", "IN_ESCAPE_BOX"
TWO = [(100.0, 100.0), (300.0, 100.0)]


def events(spark, rows, **kw):
    d = investigations.detect_investigations(frames(spark, rows), region(spark, TWO, 1, center=(200.0, 100.0), **kw))
    return [(r.hole_index, r.start_frame, r.end_frame, r.kind, r.is_target) for r in d.orderBy("ordinal").collect()]


def test_proximity_events(spark):
    assert events(spark, [(T, 200, None), (T, 105, None), (T, 103, None), (T, 104, None)]) == [(0, 1, 3, "proximity", False)]
    assert events(spark, [(T, 105, None), (T, 103, None), (L, None, None), (T, 104, None)]) == []
    # a missing frame doesn't break a run, and its length counts indices
    assert events(spark, [(T, 105, None), None, (T, 104, None)]) == [(0, 0, 2, "proximity", False)]


def test_occlusion_events(spark):
    rows = [(O, None, 0), (O, None, 0), (O, None, 1), (O, None, 1)]
    assert events(spark, rows) == [(0, 0, 1, "occlusion", False), (1, 2, 3, "occlusion", True)]
    # an occlusion lasts until the next row
    assert events(spark, [(O, None, 0), None, None, (T, 200, None)])[0][:3] == (0, 0, 2)
    assert events(spark, [(E, None, 1)]) == []


def test_path(spark):
    walk = [(T, 0, 0.0, None), (T, 10, 0.0, None), (T, 20, 0.0, None)]
    p = measures.path_measures(frames(spark, walk), region(spark)).first()
    assert p.path_length_cm == pytest.approx(2) and p.avg_speed_cm_s == pytest.approx(2 / (2 / 30))
    p = measures.path_measures(frames(spark, [walk[0], walk[1], None, walk[2]]), region(spark)).first()
    assert p.path_length_cm == pytest.approx(1)
    p = measures.path_measures(frames(spark, [walk[0], (L, None, None), walk[1]]), region(spark)).first()
    assert p.path_length_cm == 0 and p.avg_speed_cm_s is None
    assert measures.path_measures(frames(spark, walk), region(spark, diameter=None)).first().path_length_cm is None


def test_quadrants(spark):
    rows = [(T, x, y, None) for x, y in COMPASS] + [(L, None, None), (E, None, None), (O, None, 2)]
    q = measures.quadrant_times(frames(spark, rows), region(spark)).first()
    assert [round(v * 30) for v in (q.q_target_s, q.q_cw_s, q.q_opposite_s, q.q_ccw_s)] == [2, 1, 2, 1]
    assert measures.quadrant_times(frames(spark, rows), region(spark, target=None)).first().q_target_s is None


EVENTS = "trial_id long, hole_index long, is_target boolean, start_frame long, end_frame long, kind string, ordinal long"


def listed(spark, holes, target=0, step=2):
    return spark.createDataFrame([(1, h, h == target, i * step, i * step + 1, "proximity", i) for i, h in enumerate(holes)], EVENTS)


def test_errors_and_latency(spark):
    d = measures.trial_measures(frames(spark, [(T, 0, 0.0, None)] * 12), region(spark), listed(spark, [2, 2, 0, 1])).first()
    assert (d.primary_errors, d.total_errors) == (1, 2)
    assert d.primary_latency_s == pytest.approx(4 / 30) and d.total_latency_s is None


def test_visits(spark):
    v = lambda holes: [r.visit for r in overlays.visits(listed(spark, holes)).orderBy("ordinal").collect()]
    assert v([2, 2, 2, 10, 10]) == [1, 1, 1, 2, 2]
    assert v([2, 10, 2]) == [1, 2, 3]


def test_correction_overlay(spark):
    tracks = frames(spark, [(T, 1, 1.0, None), (L, None, None)]).drop("t", "duration")
    fix = spark.createDataFrame([(1, 1, 99.0, 88.0, None, None)], "trial_id long, frame_index long, cx double, cy double, nx double, ny double")
    got = {r.frame_index: (r.nx, r.ny, r.is_corrected) for r in overlays.apply_corrections(tracks, fix).collect()}
    assert got == {0: (1.0, 1.0, False), 1: (99.0, 88.0, True)}


RING = [(100 * math.cos(i * math.pi / 4), 100 * math.sin(i * math.pi / 4)) for i in range(8)]


def test_strategies(spark):
    r = region(spark, RING)
    straight = frames(spark, [(T, x, 0.0, None) for x in range(0, 101, 10)])
    assert strategy.classify(straight, r, listed(spark, [0]).withColumn("start_frame", F.lit(10).cast("long"))).first().label == "spatial"
    loop = frames(spark, [(T, x, y, None) for x, y in RING * 2])
    serial = strategy.classify(loop, r, listed(spark, [3, 4, 5, 6, 7, 0])).first()
    assert (serial.label, serial.order_score) == ("serial", 1.0)
    assert strategy.classify(loop, r, listed(spark, [3, 5, 2, 6, 1, 0])).first().label == "random"
    assert strategy.classify(frames(spark, [(L, None, None)]), r, listed(spark, [0])).count() == 0
    assert strategy.classify(loop, region(spark, RING, None), listed(spark, [1], None)).count() == 0


def test_occupancy(spark):
    rows = [(T, 1, 1.0, None), (T, 199, 199.0, None), (T, 198, 199.0, None), (T, 500, 100.0, None), (L, None, None)]
    got = {(r.row, r.col): (r["count"], r.max_count) for r in occupancy.occupancy(frames(spark, rows), region(spark, center=(100.0, 100.0)), 10).collect()}
    assert got == {(0, 0): (1, 2), (9, 9): (2, 2)}


def test_longest_lost_run(spark):
    rows = [(L, None, None), (T, 0, None), *[(L, None, None)] * 3, (T, 0, None)]
    q = report.quality_rows(frames(spark, rows)).first()
    assert (q.longestLostRunFrames, q.longestLostRunStartSeconds, q.lostPercent) == (3, round(2 / 30, 3), 66.7)


def groups(spark, a, b):
    return spark.createDataFrame([("A", float(x)) for x in a] + [("B", float(x)) for x in b], "g string, v double")


def test_mann_whitney(spark):
    m = stats.mann_whitney(groups(spark, [1, 2, 3], [4, 5, 6]), "g", "v").first()
    assert m.u == 0 and m.small_sample
    m = stats.mann_whitney(groups(spark, [1, 2, 3], [1, 2, 3]), "g", "v").first()
    assert m.u == 4.5 and m.p > 0.5
    m = stats.mann_whitney(groups(spark, [], [1, 2]), "g", "v").first()
    assert math.isnan(m.u) and m.z is None and m.p is None


def test_formula(spark):
    one = spark.createDataFrame([(0.0, 3.0, None)], "x double, y double, n double")
    value = lambda f: one.select(formula_column(f, ["x", "y", "n"]).alias("v")).first().v
    assert (value("2 + 3 * 4"), value("10 - 2 - 3"), value("-(y - 1) * 2"), value("8 / 2 / 2")) == (14, 5, -4, 2)
    assert value("1 / x") is None and value("n + 1") is None
    for bad in ("", "2 3", "(2 + 3", "2 $ 3", "1.2.3", "1e5x +"):
        with pytest.raises(FormulaError):
            Formula(bad)
    with pytest.raises(FormulaError, match="Unknown: z"):
        formula_column("z + 1", ["x"])


def test_roi_edits(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 120.0, 100.0, 0.0, 4, 10.0, "manual")], "trial_id long, center_x double, center_y double, platform_radius double, ring_radius double, rotation double, hole_count int, hole_radius double, source string")
    r = roi.set_target(roi.nudge_hole(roi.create(p), 2, -90.0, 5.0), 1)
    got = r.first()
    assert got.nudged_holes == [2] and tuple(got.holes[2]) == (-90.0, 5.0) and got.target_hole == 1
    assert roi.scale_ring(r, 2).first().holes[0].x == 200 and roi.scale_ring(r, 0) is r
    assert roi.regenerate_ring(r).first().nudged_holes == []
    assert not roi.completeness(r).first().is_complete and roi.completeness(roi.set_diameter(r, 92.0)).first().is_complete
    with pytest.raises(Exception, match="no such hole"):
        roi.nudge_hole(r, 9, 0, 0).collect()


def test_latest_wins_and_tombstones(spark):
    log = spark.createDataFrame([(1, "a", 1, 1, False), (1, "b", 2, 2, False), (2, "c", 1, 3, False), (2, "d", 2, 4, True)], "trial_id long, v string, updated_at long, seq long, deleted boolean")
    assert [(r.trial_id, r.v) for r in overlays.latest(log, ["trial_id"]).collect()] == [(1, "b")]
    assert {(r.trial_id, r.v) for r in overlays.at_version(log, ["trial_id"], 3).collect()} == {(1, "b"), (2, "c")}
