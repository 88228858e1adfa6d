import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trialspark.operators import tracking
from trialspark.streaming.incremental import flush, release
from trialspark.streaming.sequential import close, extend

HOLES = [(200.0, 100.0), (100.0, 200.0)]
DETECTION = "trial_id long, frame_index long, found boolean, cx double, cy double, area double, ax double, ay double, bx double, by double"
ROI = "trial_id long, holes array<struct<x:double,y:double>>, hole_radius double, target_hole long"


def found(x, y, area, ends=None):
    (ax, ay), (bx, by) = ends or ((x - 5.0, y), (x + 5.0, y))
    return (True, *map(float, (x, y, area, ax, ay, bx, by)))


GONE = (False, None, None, 0.0, None, None, None, None)


def both(spark, trials, target=0):
    rows = [(t, i, *f) for t, frames in enumerate(trials) for i, f in enumerate(frames)]
    rois = spark.createDataFrame([(t, HOLES, 10.0, target) for t in range(len(trials))], ROI)
    got = tracking.track(spark.createDataFrame(rows, DETECTION), rois)
    plan = {(r.trial_id, r.frame_index): tuple(r)[1:] for r in got.collect()}
    twin = {}
    for t, frames in enumerate(trials):
        names = [c.split()[0] for c in DETECTION.split(", ")][2:]
        rows, memory = [], {}
        each = [(i, dict(zip(names, f, strict=True))) for i, f in enumerate(frames)]
        for low in range(0, len(each), 7):  # runs may come in parts
            rows += extend(memory, each[low : low + 7], HOLES, 10.0)
        out = close(rows, HOLES, 10.0, target)
        twin |= {(t, r[0]): r for r in out}
    return plan, twin


def states(plan, trial=0):
    return [plan[k][1] for k in sorted(plan) if k[0] == trial]


def test_vanishing_into_a_hole(spark):
    shrink = [found(197, 100, a) for a in (200, 170, 140, 110, 80)] + [GONE, GONE]
    steady = [found(197, 100, 200)] * 4 + [GONE]
    far = [found(150, 150, a) for a in (200, 150, 100, 60)] + [GONE]
    plan, twin = both(spark, [shrink, [*shrink, found(150, 150, 200)], steady, far])
    assert plan == twin
    assert states(plan, 0)[5:] == ["IN_ESCAPE_BOX"] * 2
    assert states(plan, 1)[5:7] == ["OCCLUDED_IN_HOLE"] * 2
    assert states(plan, 2)[-1] == states(plan, 3)[-1] == "LOST"


def test_closing_in_on_a_hole(spark):
    near = [found(150, 150, 200)] + [found(198, 100, a) for a in (190, 150, 110, 70)]
    other = [found(150, 150, 200)] + [found(100, 198, a) for a in (190, 150, 110, 70)]
    plan, twin = both(spark, [near, other])
    assert plan == twin
    assert states(plan, 0) == ["TRACKED"] + ["IN_ESCAPE_BOX"] * 4
    assert states(plan, 1) == ["TRACKED"] + ["OCCLUDED_IN_HOLE"] * 4


def test_nose_keeps_its_end_until_motion_tells(spark):
    ends = ((90.0, 100.0), (110.0, 100.0))
    still = [found(x, 100, 200, ends) for x in (100, 102, 104, 106, 108, 107)]
    back = still + [found(x, 100, 200, ends) for x in range(104, 60, -4)]
    plan, twin = both(spark, [still, back])
    assert plan == twin
    assert plan[0, 5][4] == 110.0 and plan[1, len(back) - 1][4] == 90.0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_window_plan_equals_the_sequential_tracker(spark, seed):
    rng = random.Random(seed)
    trials = []
    for _ in range(25):
        x, y, frames = 195.0, 100.0, []
        for _ in range(40):
            x, y = x + rng.randint(-4, 4), y + rng.randint(-4, 4)
            a = (x + rng.randint(-6, 6), y + rng.randint(-6, 6))
            b = (x + rng.randint(-6, 6), y + rng.randint(-6, 6))
            frames.append(GONE if rng.random() < 0.2 else found(x, y, rng.randint(50, 200), (a, b)))
        trials.append(frames)
    plan, twin = both(spark, trials, target=rng.choice([0, 1]))
    assert plan == twin


def test_release_in_order():
    out, upto = release(held := {}, 0, [(2, "c"), (0, "a"), (1, "b"), (1, "x"), (4, "e"), (4, "y")], window=2)
    assert [o[:2] for o in out if o[2] is None] == [(0, "a"), (1, "b"), (2, "c")] and upto == 3
    assert [o[2] for o in out if o[2]] == ["already passed", "duplicate"]
    assert flush(held) == [(4, "e", None)] and not held


def test_a_full_buffer_takes_the_awaited_frame():
    out, upto = release({}, 0, [(1, "b"), (2, "c"), (0, "a")], window=2)
    assert [o[1] for o in out] == ["a", "b", "c"] and upto == 3
    out, upto = release(held := {5: "", 6: ""}, 0, [(7, "h"), (0, "a")], window=2)
    assert out == [(7, None, "overflow"), (0, "a", None)] and upto == 1 and sorted(held) == [5, 6]
