import random

import pytest
from pyspark.sql import functions as F

from trialspark.functions.geometry import nearest_hole_within
from trialspark.operators import investigations
from trialspark.plans.fixture import Trials
from trialspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """As for tables that are too large to broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(name)
    spark.catalog.clearCache()
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, usual)
    spark.catalog.clearCache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_exchanged_once(spark, no_broadcast):
    t = Trials(spark, SF)
    text = plan(t.frames)
    assert "InMemoryRelation" in text and "hashpartitioning(trial_id" in text
    assert "SortMergeJoin [trial_id" in text and ", frame_index" not in "".join(x for x in text.split("\n") if "Exchange" in x or "SortMergeJoin" in x)


def test_plans_of_trial_rows_do_not_repeat_each_other(spark):
    for name in ("trial_rows", "custom_formula"):
        assert plan(QUERIES[name](spark, SF)).count("InMemoryRelation") < 200


def test_holes_are_found_in_reach_of_any_region(spark):
    rng = random.Random(5)
    rois, frames = [], []
    for trial in range(12):
        holes = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(rng.choice([0, 1, 2, 9]))]
        rois.append((trial, [*holes, None] if trial % 3 == 0 else holes, rng.uniform(1, 20)))
        at = [(rng.uniform(-80, 80), rng.uniform(-80, 80)) for _ in range(60)] + holes
        frames += [(trial, i, "TRACKED" if i % 7 else "LOST", x, y) for i, (x, y) in enumerate(at)]
    r = spark.createDataFrame(rois, "trial_id long, holes array<struct<x:double,y:double>>, hole_radius double")
    f = spark.createDataFrame(frames, "trial_id long, frame_index long, state string, nx double, ny double")
    got = {(x.trial_id, x.frame_index): x.near for x in investigations.near_holes(f, r).collect()}
    hole = nearest_hole_within(F.col("nx"), F.col("ny"), F.col("holes"), F.col("hole_radius") * 1.5)
    want = {(x.trial_id, x.frame_index): x.near for x in f.join(r, "trial_id").withColumn("near", F.when(F.col("state") == "TRACKED", hole)).collect()}
    assert got == want and len({*want.values()}) > 3
