import time

import pytest
from pyspark.sql import functions as F

from trialspark.operators import tracking
from trialspark.plans.fixture import Trials
from trialspark.streaming.frames import read_frames
from trialspark.streaming.incremental import reorder
from trialspark.streaming.progress import TRACKING, Progress, Step, observed, track_in_phases
from trialspark.streaming.tracker import TRACK, track_trials

SF = "/root/testdata/sf0.001"
COLS = ["trial_id", "frame_index", "found", "cx", "cy", "area", "ax", "ay", "bx", "by"]
DETECTION = "trial_id long, frame_index long, found boolean, cx double, cy double, area double, ax double, ay double, bx double, by double"
ROI = "trial_id long, holes array<struct<x:double,y:double>>, hole_radius double, target_hole long"


def run(spark, stream, name, mode="append", **trigger):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    try:
        q.awaitTermination(120) if not trigger else q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_streamed_reordering(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "c"), (1, 2, "again"), (2, 0, "z")], "trial_id long, frame_index long, payload string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run(spark, reorder(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))), "ordered").where(F.col("error").isNull())
    assert [r.payload for r in out.where("trial_id = 1").collect()] == ["a", "b", "c"]


def rings(spark, few):
    """Rings of different places and sizes, one a trial, with and without a target."""
    t = Trials(spark, SF)
    moved = F.transform("holes", lambda h: F.struct((h.x + F.col("trial_id") % 3 * 5).alias("x"), h.y.alias("y")))
    d = t.rois.where(few).withColumn("holes", moved).withColumn("hole_radius", F.col("hole_radius") + F.col("trial_id") % 4 * 3)
    return d.select("trial_id", "holes", "hole_radius", F.when(F.col("trial_id") % 4 != 3, F.col("target_hole")).alias("target_hole"))


def test_streamed_tracks_equal_batch_on_each_trials_own_ring(spark, tmp_path):
    few = "trial_id < 8"
    frames = Trials(spark, SF).detections.select(*COLS).where(few)
    rois = rings(spark, few).persist()
    ends = frames.select("trial_id").distinct().select(F.col("trial_id"), *[F.lit(None).cast(t).alias(c) for c, t in frames.dtypes[1:]])
    parts = [frames.where("frame_index < 11"), frames.where("frame_index between 11 and 12"), frames.where("frame_index > 12"), ends, frames.where("trial_id = 1 and frame_index < 2")]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(spark, track_trials(stream, rois), "tracked").collect()
    want = {tuple(r) for r in tracking.track(frames, rois).collect()}
    assert {tuple(r)[:-1] for r in got if r.error is None} == want and len(want) == frames.count()
    assert {(r.trial_id, r.frame_index, r.error) for r in got if r.error} == {(1, 0, "the trial has ended"), (1, 1, "the trial has ended")}


SHRINK = [(True, 197.0, 100.0, float(a), 192.0, 100.0, 202.0, 100.0) for a in (200, 170, 140, 110, 80)]
GONE = (False, None, None, 0.0, None, None, None, None)


def test_a_trial_that_falls_silent_is_closed_by_its_timer(spark, tmp_path):
    frames = spark.createDataFrame([(5, i, *f) for i, f in enumerate([*SHRINK, GONE, GONE])] + [(6, 0, *SHRINK[0]), (6, 0, *SHRINK[1])], DETECTION)
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    rois = spark.createDataFrame([(5, [(200.0, 100.0), (100.0, 200.0)], 10.0, 0)], ROI)
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    q = track_trials(stream, rois, idle_ms=1500).writeStream.format("memory").queryName("silent").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("silent").where("state = 'IN_ESCAPE_BOX'").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    got = spark.table("silent").orderBy("trial_id", "frame_index").collect()
    assert [r.state for r in got if r.trial_id == 5] == ["TRACKED"] * 5 + ["IN_ESCAPE_BOX"] * 2
    assert {r.error for r in got if r.trial_id == 6} == {"the trial has no ring"}
    assert spark.table("silent").columns == [c.split()[0] for c in TRACK.split(", ")]


def numbered(spark, path, first, last, rows):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for i in range(first, last):
        t = pa.table({"trial_id": pa.array([1] * 7, pa.int64()), "frame_index": pa.array(range(7 * i, 7 * i + 7), pa.int64())})
        pq.write_table(t, path / f"part-{i:05d}.parquet", row_group_size=rows)


def test_frames_come_in_bounded_batches_and_a_restart_repeats_none(spark, tmp_path):
    schema = spark.createDataFrame([], "trial_id long, frame_index int").schema  # narrower than stored
    folder, sizes, got = tmp_path / "in", [], []
    folder.mkdir()

    def keep(df, batch):
        rows = [r.frame_index for r in df.collect()]
        sizes.append(len(rows))
        got.extend(rows)

    def go():
        q = read_frames(spark, str(folder), schema, max_frames=10, tasks=2).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    numbered(spark, folder, 0, 4, 3)
    go()
    assert sorted(got) == list(range(28)) and max(sizes) <= 10
    go()
    assert len(got) == 28
    numbered(spark, folder, 4, 6, 100)
    go()
    assert sorted(got) == list(range(42)) and max(sizes) <= 10


def scenes(spark, n):
    import numpy as np

    rows = []
    for t in range(2):
        for i in range(n):
            img = np.full((40, 50), 180, np.uint8)
            img[10:18, 5 + 2 * i : 17 + 2 * i] = 30
            rows.append((t, i, 50, 40, img.tobytes()))
    return spark.createDataFrame(rows, "trial_id long, frame_index long, width int, height int, pixels binary")


def test_phases_count_every_frame_once(spark, tmp_path):
    frames = scenes(spark, 12)
    frames.write.parquet(str(tmp_path / "frames"))
    frames = spark.read.parquet(str(tmp_path / "frames"))
    rois = spark.createDataFrame([(t, [(25.0, 20.0)], 5.0, 0, 25.0, 20.0, 100.0) for t in range(2)], ROI + ", center_x double, center_y double, platform_radius double")

    def write(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    tracks, steps = track_in_phases(frames, rois, write)
    assert steps == [Step("background", 24, 24), Step("tracking", 24, 24)]
    assert tracks.where("state = 'TRACKED'").count() == 24


def test_progress_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    numbered(spark, folder, 0, 3, 7)
    schema = spark.createDataFrame([], "trial_id long, frame_index long").schema
    seen = []
    listener = Progress(21, seen.append)
    spark.streams.addListener(listener)
    try:
        run(spark, observed(read_frames(spark, str(folder), schema, max_frames=7), TRACKING, "frames"), "counted", processingTime="0 seconds")
        until = time.time() + 20
        while time.time() < until and listener.done.get(TRACKING) != 21:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert seen == [Step(TRACKING, 7 * k, 21) for k in (1, 2, 3)]


@pytest.fixture(autouse=True)
def own_checkpoints(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "checkpoints"))
    yield
    spark.conf.unset("spark.sql.streaming.checkpointLocation")
