import struct

import pytest
from pyspark.sql import functions as F

from trialspark.functions import scalars
from trialspark.operators import timebase
from trialspark.sources.mp4 import parse_timing, read_timing

RUNS = "trial_id string, timescale long, stts array<struct<count:int,delta:long>>"


def runs(spark, timescale, entries):
    return spark.createDataFrame([("a", timescale, entries)], RUNS)


def ticks(spark, timescale, entries):
    return [r.start_tick for r in timebase.frame_times(runs(spark, timescale, entries)).orderBy("frame_index").collect()]


def test_constant_rate(spark):
    assert ticks(spark, 1000, [(4, 100)]) == [0, 100, 200, 300]
    assert timebase.timebase(runs(spark, 1000, [(4, 100)])).first().duration_seconds == 0.4


def test_variable_rate(spark):
    entries = [(2, 512), (1, 1), (1, 1023), (2, 512)]
    assert ticks(spark, 15360, entries) == [0, 512, 1024, 1025, 2048, 2560]
    t = timebase.timebase(runs(spark, 15360, entries)).first()
    assert (t.modal_delta, t.off_modal_frames, t.distinct_deltas, tuple(t.nominal_fps)) == (512, 2, 3, (30, 1))


@pytest.mark.parametrize(("timescale", "entries"), [(1000, []), (0, [(2, 5)])])
def test_bad_timing_fails(spark, timescale, entries):
    with pytest.raises(Exception, match="no frames|timescale"):
        timebase.timebase(runs(spark, timescale, entries)).collect()


def test_frame_at_time(spark):
    times = timebase.frame_times(runs(spark, 1000, [(2, 100), (1, 500), (2, 100)]))
    asked = {0: 0, 150: 1, 250: 2, 690: 2, 700: 3, -5000: 0, 999000: 4}
    wanted = spark.createDataFrame([("a", k) for k in asked], "trial_id string, at long")
    assert {r["at"]: r.frame_index for r in timebase.frame_at_time(times, wanted).collect()} == asked


def test_format_fps(spark):
    d = spark.createDataFrame([(30, 1), (30000, 2002)], "n long, d long").select(scalars.format_fps(scalars.reduce_rational(F.col("n"), F.col("d"))).alias("f"))
    assert [r.f for r in d.collect()] == ["30", "14.985 (15000/1001)"]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(handler=b"vide", runs=((4, 100),), timescale=1000):
    mdhd = box(b"mdhd", struct.pack(">IIII", 0, 0, 0, timescale), b"\0" * 8)
    hdlr = box(b"hdlr", b"\0" * 8, handler, b"\0" * 12)
    stts = box(b"stts", struct.pack(">II", 0, len(runs)), *[struct.pack(">II", *r) for r in runs])
    return box(b"trak", box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", stts))))


def test_mp4_takes_the_video_track():
    data = box(b"ftyp", b"isom") + box(b"moov", movie(b"soun", ((9, 7),), 48000), movie())
    assert parse_timing(data) == (1000, [(4, 100)])
    with pytest.raises(ValueError, match="moov"):
        parse_timing(box(b"ftyp", b"isom"))


def test_unreadable_files_stop_no_other(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(box(b"moov", movie()))
    (tmp_path / "b.mp4").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.name: (r.ok, r.error) for r in read_timing(spark, str(tmp_path)).collect()}
    assert got == {"a.mp4": (True, None), "b.mp4": (False, "no moov box"), "c.txt": (False, "not a video file")}
