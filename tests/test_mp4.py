"""The MP4 source and demuxing, against files made by hand."""

import os
import struct

import pytest

from trialspark.operators import demux
from trialspark.plans.movies import box, movie, runs, table, track
from trialspark.sources import files
from trialspark.sources.mp4 import Movie, moov_of, read_mp4

DATA = [bytes([i]) * (5 + i * 7 % 11) for i in range(23)]
DELTAS = [40] * 10 + [45, 40] + [50] * 11
SHIFTS = [0, 80, -40] * 7 + [0, 0]


def samples(spark, path):
    return {r["sample"]: r for r in demux.samples(read_mp4(spark, str(path), "moov")).collect()}


@pytest.mark.parametrize("wide", [False, True])
def test_samples_lie_where_the_file_has_them(spark, tmp_path, wide):
    content = movie(DATA, DELTAS, SHIFTS, [0, 9, 20], wide)
    (tmp_path / "a.mp4").write_bytes(content)
    found = demux.sample_data(demux.samples(read_mp4(spark, str(tmp_path), "moov"))).orderBy("sample").collect()
    assert [bytes(r["data"]) for r in found] == DATA
    assert [content[r.offset : r.offset + r["size"]] for r in found] == DATA
    assert [r.chunk for r in found] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 5 + [4] * 5 + [5] * 4
    assert [r.tick for r in found] == [sum(DELTAS[:i]) for i in range(23)] and [r.delta for r in found] == DELTAS
    shown = [sum(DELTAS[:i]) + SHIFTS[i] for i in range(23)]
    assert [r.composition_tick for r in found] == shown
    assert [r.composition_index for r in found] == [sorted(range(23), key=lambda j: (shown[j], j)).index(i) for i in range(23)]
    assert [r["sample"] for r in found if r.is_key] == [0, 9, 20]
    assert demux.incomplete(demux.samples(read_mp4(spark, str(tmp_path), "moov"))).count() == 0


def test_tables_that_may_be_missing_or_short(spark, tmp_path):
    def put(name, *tables, **of):
        (tmp_path / name).write_bytes(box(b"moov", track(list(tables), **of)))

    stts, stsc, stco = table(b"stts", [(4, 10)], 2), table(b"stsc", [(1, 2, 1)], 3), table(b"stco", [(100,), (200,)], 1)
    put("fixed.mp4", stts, stsc, box(b"stsz", struct.pack(">III", 0, 6, 4)), stco)
    put("nibbles.mp4", stts, stsc, box(b"stz2", struct.pack(">IBBBBI", 0, 0, 0, 0, 4, 3), bytes([0x12, 0x30])), stco)
    put("lost.mp4", table(b"stts", [(3, 10)], 2), table(b"stsc", [(1, 1, 1), (2, 2, 1)], 3), box(b"stsz", struct.pack(">III", 0, 6, 5)), stco)
    put("empty_runs.mp4", table(b"stts", [(0, 5), (2, 10), (0, 7), (2, 20)], 2), stsc, box(b"stsz", struct.pack(">III", 0, 6, 4)), stco, table(b"stss", [], 1))
    got = {}
    for r in demux.samples(read_mp4(spark, str(tmp_path), "moov", files_per_partition=3)).orderBy("path", "sample").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.offset, r["size"], r.tick, r.delta, r.composition_index, r.is_key))
    assert got["fixed.mp4"] == [(100, 6, 0, 10, 0, True), (106, 6, 10, 10, 1, True), (200, 6, 20, 10, 2, True), (206, 6, 30, 10, 3, True)]
    assert [g[:2] for g in got["nibbles.mp4"]] == [(100, 1), (101, 2), (200, 3)]
    assert [g[:4] for g in got["lost.mp4"]] == [(100, 6, 0, 10), (200, 6, 10, 10), (206, 6, 20, 10), (None, 6, None, None), (None, 6, None, None)]
    assert [g[2:4] for g in got["empty_runs.mp4"]] == [(0, 10), (10, 10), (20, 20), (40, 20)]
    lost = demux.incomplete(demux.samples(read_mp4(spark, str(tmp_path / "lost.mp4"), "moov"))).collect()
    assert [r.error for r in lost] == ["2 samples in no chunk, 2 samples without time"]


def test_errors_are_rows(spark, tmp_path):
    good = movie(DATA, DELTAS, SHIFTS, [0])
    cut = box(b"moov", track([box(b"stts", struct.pack(">III", 0, 9, 1))]))
    hevc = box(b"moov", track([table(b"stts", [(1, 5)], 2)], entry=box(b"hvc1", b"\0" * 78)))
    sound = box(b"moov", track([table(b"stts", [(7, 5)], 2)], 8000, b"soun"))
    for name, content in {"good.mp4": good, "cut.mp4": cut, "hevc.mov": hevc, "sound.m4v": sound, "junk.mkv": b"junk", "half.mp4": good[: len(good) // 2], "none.mp4": b"", "a.txt": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.name: r for r in read_mp4(spark, str(tmp_path)).collect()}
    assert {n: (r.error, r.demux_error) for n, r in got.items()} == {
        "good.mp4": (None, None),
        "cut.mp4": ("the table stts is cut off", "no sample sizes"),
        "hevc.mov": (None, "codec hvc1 is not supported: only H.264 with avcC is"),
        "sound.m4v": (None, "no video track"),
        "junk.mkv": ("no moov box",) * 2,
        "half.mp4": ("no moov box",) * 2,
        "none.mp4": ("no moov box",) * 2,
        "a.txt": ("not a video file",) * 2,
    }
    r = got["good.mp4"]
    assert (r.codec, r.width, r.height, bytes(r.description), r.samples, r.timescale) == ("avc1.64001e", 64, 48, b"\x01\x64\x00\x1e\xff", 23, 1000)
    assert [tuple(x) for x in r.stts] == [tuple(x) for x in runs(DELTAS)]
    assert {r.path.rpartition("/")[2] for r in read_mp4(spark, str(tmp_path), "moov").collect()} == {"good.mp4"}
    with pytest.raises(Exception, match="nowhere"):
        read_mp4(spark, str(tmp_path / "nowhere")).collect()


def test_a_file_of_three_gigabytes_costs_its_tables(spark, tmp_path):
    path = tmp_path / "large.mp4"
    with open(path, "wb") as f:
        f.write(struct.pack(">I4sQ", 1, b"mdat", 3 << 30))
        f.truncate(3 << 30)  # a hole: no disk is used
        f.seek(3 << 30)
        f.write(movie(DATA, DELTAS, SHIFTS, [0]))
    asked = []

    def read(at, n):
        asked.append(n)
        return os.pread(fd, n, at)

    fd = os.open(path, os.O_RDONLY)
    try:
        assert Movie(moov_of(read, os.path.getsize(path))).timing()[0] == 1000
    finally:
        os.close(fd)
    assert sum(asked) < 2000
    assert read_mp4(spark, str(path)).first().samples == 23


def test_names_choose_files_before_they_are_opened(spark, tmp_path):
    for n in ("a-1.mp4", "a-2.mp4", "b-1.mp4"):
        (tmp_path / n).write_bytes(movie(DATA, DELTAS, SHIFTS, [0]))
    d = read_mp4(spark, str(tmp_path), names=["a-2.mp4", "c.mp4"])
    assert [r.name for r in d.where("timescale > 0").collect()] == ["a-2.mp4"] and d.rdd.getNumPartitions() == 1
    whole = read_mp4(spark, str(tmp_path))
    assert whole.where("name = 'a-1.mp4'").count() == 1 and whole.count() == 3  # a condition is for its query alone
    assert [p.rpartition("/")[2] for p, _ in files.listed(f"file://{tmp_path}/*-1.mp4")] == ["a-1.mp4", "b-1.mp4"]
    assert read_mp4(spark, f"{tmp_path}/b*", columns="name string, length long").count() == 1
    assert read_mp4(spark, str(tmp_path), files_per_partition=2).rdd.getNumPartitions() == 2


def test_partitions_grow_with_the_samples_not_with_the_files(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"{i}.mp4").write_bytes(movie(DATA, DELTAS, SHIFTS, [0]))
    moov = read_mp4(spark, str(tmp_path), "moov")
    most = 8 * spark.sparkContext.defaultParallelism
    assert moov.rdd.getNumPartitions() <= most and moov.select("path").distinct().count() == 100
    found = demux.samples(moov, expected=30 * demux.SAMPLES)
    assert found.rdd.getNumPartitions() == 30 and found.count() == 2300
