"""Stored tables: versions, conflicts, failed writes; joins by sweep and by cells; images."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import edits, investigations
from trialspark.plans.fixture import Trials
from trialspark.sources import images
from trialspark.sources.store import Change, Conflict, Store

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"rois": ["trial_id"], "pins": ["trial_id", "frame"]})


def test_upserts_updates_and_deletes(spark, store):
    assert store.read("rois") is None and store.update("rois", spark.createDataFrame([(1, "x")], "trial_id long, a string")).version == 0
    store.put("rois", spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "trial_id long, a string, b double"))
    store.put("rois", spark.createDataFrame([(2, "B", 2.5), (4, "d", 4.0)], "trial_id long, a string, b double"))
    store.put("pins", spark.createDataFrame([(1, 5), (2, 6), (2, 7)], "trial_id long, frame int"))
    assert rows(store.read("rois")) == [(1, "a", 1.0), (2, "B", 2.5), (3, "c", 3.0), (4, "d", 4.0)]
    store.update("rois", spark.createDataFrame([(3, "z"), (9, "lost")], "trial_id long, a string"))
    assert rows(store.read("rois"))[2:] == [(3, "z", 3.0), (4, "d", 4.0)]
    store.delete(spark.createDataFrame([(2,), (2,), (77,)], "trial_id long"))
    assert rows(store.read("rois")) == [(1, "a", 1.0), (3, "z", 3.0), (4, "d", 4.0)] and rows(store.read("pins")) == [(1, 5)]
    store.put("rois", spark.createDataFrame([(2, "again", 0.0)], "trial_id long, a string, b double"))
    assert len(rows(store.read("rois"))) == 4 and len(rows(store.read("rois", 1))) == 3
    before = rows(store.read("rois"))
    assert store.compact("rois", 2).version == 7 and rows(store.read("rois")) == before
    assert len(store.manifest().folders["rois"]) == 1 and store.clean() == 5 and rows(store.read("rois")) == before


def test_a_write_that_fails_leaves_the_old_version(spark, store):
    store.put("rois", spark.createDataFrame([(1, "a")], "trial_id long, a string"))
    bad = spark.range(3).select(F.col("id").alias("trial_id"), F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("a"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"rois": Change(put=bad), "pins": Change(put=spark.createDataFrame([(1, 1)], "trial_id long, frame int"))})
    assert store.manifest().version == 1 and rows(store.read("rois")) == [(1, "a")] and store.read("pins") is None


def test_the_second_of_two_writers_is_told(spark, store):
    base = store.put("rois", spark.createDataFrame([(1, "a")], "trial_id long, a string"))
    store.put("rois", spark.createDataFrame([(2, "b")], "trial_id long, a string"))
    with pytest.raises(Conflict):
        store.commit({"rois": Change(put=spark.createDataFrame([(3, "c")], "trial_id long, a string"))}, base)
    assert rows(store.read("rois")) == [(1, "a"), (2, "b")]


def test_spans_of_any_kind_cover_frames(spark):
    rng = np.random.RandomState(8)
    frames = [(t, int(i)) for t in range(4) for i in sorted(rng.choice(80, 50, False))]
    spans = [(int(rng.randint(5)), int(a := rng.randint(-5, 85)), int(a + rng.randint(-3, 12))) for _ in range(40)]
    spans += spans[:5]
    d = investigations.covered(spark.createDataFrame(frames, "trial_id long, frame_index long"), spark.createDataFrame(spans, "trial_id long, start_frame long, end_frame long"))
    assert {(r.trial_id, r.frame_index): r.covered for r in d.collect()} == {(t, i): any(s == t and a <= i <= b for s, a, b in spans) for t, i in frames}


def test_given_occlusions_hide_proximity(spark):
    t = Trials(spark, SF)
    frames, rois = t.frames, t.rois
    own = investigations.occlusion_runs(frames)
    cols = ["trial_id", "hole_index", "start_frame", "end_frame", "kind", "ordinal"]
    assert rows(investigations.detect_investigations(frames, rois, occlusions=own).select(*cols)) == rows(investigations.detect_investigations(frames, rois).select(*cols))
    all_of_it = rois.select("trial_id", F.lit(3).cast("long").alias("hole_index"), F.lit(0).cast("long").alias("start_frame"), F.lit(10**6).cast("long").alias("end_frame"))
    assert {r.kind for r in investigations.detect_investigations(frames, rois, occlusions=all_of_it).collect()} == {"occlusion"}


def test_clicks_find_the_nearest_point_of_nine_cells(spark):
    rng = np.random.RandomState(4)
    path = [(t, i, *map(float, rng.randint(-60, 60, 2))) for t in range(3) for i in range(300)] + [(0, 300, None, None)]
    clicks = [(t, c, *map(float, rng.randint(-70, 70, 2) + rng.rand(2).round(1))) for t in range(4) for c in range(60)]
    got = rows(edits.nearest_point(spark.createDataFrame(path, "trial_id long, frame_index long, cx double, cy double"), spark.createDataFrame(clicks, "trial_id long, click long, x double, y double")))
    want = []
    for t, c, x, y in clicks:
        near = [(((px - x) ** 2 + (py - y) ** 2) ** 0.5, i) for s, i, px, py in path if s == t and px is not None]
        if near and min(near)[0] < 14:
            want.append((t, c, min(near)[1], min(near)[0]))
    assert len(got) == len(want) and all(g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, sorted(want), strict=True))


def png(px, kinds=(0, 1, 2, 3, 4), colour=0, depth=8):
    """A PNG whose rows take the filters in turn, packed as the standard says."""
    rows = px.reshape(px.shape[0], -1).astype(np.uint8)
    step = {0: 1, 2: 3, 6: 4}[colour]
    body, above = b"", [0] * rows.shape[1]
    for n, row in enumerate(rows.tolist()):
        kind, left = kinds[n % len(kinds)], lambda i: row[i - step] if i >= step else 0  # noqa: B023
        upper = lambda i: above[i - step] if i >= step else 0  # noqa: B023, E731

        def paeth(a, b, c):
            return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]

        guess = {0: lambda i: 0, 1: left, 2: lambda i: above[i], 3: lambda i: (left(i) + above[i]) // 2, 4: lambda i: paeth(left(i), above[i], upper(i))}[kind]  # noqa: B023
        body += bytes([kind]) + bytes((v - guess(i)) % 256 for i, v in enumerate(row))
        above = row
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], px.shape[0], depth, colour, 0, 0, 0)) + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


def test_images_decode_to_their_pixels():
    px = np.random.RandomState(6).randint(0, 256, (11, 13), np.uint8)
    assert (images.read_pgm(b"P5 # a note\n13 11\n255\n" + px.tobytes()) == px).all()
    assert (images.read_pgm(b"P2\n13 11 255\n" + " ".join(map(str, px.ravel())).encode()) == px).all()
    assert (images.read_pgm(b"P5 13 11 65535\n" + (px.astype(">u2") * 257).tobytes()) == px).all()
    assert (images.read_png(png(px)) == px).all()
    rgb = np.random.RandomState(7).randint(0, 256, (10, 6, 3), np.uint8)
    assert (images.read_png(png(rgb, colour=2)) == (rgb @ [0.299, 0.587, 0.114]).astype(np.uint8)).mean() > 0.98  # sums in another order
    assert (images.read_png(png(np.dstack([rgb, rgb[:, :, :1]]), colour=6)) == images.rgb_to_gray(rgb)).all()
    for bad in (b"", b"P5 2 2 255\nabc", b"\x89PNG\r\n\x1a\n", png(px)[:60]):
        with pytest.raises(ValueError):
            (images.read_png if bad[:1] == b"\x89" else images.read_pgm)(bad)


def test_frames_of_images_are_complete_or_the_job_fails(spark, tmp_path):
    px = np.arange(12, dtype=np.uint8).reshape(3, 4)
    for t in ("a", "b"):
        (tmp_path / t).mkdir()
        for i in (2, 0, 1):
            (tmp_path / t / f"frame-{i:05d}.{'png' if t == 'a' else 'pgm'}").write_bytes(png(px) if t == "a" else b"P5 4 3 255\n" + px.tobytes())
    read = lambda: images.read_images(spark, str(tmp_path))
    expected = lambda *of: spark.createDataFrame(of, "trial_id string, samples long")
    done = images.complete(read(), expected(("a", 3), ("b", 3), ("none", 0)))
    assert rows(done.select("trial_id", "frame_index", "width", "height")) == [(t, i, 4, 3) for t in "ab" for i in range(3)]
    assert all(bytes(r.pixels) == px.tobytes() for r in done.collect())
    for want, why in ((expected(("a", 4), ("b", 3)), "trial a: frame 3 is missing"), (expected(("a", 3), ("b", 2)), "trial b: frame 2 is more than there are"), (expected(("a", 3), ("b", 3), ("c", 1)), "trial c: no frames")):
        with pytest.raises(Exception, match=why):
            images.complete(read(), want).collect()
    (tmp_path / "b" / "frame-00001.pgm").rename(tmp_path / "b" / "frame-00009.pgm")
    with pytest.raises(Exception, match="trial b: frame 1 is missing"):
        images.complete(read()).collect()
    (tmp_path / "b" / "frame-00009.pgm").rename(tmp_path / "b" / "other-00002.pgm")
    with pytest.raises(Exception, match="trial b: frame 1 is missing|frame 2 comes twice"):
        images.complete(read()).collect()
    (tmp_path / "b" / "other-00002.pgm").rename(tmp_path / "b" / "frame-00001.pgm")
    (tmp_path / "a" / "frame-00000.png").write_bytes(b"\x89PNG")
    with pytest.raises(Exception, match="trial a: frame 0 can't be read: not a PNG"):
        images.complete(read()).collect()
