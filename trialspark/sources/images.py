"""Gray frames from image files (PGM, PNG), complete and in order, or not at all.

A file's name holds its frame's number, its folder is its trial. Each image is decoded
in the task that read it; rows that a decoder can't read say why. ``complete`` is part
of the plan: a frame that is missing, repeated or unreadable fails the job by name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..vision.image import rgb_to_gray

_PGM_SPACE = rb"(?:\s|#[^\n]*\n)+"
_PGM = re.compile(rb"P([25])" + _PGM_SPACE + rb"(\d+)" + _PGM_SPACE + rb"(\d+)" + _PGM_SPACE + rb"(\d+)\s")
#: Samples of a pixel by PNG colour type; a palette's index is one.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def read_pgm(data: bytes) -> np.ndarray:
    head = _PGM.match(data)
    if not head:
        raise ValueError("not a PGM image")
    kind, width, height, top = (int(v) for v in head.groups())
    if not 0 < top < 65536 or not width or not height:
        raise ValueError("a PGM image without pixels")
    if kind == 2:
        px = np.array(data[head.end() :].split()[: width * height], np.int64)
    else:
        px = np.frombuffer(data, ">u2" if top > 255 else np.uint8, -1 if top <= 255 else (len(data) - head.end()) // 2, head.end())[: width * height].astype(np.int64)
    if len(px) < width * height:
        raise ValueError("the image is cut off")
    return (px if top == 255 else px * 255 // top).astype(np.uint8).reshape(height, width)


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows (filter, bytes...) of a PNG without their filters; ``step``: bytes a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    above = np.zeros(rows.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), rows, strict=True):
        if kind == 2:
            row += above
        elif kind == 1:  # sums along the row, each of a pixel's bytes by itself
            for b in range(step):
                row[b::step] = np.cumsum(row[b::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            left, upper = [0] * step, [0] * step
            out, up = row.tolist(), above.tolist()
            for i in range(len(out)):
                a, b, c = left[i % step], up[i], upper[i % step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                out[i] = (out[i] + guess) & 255
                left[i % step], upper[i % step] = out[i], b
            row[:] = out
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        above = row
    return rows


def read_png(data: bytes) -> np.ndarray:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, palette, head = 8, b"", None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("the image is cut off")
    width, height, depth, colour, _, _, woven = head
    if woven or colour not in _SAMPLES or (depth < 8 and colour not in (0, 3)):
        raise ValueError("a kind of PNG that is not read (interlaced, or odd samples)")
    samples = _SAMPLES[colour]
    line = (width * samples * depth + 7) // 8
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error as e:
        raise ValueError("the image is cut off") from e
    if len(raw) < height * (line + 1):
        raise ValueError("the image is cut off")
    rows = _unfiltered(raw[: height * (line + 1)].reshape(height, line + 1), max(1, samples * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)[:, :width]
        rows = rows if colour == 3 else (rows.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    elif depth == 16:
        rows = rows[:, ::2]
    px = rows.reshape(height, width, samples)
    if colour == 3:
        if palette is None or px.max(initial=0) >= len(palette):
            raise ValueError("a colour that the palette has not")
        px = palette[px[:, :, 0]]
    return np.ascontiguousarray(px[:, :, 0]) if px.shape[2] < 3 else rgb_to_gray(px[:, :, :3])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """trial_id (the folder's name), frame_index, width, height, pixels, path, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(pgm|png)$"))
    name = F.element_at(F.split("path", "/"), -1)
    known = files.select(F.element_at(F.split("path", "/"), -2).alias("trial_id"), F.regexp_extract(name, r"(\d+)\.\w+$", 1).try_cast("long").alias("frame_index"), "path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pixels, errors = [], [], []
            for index, content in zip(batch.column(1), batch.column(3), strict=True):
                data, image, why = content.as_py(), None, None
                try:
                    if index.as_py() is None:
                        raise ValueError("no frame number in the name")
                    image = read_png(data) if data[:1] == b"\x89" else read_pgm(data)
                except (ValueError, struct.error) as e:
                    why = str(e)
                sizes.append((None, None) if image is None else image.shape)
                pixels.append(None if image is None else image.tobytes())
                errors.append(why)
            made = [pa.array([s[1] for s in sizes], pa.int32()), pa.array([s[0] for s in sizes], pa.int32()), pa.array(pixels, pa.binary()), batch.column(2), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["trial_id", "frame_index", "width", "height", "pixels", "path", "error"])

    return known.mapInArrow(run, "trial_id string, frame_index long, width int, height int, pixels binary, path string, error string")


def complete(frames: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """``frames`` in ascending order by trial, if every trial's numbers run from 0 without
    a gap or a repeat and none has an error; else reading the result fails, and says which
    frame it was. ``expected``: (trial_id, samples) of trials, checked too where given."""
    by = Window.partitionBy("trial_id").orderBy("frame_index")
    c = F.col
    said = lambda *parts: F.concat(F.lit("trial "), c("trial_id").cast("string"), F.lit(": "), *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    want = F.coalesce(F.lag("frame_index").over(by) + 1, F.lit(0))
    d = frames.withColumns({"_want": want, "_next": F.lead("frame_index").over(by)})
    rules = F.when(c("frame_index").isNull(), said("a frame without a number")).when(c("frame_index") < c("_want"), said("frame ", c("frame_index").cast("string"), " comes twice"))
    rules = rules.when(c("frame_index") > c("_want"), said("frame ", c("_want").cast("string"), " is missing"))
    if "error" in frames.columns:
        rules = rules.when(c("error").isNotNull(), said("frame ", c("frame_index").cast("string"), " can't be read: ", c("error")))
    if expected is not None:
        d = expected.select("trial_id", c("samples").alias("_samples")).join(d, "trial_id", "full")
        d = d.where(c("_want").isNotNull() | (c("_samples") > 0))  # a trial without samples has no frames
        short = c("_next").isNull() & (F.coalesce(c("frame_index"), F.lit(-1)) + 1 < c("_samples"))
        rules = F.when(c("frame_index").isNull() & (c("_samples") > 0) & c("_want").isNull(), said("no frames")).otherwise(rules)
        rules = F.coalesce(rules, F.when(short, said("frame ", (c("frame_index") + 1).cast("string"), " is missing")), F.when(c("frame_index") >= c("_samples"), said("frame ", c("frame_index").cast("string"), " is more than there are")))
        d = d.withColumn("_problem", rules).drop("_samples")
    else:
        d = d.withColumn("_problem", rules)
    checked = d.withColumn("frame_index", F.when(c("_problem").isNotNull(), F.raise_error(c("_problem")).cast("long")).otherwise(c("frame_index")))
    return checked.select(*frames.columns)
