"""Frame operators: background model and detection over tables of gray frames.

Frames: trial_id, frame_index, width, height, pixels (row-major bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..params import DetectionParams, TrackerParams
from . import image

DETECTION = (
    "found boolean, cx double, cy double, area double, orientation double, ax double, ay double, bx double, by double, "
    "threshold double, candidate_count int, runner_up_area double"
)


class Detector(Protocol):
    """A detection backend: one dict with the fields of DETECTION for a frame."""

    def detect(self, frame: np.ndarray, background: np.ndarray, mask: np.ndarray | None) -> dict: ...


class DifferenceDetector:
    """The largest blob of plausible size that differs from the background."""

    def __init__(self, params: DetectionParams = DetectionParams()):
        self.params = params

    def detect(self, frame: np.ndarray, background: np.ndarray, mask: np.ndarray | None = None) -> dict:
        p = self.params
        diff = image.abs_diff(frame, background)
        if mask is not None:
            diff = image.apply_mask(diff, mask)
        threshold = p.fixed_threshold if p.mode == "fixed" else max(p.min_threshold, image.otsu_threshold(diff, mask))
        labels, found = image.components(image.open_mask(image.binarize(diff, threshold, mask), p.open_radius))
        fit = [c for c in found if p.min_area <= c.area <= p.max_area]
        out = {"found": bool(fit), "threshold": float(threshold), "candidate_count": len(fit), "runner_up_area": float(fit[1].area) if len(fit) > 1 else 0.0, "area": 0.0}
        if fit:
            (ax, ay), (bx, by) = image.axis_endpoints(labels, fit[0])
            out |= {"cx": fit[0].cx, "cy": fit[0].cy, "area": float(fit[0].area), "orientation": fit[0].orientation, "ax": float(ax), "ay": float(ay), "bx": float(bx), "by": float(by)}
        return out


def sample_indices(n: int, k: int = 30) -> list[int]:
    """k frame numbers spread over n, rounded half up, each once."""
    if k <= 1 or n <= 1:
        return [0] if n else []
    return sorted({int(np.floor(i * (n - 1) / (k - 1) + 0.5)) for i in range(k)})


def sampled_frames(frames: DataFrame, k: int = 30, seen: DataFrame | None = None) -> DataFrame:
    """The frames of each trial's sample: a semi-join of computed numbers, k a trial.
    ``seen``: the same frames, where their reading is to be observed. Frames whose pixels
    are costly to come by are chosen by their numbers alone, before the pixels are made."""
    n = F.max("frame_index") + 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (k - 1) + 0.5).cast("long"))
    wanted = frames.groupBy("trial_id").agg(n.alias("n")).select("trial_id", F.explode(F.array_distinct(spread)).alias("frame_index"))
    return (frames if seen is None else seen).join(wanted, ["trial_id", "frame_index"], "left_semi")


def backgrounds(frames: DataFrame, k: int = 30, seen: DataFrame | None = None) -> DataFrame:
    """(trial_id, width, height, background): the upper median of at most k frames."""
    return medians(sampled_frames(frames, k, seen))


def medians(sampled: DataFrame) -> DataFrame:
    """Backgrounds of the frames given, few a trial."""

    def median(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack([np.frombuffer(p, np.uint8) for p in pdf.pixels])
        first = pdf.iloc[0]
        return pd.DataFrame({"trial_id": [first.trial_id], "width": [first.width], "height": [first.height], "background": [image.upper_median(stack).tobytes()]})

    id_type = dict(sampled.dtypes)["trial_id"]
    return sampled.groupBy("trial_id").applyInPandas(median, f"trial_id {id_type}, width int, height int, background binary")


#: Frames of a trial that one task detects in a row; each such block gets the trial's
#: background once.
BLOCK = 4096


def _laid_out(frames: DataFrame, background: DataFrame, rois: DataFrame | None, index: DataFrame | None) -> DataFrame:
    """Frames by blocks of a trial, each block's background (and region) before them.

    There are as many partitions as the frames make blocks. Pixels may shrink a hundred
    times on their way, so sizes of the exchange don't tell what a task has to hold."""
    index = frames if index is None else index
    parts = max(index.count() // BLOCK + 1, int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = F.floor(F.col("frame_index") / BLOCK).cast("long").alias("_block")
    region = ("center_x", "center_y", "platform_radius")
    plain = frames.select("trial_id", block, F.col("frame_index").cast("long").alias("frame_index"), "width", "height", "pixels", *[F.lit(None).cast("double").alias(c) for c in region])
    heads = index.select("trial_id", block).distinct().join(background.select("trial_id", "width", "height", "background"), "trial_id")
    if rois is not None:
        heads = heads.join(rois.select("trial_id", *region), "trial_id", "left")
    else:
        heads = heads.withColumns({c: F.lit(None) for c in region})
    heads = heads.select("trial_id", "_block", F.lit(-1).cast("long").alias("frame_index"), "width", "height", F.col("background").alias("pixels"), *[F.col(c).cast("double").alias(c) for c in region])
    return plain.unionByName(heads).repartition(parts, "trial_id", "_block").sortWithinPartitions("trial_id", "_block", "frame_index")


def detect(frames: DataFrame, background: DataFrame, rois: DataFrame | None = None, detector: Detector | None = None, index: DataFrame | None = None) -> DataFrame:
    """Detections of all frames of trials that have a background. With ``rois``, only
    inside the platform. ``index``: trial_id and frame_index of the same frames, where
    they are known without the pixels.

    Frames go by trial, in blocks, to a task that reads them as a stream: a block's
    background comes once, before its frames, and its mask is made once. A trial of any
    length is spread over tasks by its blocks, and a task holds one Arrow batch.
    """
    backend = detector or DifferenceDetector()
    fields = [x.split()[0] for x in DETECTION.split(", ")]
    schema = StructType([frames.schema["trial_id"], *StructType.fromDDL(f"frame_index long, {DETECTION}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        ground, mask = np.zeros((0, 0), np.uint8), None
        for batch in batches:
            trial, block, index, width, height = (batch.column(i).to_pylist() for i in range(5))
            px, *region = (batch.column(i) for i in range(5, 9))
            rows, found = [], []
            for i in range(batch.num_rows):
                shape = (height[i], width[i])
                image_of = np.frombuffer(px[i].as_buffer(), np.uint8).reshape(shape)
                if index[i] == -1:
                    key, ground = (trial[i], block[i]), image_of.copy()
                    x, y, r = (c[i].as_py() for c in region)
                    mask = None if r is None else image.circle_mask(shape[1], shape[0], x, y, r)
                elif key == (trial[i], block[i]):
                    rows.append(i)
                    found.append(backend.detect(image_of, ground, mask))
            kept = batch.select([0, 2]).take(pa.array(rows, pa.int64()))
            columns = [pa.array([f.get(c) for f in found], to_arrow_type(schema[c].dataType)) for c in fields]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], schema.fieldNames())

    return _laid_out(frames, background, rois, index).mapInArrow(run, schema)


def track_frames(frames: DataFrame, rois: DataFrame, params: TrackerParams = TrackerParams(), detector: Detector | None = None) -> DataFrame:
    """Frames to tracks: background, detection, then the window plan."""
    from ..operators.tracking import track

    return track(detect(frames, backgrounds(frames), rois, detector), rois, params)


def histogram(frames: DataFrame) -> DataFrame:
    """(trial_id, frame_index, value, n): pixels by value, for thresholds in SQL. Frames
    are counted in Arrow batches; a frame makes 256 rows at most."""
    schema = StructType([frames.schema["trial_id"], frames.schema["frame_index"], *StructType.fromDDL("value int, n long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values, counts = [], [], []
            for i, px in enumerate(batch.column(2)):
                n = np.bincount(np.frombuffer(px.as_buffer(), np.uint8), minlength=256)
                at = np.flatnonzero(n)
                rows += [i] * len(at)
                values.append(at)
                counts.append(n[at])
            if rows:
                kept = batch.select([0, 1]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(values), pa.int32()), pa.array(np.concatenate(counts), pa.int64())], schema.fieldNames())

    return frames.where("pixels is not null").select("trial_id", "frame_index", "pixels").mapInArrow(run, schema)


def otsu(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Otsu's threshold of each group of (keys, value, n) as windows and aggregates."""
    from pyspark.sql import Window

    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    vn = F.col("value") * F.col("n")
    d = counts.select(*keys, "value", F.sum("n").over(upto).cast("double").alias("w"), F.sum("n").over(whole).cast("double").alias("total"), F.sum(vn).over(upto).cast("double").alias("s"), F.sum(vn).over(whole).cast("double").alias("all"))
    above = F.col("total") - F.col("w")
    gap = F.try_divide(F.col("s"), F.col("w")) - F.try_divide(F.col("all") - F.col("s"), above)
    d = d.withColumn("variance", F.when(above > 0, F.col("w") * above * gap * gap))
    top = d.groupBy(*keys).agg(F.max(F.when(F.col("variance").isNotNull(), F.struct("variance", (-F.col("value")).alias("neg")))).alias("top"))
    return top.select(*keys, F.coalesce(-F.col("top.neg"), F.lit(0)).cast("int").alias("threshold"))
