"""Per-trial measures: latency, errors, path, speed, time by quadrant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, pixels_per_cm, quadrant
from .tracking import ESCAPED, OCCLUDED, TRACKED


def error_counts(investigations: DataFrame) -> DataFrame:
    """Distinct holes other than the target, in all and before the first target event."""
    first = investigations.groupBy("trial_id").agg(F.min(F.when(F.col("is_target"), F.col("start_frame"))).alias("target_frame"))
    d = investigations.join(first, "trial_id")
    wrong = F.when(~F.col("is_target"), F.col("hole_index"))
    early = F.when(F.col("target_frame").isNull() | (F.col("start_frame") < F.col("target_frame")), wrong)
    return d.groupBy("trial_id").agg(F.first("target_frame").alias("target_frame"), F.count_distinct(early).alias("primary_errors"), F.count_distinct(wrong).alias("total_errors"))


def _steps(frames: DataFrame) -> DataFrame:
    """``_px`` and ``_dt`` from the frame before, where both are tracked and adjacent."""
    order = Window.partitionBy("trial_id").orderBy("frame_index")
    prev = lambda c: F.lag(c).over(order)
    pair = (F.col("state") == TRACKED) & (prev("state") == TRACKED) & (F.col("frame_index") == prev("frame_index") + 1) & F.col("cx").isNotNull() & prev("cx").isNotNull()
    return frames.withColumn("_px", F.when(pair, distance(F.col("cx"), F.col("cy"), prev("cx"), prev("cy")))).withColumn("_dt", F.when(pair, F.col("t") - prev("t")))


def _placed(frames: DataFrame, rois: DataFrame) -> DataFrame:
    """``_q``: the quadrant of a frame, by its centroid, else its hole (occluded) or
    the target (escaped), else none; ``_per_cm``: the trial's scale."""
    r = rois.select(
        "trial_id", "center_x", "center_y", "holes", "target_hole", pixels_per_cm(F.col("platform_radius"), F.col("platform_diameter_cm")).alias("_per_cm"),
        F.when(F.col("target_hole").isNotNull(), F.get(F.col("holes"), F.col("target_hole").cast("int"))).alias("_target"),
    )
    at = (
        F.when(F.col("cx").isNotNull(), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))
        .when((F.col("state") == OCCLUDED) & F.col("hole_index").isNotNull(), F.get(F.col("holes"), F.col("hole_index").cast("int")))
        .when(F.col("state") == ESCAPED, F.col("_target"))
    )
    d = frames.join(r, "trial_id").withColumn("_at", at)
    q = quadrant(F.col("_at.x"), F.col("_at.y"), F.col("center_x"), F.col("center_y"), F.col("_target.x"), F.col("_target.y"))
    return d.withColumn("_q", F.when(F.col("_at").isNotNull(), q)).drop("holes", "_at", "_target", "center_x", "center_y")


def _path_aggregates() -> list[Column]:
    return [F.coalesce(F.sum("_px"), F.lit(0.0)).alias("path_px"), F.coalesce(F.sum("_dt"), F.lit(0.0)).alias("_moving_s")]


def _path_columns() -> list[Column]:
    cm = F.col("path_px") / F.col("_per_cm")
    return [cm.alias("path_length_cm"), F.when(F.col("_moving_s") > 0, cm / F.nullif(F.col("_moving_s"), F.lit(0.0))).alias("avg_speed_cm_s")]


def _quadrant_aggregates() -> list[Column]:
    known = F.max("target_hole").isNotNull()
    return [
        F.when(known, F.coalesce(F.sum(F.when(F.col("_q") == k, F.col("duration"))), F.lit(0.0))).alias(n)
        for n, k in (("q_target_s", "target"), ("q_opposite_s", "opposite"), ("q_cw_s", "cw"), ("q_ccw_s", "ccw"))
    ]


def path_measures(frames: DataFrame, rois: DataFrame) -> DataFrame:
    """Path length and mean speed over pairs of frames in a row that are both
    tracked; NULL without a scale. ``frames`` needs t, seconds."""
    sums = _steps(frames).groupBy("trial_id").agg(*_path_aggregates())
    scale = rois.select("trial_id", pixels_per_cm(F.col("platform_radius"), F.col("platform_diameter_cm")).alias("_per_cm"))
    return sums.join(scale, "trial_id").select("trial_id", "path_px", *_path_columns())


def quadrant_times(frames: DataFrame, rois: DataFrame) -> DataFrame:
    """Seconds by quadrant; NULL without a target. ``frames`` needs duration."""
    return _placed(frames, rois).groupBy("trial_id").agg(*_quadrant_aggregates())


def trial_measures(frames: DataFrame, rois: DataFrame, investigations: DataFrame) -> DataFrame:
    """One row a trial that has frames and a region: one pass over the frames.

    ``frames``: effective frames with t (seconds from the trial's start) and
    duration. Total latency is the first frame in the escape box; primary latency
    the start of the first target event.
    """
    errors = error_counts(investigations)
    d = _placed(_steps(frames), rois).join(errors, "trial_id", "left")
    out = d.groupBy("trial_id").agg(
        F.min(F.when(F.col("frame_index") == F.col("target_frame"), F.col("t"))).alias("primary_latency_s"),
        F.min(F.when(F.col("state") == ESCAPED, F.col("t"))).alias("total_latency_s"),
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("primary_errors", "total_errors")],
        F.max("_per_cm").alias("_per_cm"), *_path_aggregates(), *_quadrant_aggregates(),
    )
    return out.select("trial_id", "primary_latency_s", "total_latency_s", "primary_errors", "total_errors", *_path_columns(), "q_target_s", "q_opposite_s", "q_cw_s", "q_ccw_s")
