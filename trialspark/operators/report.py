"""Rows of the reports and the data behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import formula_column
from ..functions.scalars import format_fps, percent, tool_version
from ..params import InvestigationParams
from .overlays import visits
from .tracking import ESCAPED, LOST, OCCLUDED, TRACKED


def longest_lost_runs(frames: DataFrame) -> DataFrame:
    """Length and first frame of each trial's longest run of lost rows; the first
    of equals."""
    order = Window.partitionBy("trial_id").orderBy("frame_index")
    lost = F.col("state") == LOST
    run = F.sum((~lost).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = frames.select("trial_id", "frame_index", lost.alias("lost"), run.alias("run")).where("lost").groupBy("trial_id", "run").agg(F.count("*").alias("n"), F.min("frame_index").alias("start"))
    top = runs.groupBy("trial_id").agg(F.max(F.struct("n", (-F.col("start")).alias("neg"))).alias("top"))
    return top.select("trial_id", F.col("top.n").alias("longest_lost"), (-F.col("top.neg")).alias("lost_start"))


def quality_rows(frames: DataFrame) -> DataFrame:
    """``frames`` needs t."""
    states = ((TRACKED, "tracked"), (LOST, "lost"), (OCCLUDED, "occludedInHole"), (ESCAPED, "inEscapeBox"))
    counts = frames.groupBy("trial_id").agg(F.count("*").alias("frameCount"), *[F.count_if(F.col("state") == s).alias(f"{n}Frames") for s, n in states])
    at = frames.select("trial_id", F.col("frame_index").alias("lost_start"), "t")
    runs = longest_lost_runs(frames).join(at, ["trial_id", "lost_start"], "left")
    d = counts.join(runs, "trial_id", "left")
    cols = [x for _, n in states for x in (F.col(f"{n}Frames"), percent(F.col(f"{n}Frames"), F.col("frameCount")).alias(f"{n}Percent"))]
    return d.select(
        F.col("trial_id").alias("video"), "frameCount", *cols, F.coalesce("longest_lost", F.lit(0).cast("long")).alias("longestLostRunFrames"),
        F.round("t", 3).alias("longestLostRunStartSeconds"), tool_version().alias("toolVersion"),
    )


def investigation_rows(investigations: DataFrame, times: DataFrame) -> DataFrame:
    """One row an event, numbered from 1, with its visit. ``times``: trial_id,
    frame_index, t. An event outside the track has no time."""
    d = visits(investigations)
    for side in ("start", "end"):
        t = times.select("trial_id", F.col("frame_index").alias(f"{side}_frame"), F.round("t", 3).alias(f"{side}Seconds"))
        d = d.join(t, ["trial_id", f"{side}_frame"], "left")
    return d.select(
        F.col("trial_id").alias("video"), "visit", (F.col("hole_index") + 1).alias("hole"), F.col("is_target").alias("isTarget"), "source", F.col("kind").alias("detectedBy"),
        (F.col("start_frame") + 1).alias("startFrame"), (F.col("end_frame") + 1).alias("endFrame"), "startSeconds", "endSeconds",
    )


def trial_rows(measures: DataFrame, strategies: DataFrame, rois: DataFrame, timebases: DataFrame, params: InvestigationParams = InvestigationParams()) -> DataFrame:
    """The 21 columns of a trial. ``timebases``: trial_id, frame_count,
    duration_seconds, nominal_fps struct<num, den>."""
    d = measures.join(rois.select("trial_id", "platform_diameter_cm", "target_hole"), "trial_id").join(timebases, "trial_id").join(strategies.select("trial_id", "label", "reasoning"), "trial_id", "left")
    return d.select(
        F.col("trial_id").alias("video"), format_fps(F.col("nominal_fps")).alias("frameRateFps"), F.col("frame_count").alias("frameCount"), F.round("duration_seconds", 3).alias("durationSeconds"),
        F.col("platform_diameter_cm").alias("platformDiameterCm"), (F.col("target_hole") + 1).alias("targetHole"),
        F.col("primary_latency_s").alias("primaryLatencySeconds"), F.col("total_latency_s").alias("totalLatencySeconds"), F.col("primary_errors").alias("primaryErrors"), F.col("total_errors").alias("totalErrors"),
        F.col("path_length_cm").alias("pathLengthCm"), F.col("avg_speed_cm_s").alias("averageSpeedCmPerSecond"), F.col("q_target_s").alias("quadrant1TargetSeconds"), F.col("q_cw_s").alias("quadrant2Seconds"),
        F.col("q_opposite_s").alias("quadrant3OppositeSeconds"), F.col("q_ccw_s").alias("quadrant4Seconds"), F.col("label").alias("searchStrategy"), F.col("reasoning").alias("searchStrategyReasoning"),
        F.lit(params.radius_factor).alias("investigationRadiusFactor"), F.lit(params.min_frames).cast("long").alias("investigationMinFrames"), tool_version().alias("toolVersion"),
    )


def custom_column(rows: DataFrame, formula: str, name: str = "value") -> DataFrame:
    return rows.withColumn(name, formula_column(formula))


def custom_scatter(rows: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Points where both formulas have a value, and how many trials were left out."""
    both = rows.select("video", formula_column(x).alias("x"), formula_column(y).alias("y"))
    gap = F.col("x").isNull() | F.col("y").isNull()
    return both.where(~gap), both.agg(F.count_if(gap).alias("excluded"))


def _with_top(rows: DataFrame, value: str, least: float) -> tuple[DataFrame, Column]:
    """``rows`` beside the greatest value, an aggregate of one row."""
    kind = dict(rows.dtypes)[value]
    top = rows.agg(F.max(value).alias("_top"))
    return rows.join(F.broadcast(top)), F.greatest(F.lit(least).cast(kind), F.col("_top"))


def learning_curve(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Latency by the trial's number in order of arrival. Trials are few beside
    frames: the one ordered window runs over trial rows only."""
    d = rows.join(added.select(F.col("trial_id").alias("video"), "added_at"), "video")
    order = Window.orderBy("added_at", "video")
    d, top = _with_top(d, "primaryLatencySeconds", 1.0)
    return d.select(F.row_number().over(order).cast("long").alias("trial"), "video", F.col("primaryLatencySeconds").alias("latency"), F.col("primaryLatencySeconds").isNull().alias("never"), top.alias("axis_top"))


def cohort_comparison(rows: DataFrame) -> DataFrame:
    rows, top = _with_top(rows, "totalErrors", 1)
    return rows.select("video", "primaryErrors", "totalErrors", "searchStrategy", top.alias("axis_top"))


def cohort(videos: DataFrame, tracks: DataFrame, rois: DataFrame, params: DataFrame | None = None, defaults: InvestigationParams = InvestigationParams()) -> DataFrame:
    """Trials that can be reported: known, tracked, and with a region of interest;
    each with the global parameters of investigations, of which there is one row, or
    the defaults where there is none."""
    known = videos.join(tracks.select("trial_id").distinct(), "trial_id", "left_semi").join(rois.select("trial_id"), "trial_id", "left_semi")
    usual = {"radius_factor": F.lit(defaults.radius_factor), "min_frames": F.lit(defaults.min_frames).cast("long")}
    if params is None:
        return known.withColumns(usual)
    one = params.limit(1).select(*[F.col(c).alias(f"_{c}") for c in usual])
    return known.join(F.broadcast(one), how="left").withColumns({c: F.coalesce(f"_{c}", v) for c, v in usual.items()}).drop(*[f"_{c}" for c in usual])


def status(videos: DataFrame, tracks: DataFrame, rois: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """is_defined and is_tracked of each trial, and phase_percent, the share of its
    frames that a running job has done (``done``: trial_id, frames_done, frames)."""
    t = tracks.select("trial_id").distinct().withColumn("is_tracked", F.lit(True))
    r = rois.select("trial_id").distinct().withColumn("is_defined", F.lit(True))
    d = videos.join(t, "trial_id", "left").join(r, "trial_id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_defined", "is_tracked")]
    if done is None:
        return d.select(*videos.columns, *flags)
    share = F.floor(100 * F.col("frames_done") / F.nullif(F.col("frames"), F.lit(0)) + 0.5)
    return d.join(done, "trial_id", "left").select(*videos.columns, *flags, share.alias("phase_percent"))
