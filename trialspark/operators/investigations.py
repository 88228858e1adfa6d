"""Hole investigations from effective frames: gaps and islands by trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, nearest_hole_within
from ..params import InvestigationParams
from .tracking import OCCLUDED, TRACKED

def _islands(frames: DataFrame, hole: str) -> DataFrame:
    """Runs of adjacent rows with one non-null ``hole``; ``after`` is the next row's index."""
    order = Window.partitionBy("trial_id").orderBy("frame_index")
    change = (~F.col(hole).eqNullSafe(F.lag(hole).over(order))) | (F.row_number().over(order) == 1)
    run = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    d = frames.withColumn("_new", change.cast("int")).withColumn("_run", run).withColumn("_after", F.lead("frame_index").over(order))
    return (
        d.where(F.col(hole).isNotNull())
        .groupBy("trial_id", "_run")
        .agg(F.first(hole).alias("hole_index"), F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("last_frame"), F.max_by("_after", "frame_index").alias("after"))
        .drop("_run")
    )


def occlusion_runs(frames: DataFrame) -> DataFrame:
    """Runs in a hole; a run lasts until the next row, so it covers missing frames."""
    held = frames.withColumn("_hole", F.when(F.col("state") == OCCLUDED, F.col("hole_index")))
    return _islands(held, "_hole").select("trial_id", "hole_index", "start_frame", F.coalesce(F.col("after") - 1, F.col("last_frame")).alias("end_frame"))


def near_holes(frames: DataFrame, rois: DataFrame, params: InvestigationParams = InvestigationParams()) -> DataFrame:
    """``near``: the hole within reach of a tracked nose.

    A region's holes lie between two distances from their middle; noses that are out of
    reach of that band are near none, and holes are looked at for the others alone.
    """
    known = F.filter("holes", lambda h: h["x"].isNotNull() & h["y"].isNotNull())
    mean = lambda n: F.aggregate("_known", F.lit(0.0), lambda s, h: s + h[n]) / F.nullif(F.size("_known"), F.lit(0))
    r = rois.select("trial_id", "holes", (F.col("hole_radius") * params.radius_factor).alias("_reach"), known.alias("_known"))
    r = r.withColumn("_mx", mean("x")).withColumn("_my", mean("y"))
    away = F.transform("_known", lambda h: distance(F.col("_mx"), F.col("_my"), h["x"], h["y"]))
    r = r.withColumn("_away", away).withColumn("_slack", F.col("_reach") + 1e-6 * (1 + F.array_max("_away")))  # more than any rounding
    r = r.select("trial_id", "holes", "_reach", "_mx", "_my", (F.array_min("_away") - F.col("_slack")).alias("_low"), (F.array_max("_away") + F.col("_slack")).alias("_high"))
    d = frames.join(r, "trial_id")
    hole = nearest_hole_within(F.col("nx"), F.col("ny"), F.col("holes"), F.col("_reach"))
    reachable = distance(F.col("nx"), F.col("ny"), F.col("_mx"), F.col("_my")).between(F.col("_low"), F.col("_high"))
    return d.withColumn("near", F.when((F.col("state") == TRACKED) & F.col("nx").isNotNull() & reachable, hole)).drop("holes", "_reach", "_mx", "_my", "_low", "_high")


def proximity_runs(near: DataFrame, params: InvestigationParams = InvestigationParams()) -> DataFrame:
    """Runs of ``min_frames`` or longer near one hole; gaps in the indices count."""
    runs = _islands(near, "near").select("trial_id", "hole_index", "start_frame", F.col("last_frame").alias("end_frame"))
    return runs.where(F.col("end_frame") - F.col("start_frame") + 1 >= params.min_frames)


def covered(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """``frames`` with ``covered``: whether a span (trial_id, start_frame, end_frame; both
    ends belong to it) holds the frame. Spans may overlap, nest and repeat.

    A sweep instead of a range join: starts of spans and frames lie in one order, and a
    frame is covered if the greatest end so far reaches it. A span and a frame cost one
    row each, however many of them meet.
    """
    marks = spans.select("trial_id", F.col("start_frame").cast("long").alias("_at"), F.col("end_frame").cast("long").alias("_end"), F.lit(None).cast(frames.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    each = frames.select("trial_id", F.col("frame_index").cast("long").alias("_at"), F.lit(None).cast("long").alias("_end"), F.struct("*").alias("_row"))
    upto = Window.partitionBy("trial_id").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    d = marks.unionByName(each).withColumn("_reach", F.max("_end").over(upto)).where("_row is not null")
    return d.select("_row.*", F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False)).alias("covered"))


def outside(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Frames that no span covers."""
    return covered(frames, spans).where("not covered").drop("covered")


def detect_investigations(frames: DataFrame, rois: DataFrame, params: InvestigationParams = InvestigationParams(), occlusions: DataFrame | None = None) -> DataFrame:
    """trial_id, hole_index, is_target, start_frame, end_frame, kind, ordinal.

    Frames that an occlusion covers have no proximity. Of detected occlusions these are
    the rows in a hole, and the gap after them has none. With ``occlusions`` (trial_id,
    hole_index, start_frame, end_frame), edited ones as well, those given count instead.
    """
    if occlusions is not None:
        held = occlusions.select("trial_id", "hole_index", "start_frame", "end_frame", F.lit("occlusion").alias("kind"), F.lit(0).alias("rank"))
        marked = covered(near_holes(frames, rois, params), occlusions)
        near = marked.withColumn("near", F.when(~F.col("covered"), F.col("near")))
        close = proximity_runs(near, params).withColumn("kind", F.lit("proximity")).withColumn("rank", F.lit(1))
        return _in_order(held, close, rois)
    held = occlusion_runs(frames).withColumn("kind", F.lit("occlusion")).withColumn("rank", F.lit(0))
    close = proximity_runs(near_holes(frames, rois, params), params).withColumn("kind", F.lit("proximity")).withColumn("rank", F.lit(1))
    return _in_order(held, close, rois)


def _in_order(held: DataFrame, close: DataFrame, rois: DataFrame) -> DataFrame:
    order = Window.partitionBy("trial_id").orderBy("start_frame", "rank")
    return (
        held.unionByName(close)
        .join(rois.select("trial_id", "target_hole"), "trial_id")
        .select(
            "trial_id", "hole_index", F.coalesce(F.col("hole_index") == F.col("target_hole"), F.lit(False)).alias("is_target"),
            "start_frame", "end_frame", "kind", F.row_number().over(order).cast("long").alias("ordinal"),
        )
    )


def visit_spans(visited: DataFrame, last_frames: DataFrame) -> DataFrame:
    """One row a visit: first start, last end (no later than the trial's last
    frame), and its kind: occlusion if any event is, else the first event's."""
    out = visited.groupBy("trial_id", "visit").agg(
        F.first("hole_index").alias("hole_index"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"),
        F.bool_or(F.col("kind") == "occlusion").alias("held"), F.min_by("kind", F.struct("start_frame", "ordinal")).alias("first_kind"),
    )
    return out.join(last_frames, "trial_id").select(
        "trial_id", "visit", "hole_index", "start_frame", F.least("end_frame", "last_frame").alias("end_frame"),
        F.when(F.col("held"), "occlusion").otherwise(F.col("first_kind")).alias("kind"),
    )
