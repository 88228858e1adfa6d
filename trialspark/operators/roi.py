"""Regions of interest: edits as record to record transforms, and readouts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import hole_ring, pixels_per_cm


def create(points: DataFrame) -> DataFrame:
    """``points``: trial_id, center_x, center_y, platform_radius, ring_radius,
    rotation, hole_count, hole_radius, source."""
    holes = hole_ring(F.col("center_x"), F.col("center_y"), F.col("ring_radius"), F.col("rotation"), F.col("hole_count"))
    return points.select(
        *points.columns, holes.alias("holes"), F.array().cast("array<int>").alias("nudged_holes"), F.lit(None).cast("long").alias("target_hole"),
        F.lit(False).alias("no_escape_confirmed"), F.lit(None).cast("double").alias("platform_diameter_cm"),
    )


def _moved(f) -> Column:
    return F.transform("holes", lambda h: F.struct(*[x.alias(n) for n, x in zip("xy", f(h["x"], h["y"]), strict=True)]))


def translate(rois: DataFrame, dx: float, dy: float) -> DataFrame:
    return rois.withColumns({"holes": _moved(lambda x, y: (x + dx, y + dy)), "center_x": F.col("center_x") + dx, "center_y": F.col("center_y") + dy})


def scale_ring(rois: DataFrame, factor: float) -> DataFrame:
    """Moves holes along their spokes; nudges stay. No factor above 0: no change."""
    if factor <= 0:
        return rois
    cx, cy = F.col("center_x"), F.col("center_y")
    return rois.withColumns({"holes": _moved(lambda x, y: (cx + (x - cx) * factor, cy + (y - cy) * factor)), "ring_radius": F.col("ring_radius") * factor})


def rotate_ring(rois: DataFrame, by: float) -> DataFrame:
    cx, cy, c, s = F.col("center_x"), F.col("center_y"), math.cos(by), math.sin(by)
    return rois.withColumns({"holes": _moved(lambda x, y: (cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c)), "rotation": F.col("rotation") + by})


def set_radius(rois: DataFrame, radius: float, which: str = "platform_radius") -> DataFrame:
    return rois.withColumn(which, F.lit(float(radius))) if radius > 0 else rois


def _checked(index: int) -> Column:
    return F.when((F.lit(index) < 0) | (F.lit(index) >= F.size("holes")), F.raise_error(F.lit("no such hole")))


def nudge_hole(rois: DataFrame, index: int, x: float, y: float) -> DataFrame:
    holes = F.transform("holes", lambda h, i: F.when(i == index, F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))).otherwise(h))
    return rois.withColumns({
        "holes": F.coalesce(_checked(index).cast("array<struct<x:double,y:double>>"), holes),
        "nudged_holes": F.array_sort(F.array_union("nudged_holes", F.array(F.lit(index)))),
    })


def regenerate_ring(rois: DataFrame) -> DataFrame:
    """A regular ring again; nudges are forgotten."""
    holes = hole_ring(F.col("center_x"), F.col("center_y"), F.col("ring_radius"), F.col("rotation"), F.col("hole_count"))
    return rois.withColumns({"holes": holes, "nudged_holes": F.array().cast("array<int>")})


def set_target(rois: DataFrame, index: int | None) -> DataFrame:
    if index is None:
        return rois.withColumn("target_hole", F.lit(None).cast("long"))
    return rois.withColumns({"target_hole": F.coalesce(_checked(index).cast("long"), F.lit(index).cast("long")), "no_escape_confirmed": F.lit(False)})


def mark_no_escape(rois: DataFrame) -> DataFrame:
    return rois.withColumns({"target_hole": F.lit(None).cast("long"), "no_escape_confirmed": F.lit(True)})


def set_diameter(rois: DataFrame, cm: float | None) -> DataFrame:
    return rois.withColumn("platform_diameter_cm", F.lit(cm).cast("double"))


def with_default_diameter(rois: DataFrame, default: DataFrame) -> DataFrame:
    """A missing diameter read as the setting: one row, which is broadcast."""
    one = default.limit(1).select(F.col("diameter_cm").alias("_default"))
    return rois.join(F.broadcast(one), how="left").withColumn("platform_diameter_cm", F.coalesce("platform_diameter_cm", "_default")).drop("_default")


def from_template(rois: DataFrame, template: DataFrame, videos: DataFrame) -> DataFrame:
    """Trials without a region take the template's, marked so."""
    one = template.limit(1).drop("trial_id").withColumn("source", F.lit("template"))
    missing = videos.select("trial_id").join(rois.select("trial_id"), "trial_id", "left_anti")
    return rois.unionByName(missing.join(F.broadcast(one)).select(*rois.columns))


def completeness(rois: DataFrame) -> DataFrame:
    ring = F.coalesce(F.size("holes") > 0, F.lit(False))
    target = F.col("target_hole").isNotNull() | F.col("no_escape_confirmed")
    scale = F.coalesce(F.col("platform_diameter_cm") > 0, F.lit(False))
    return rois.select("trial_id", ring.alias("has_ring"), target.alias("has_target"), scale.alias("has_scale"), (ring & target & scale).alias("is_complete"))


def calibration(rois: DataFrame) -> DataFrame:
    """Sizes in pixels and, where there is a scale, in cm; the gap between holes is
    the chord of neighbouring centres."""
    per = pixels_per_cm(F.col("platform_radius"), F.col("platform_diameter_cm"))
    gap = 2 * F.col("ring_radius") * F.sin(F.lit(math.pi) / F.col("hole_count"))
    sizes = {"platform": F.col("platform_radius"), "ring": F.col("ring_radius"), "hole": F.col("hole_radius"), "gap": gap}
    cols = [x for n, px in sizes.items() for x in (px.alias(f"{n}_px"), (px / per).alias(f"{n}_cm"))]
    return rois.select("trial_id", *cols, (10 * per).alias("scale_bar_px"), F.round(F.degrees("rotation"), 1).alias("rotation_degrees"))


def quadrant_legend(rois: DataFrame) -> DataFrame:
    """Angles of the borders between quadrants, from the target's."""
    hole = F.get(F.col("holes"), F.col("target_hole").cast("int"))
    d = rois.where("target_hole is not null").withColumn("_h", hole)
    to = F.atan2(F.col("_h.y") - F.col("center_y"), F.col("_h.x") - F.col("center_x"))
    return d.select("trial_id", F.transform(F.array(*[F.lit(k) for k in (1, 3, 5, 7)]), lambda k: to + k * math.pi / 4).alias("borders"))
