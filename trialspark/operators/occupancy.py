"""Occupancy of a grid over the platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracking import TRACKED


def occupancy(frames: DataFrame, rois: DataFrame, resolution: int = 14) -> DataFrame:
    """(trial_id, row, col, count, max_count) of the cells with tracked frames.

    The grid is the platform's bounding square; centroids outside are dropped.
    """
    r = rois.select("trial_id", "center_x", "center_y", "platform_radius")
    d = frames.where((F.col("state") == TRACKED) & F.col("cx").isNotNull()).join(r, "trial_id")
    cell = 2 * F.col("platform_radius") / resolution
    at = lambda p, c: F.floor((F.col(p) - (F.col(c) - F.col("platform_radius"))) / cell)
    d = d.select("trial_id", at("cy", "center_y").alias("row"), at("cx", "center_x").alias("col"))
    inside = F.col("row").between(0, resolution - 1) & F.col("col").between(0, resolution - 1)
    counts = d.where(inside).groupBy("trial_id", "row", "col").agg(F.count("*").alias("count"))
    return counts.withColumn("max_count", F.max("count").over(Window.partitionBy("trial_id")))


def dense(cells: DataFrame, trials: DataFrame, resolution: int = 14) -> DataFrame:
    """All cells of all trials, 0 where nothing was."""
    n = F.sequence(F.lit(0).cast("long"), F.lit(resolution - 1).cast("long"))
    grid = trials.select("trial_id").distinct().withColumn("row", F.explode(n)).withColumn("col", F.explode(n))
    return grid.join(cells.select("trial_id", "row", "col", "count"), ["trial_id", "row", "col"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def heatmap(cells: DataFrame) -> DataFrame:
    """Cell opacity: 0.12 for an empty share to 0.87 for the fullest cell."""
    return cells.withColumn("opacity", 0.12 + 0.75 * F.col("count") / F.greatest("max_count", F.lit(1)))
