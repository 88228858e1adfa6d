"""Trials made of the events table, with integers so that engines agree.

A user is a trial, an event a frame, an error a frame in which nothing was found.
Positions are running sums; the region is a ring of 20 holes turned by 0.1 rad, so
that no position ties or sits on a radius, and a trial's target is the hole next
to its last found position.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import nearest_hole
from ..operators import investigations, measures, overlays, strategy, tracking
from ..sources.files import shared_folder

CX, CY, PLATFORM, RING, ROTATION, HOLES, HOLE_RADIUS, DIAMETER = 320.0, 240.0, 110.0, 60.0, 0.1, 20, 12.0, 92.0
#: Hole centres, the same doubles for both engines.
CENTERS = [(CX + RING * math.cos(ROTATION + i * 2 * math.pi / HOLES), CY + RING * math.sin(ROTATION + i * 2 * math.pi / HOLES)) for i in range(HOLES)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holes() -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in CENTERS])


def micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("trial_id").orderBy("us", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("trial_id")
    ev = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("trial_id"), micros().alias("us"), "event_type")
    step = lambda k: F.sum(F.col("event_id") * k % 25 - 12).over(upto)
    d = ev.select(
        "trial_id", "event_id", (F.row_number().over(order) - 1).cast("long").alias("frame_index"), "us", ((F.col("us") - F.min("us").over(whole)) / F.lit(1e6)).alias("t"),
        (F.col("event_type") != "error").alias("found"), (CX + step(7919)).alias("cx"), (CY + step(104729)).alias("cy"), (100 + F.col("event_id") * 31 % 200).cast("double").alias("area"),
    )
    dx, dy = F.col("event_id") % 7 + 3, F.col("event_id") % 5 - 2
    return d.withColumns({"ax": F.col("cx") + dx, "ay": F.col("cy") + dy, "bx": F.col("cx") - dx, "by": F.col("cy") - dy})


def rois(detected: DataFrame) -> DataFrame:
    """One region a trial that was found at least once."""
    last = detected.where("found").groupBy("trial_id").agg(F.max_by(F.struct("cx", "cy"), "frame_index").alias("p"))
    d = last.withColumn("holes", holes())
    return d.select(
        "trial_id", F.lit(CX).alias("center_x"), F.lit(CY).alias("center_y"), F.lit(PLATFORM).alias("platform_radius"), F.lit(RING).alias("ring_radius"), F.lit(ROTATION).alias("rotation"),
        F.lit(HOLES).alias("hole_count"), "holes", nearest_hole(F.col("p.cx"), F.col("p.cy"), F.col("holes"))["i"].alias("target_hole"), F.lit(DIAMETER).alias("platform_diameter_cm"),
        F.lit(HOLE_RADIUS).alias("hole_radius"), F.lit(False).alias("no_escape_confirmed"),
    )


class Trials:
    """The fixture's tables of one data set, each a lazy DataFrame.

    Detections feed nearly every step, so they are kept, on disk beyond memory, with
    their order by trial: no step makes, exchanges or sorts them again."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.detections = detections(spark, sf_dir).persist()
        self.rois = rois(self.detections).persist()

    @property
    def times(self) -> DataFrame:
        return self.detections.select("trial_id", "frame_index", "t")

    @property
    def simple(self) -> DataFrame:
        """Tracks by found alone: tracked with the nose at the centroid, or lost."""
        found = F.col("found")
        at = lambda c: F.when(found, F.col(c))
        return self.detections.select(
            "trial_id", "frame_index", "t", F.when(found, tracking.TRACKED).otherwise(tracking.LOST).alias("state"), at("cx").alias("cx"), at("cy").alias("cy"), at("cx").alias("nx"), at("cy").alias("ny"),
            F.when(found, F.col("area")).otherwise(0.0).alias("area"), F.lit(None).cast("long").alias("hole_index"),
        )

    @cached_property
    def timed_tracks(self) -> DataFrame:
        return tracking.track(self.detections, self.rois, keep=["t"])

    @property
    def tracks(self) -> DataFrame:
        return self.timed_tracks.drop("t")

    @cached_property
    def frames(self) -> DataFrame:
        """Tracks with corrections, times and durations. They feed every later step,
        so they are kept, on disk beyond memory; a lost block is made again."""
        d = overlays.apply_corrections(self.timed_tracks, self.corrections)
        nxt = F.lead("t").over(Window.partitionBy("trial_id").orderBy("frame_index"))
        d = d.withColumn("duration", F.coalesce(nxt - F.col("t"), F.lit(0.0)))
        return d.select(*self.tracks.columns, "is_corrected", "t", "duration").persist()

    @property
    def corrections(self) -> DataFrame:
        """Every 97th event is moved by hand; its nose is known when it is odd."""
        d = self.detections.where("event_id % 97 = 0")
        odd = F.col("event_id") % 2 == 1
        return d.select("trial_id", "frame_index", (F.col("cx") + 5).alias("cx"), (F.col("cy") - 5).alias("cy"), F.when(odd, F.col("cx") + 9).alias("nx"), F.when(odd, F.col("cy") - 9).alias("ny"))

    @cached_property
    def auto(self) -> DataFrame:
        """A few rows a trial, written to the shared folder: later steps read them often,
        and their plans would else repeat all that lies before."""
        folder = shared_folder(self.spark, "investigations")
        investigations.detect_investigations(self.frames, self.rois).write.parquet(folder)
        return self.spark.read.parquet(folder)

    @property
    def removed(self) -> DataFrame:
        """Detected events that start on a frame divisible by 5 were removed."""
        return self.auto.where("start_frame % 5 = 0").select("trial_id", F.concat(F.lit("auto-"), F.col("start_frame").cast("string")).alias("id"))

    @property
    def manual(self) -> DataFrame:
        """One event by hand in every third trial."""
        return self.rois.where("trial_id % 3 = 0").select(
            "trial_id", F.lit(1).cast("long").alias("ordinal"), F.lit("manual-1").alias("id"), (F.col("trial_id") % HOLES).alias("hole_index"), F.lit(4).cast("long").alias("start_frame"), F.lit(9).cast("long").alias("end_frame")
        )

    @cached_property
    def investigations(self) -> DataFrame:
        """Kept like frames: a few rows a trial."""
        return overlays.apply_investigation_edits(self.auto, self.removed, self.manual, self.rois).persist()

    @property
    def measures(self) -> DataFrame:
        return measures.trial_measures(self.frames, self.rois, self.investigations)

    @property
    def overrides(self) -> DataFrame:
        """Latencies and a quadrant time set by hand in every tenth trial."""
        null = F.lit(None)
        d = self.rois.where("trial_id % 10 = 0")
        values = {"primary_latency_s": F.lit(12.5), "total_latency_s": null.cast("double"), "primary_errors": null.cast("long"), "total_errors": F.lit(7).cast("long"), "path_length_cm": null.cast("double"), "avg_speed_cm_s": null.cast("double"), "q_target_s": F.lit(3.25), "q_opposite_s": null.cast("double"), "q_cw_s": null.cast("double"), "q_ccw_s": null.cast("double")}
        return d.select("trial_id", *[v.alias(k) for k, v in values.items()], F.when(F.col("trial_id") % 20 == 0, "serial").alias("search_strategy"))

    @property
    def strategies(self) -> DataFrame:
        return strategy.classify(self.frames, self.rois, self.investigations)
