"""Corrections, edits and overrides: small tables laid over computed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import auto_id

MEASURES = ("primary_latency_s", "total_latency_s", "primary_errors", "total_errors", "path_length_cm", "avg_speed_cm_s", "q_target_s", "q_opposite_s", "q_cw_s", "q_ccw_s")
QUADRANTS = ("q_target_s", "q_opposite_s", "q_cw_s", "q_ccw_s")


def apply_corrections(tracks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Effective frames: a correction's centroid, and its nose or else centroid. A frame
    has one correction at most.

    Corrections and frames lie in one order by trial, each correction right before its
    frame: nothing is exchanged or joined by frame, so the tracks' places by trial hold.
    """
    kind = tracks.schema["frame_index"].dataType
    fixes = corrections.select("trial_id", F.col("frame_index").cast(kind).alias("frame_index"), F.struct("cx", "cy", "nx", "ny").alias("_fix"))
    order = Window.partitionBy("trial_id").orderBy("frame_index", F.col("_fix").isNull())
    both = tracks.unionByName(fixes, allowMissingColumns=True)
    both = both.withColumn("_before", F.lag(F.struct("frame_index", F.col("_fix").alias("fix"))).over(order)).where("_fix is null")
    fixed = F.col("_before.fix").isNotNull() & (F.col("_before.frame_index") == F.col("frame_index"))
    return both.select(
        *[
            F.when(fixed, F.coalesce(F.col(f"_before.fix.{c}"), F.col(f"_before.fix.c{c[1]}"))).otherwise(F.col(c)).alias(c) if c in ("cx", "cy", "nx", "ny") else F.col(c)
            for c in tracks.columns
        ],
        F.coalesce(fixed, F.lit(False)).alias("is_corrected"),
    )


def apply_investigation_edits(auto: DataFrame, removed: DataFrame, manual: DataFrame, rois: DataFrame) -> DataFrame:
    """Detected events without the removed ids, and the manual ones, with ids and
    source. ``ordinal`` keeps the order of events that start together."""
    named = auto.withColumn("id", auto_id(F.col("start_frame"))).join(removed.select("trial_id", "id"), ["trial_id", "id"], "left_anti")
    hand = manual.join(rois.select("trial_id", "target_hole"), "trial_id", "left").select(
        "trial_id", "id", "hole_index", F.coalesce(F.col("hole_index") == F.col("target_hole"), F.lit(False)).alias("is_target"),
        "start_frame", "end_frame", F.lit("manual").alias("kind"), F.lit("manual").alias("source"), (F.col("ordinal") + F.lit(1 << 40)).alias("ordinal"),
    )
    mine = named.select("trial_id", "id", "hole_index", "is_target", "start_frame", "end_frame", "kind", F.lit("auto").alias("source"), F.col("ordinal").cast("long").alias("ordinal"))
    return mine.unionByName(hand)


def visits(investigations: DataFrame) -> DataFrame:
    """``visit``: a running number that grows when the hole changes."""
    order = Window.partitionBy("trial_id").orderBy("start_frame", "ordinal")
    moved = (~F.col("hole_index").eqNullSafe(F.lag("hole_index").over(order))) | (F.row_number().over(order) == 1)
    return investigations.withColumn("visit", F.sum(moved.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def apply_measure_overrides(measures: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each measure or its override; quadrants only where they were computed.
    ``overridden`` lists the measures that were set by hand."""
    both = measures.join(overrides.select("trial_id", *[F.col(m).alias(f"o_{m}") for m in MEASURES]), "trial_id", "left")

    def given(m: str) -> Column:
        o = F.col(f"o_{m}")
        return F.when(F.col("q_target_s").isNotNull(), o) if m in QUADRANTS else o

    out = [F.coalesce(given(m), F.col(m)).alias(m) if m in MEASURES else F.col(m) for m in measures.columns]
    names = F.filter(F.array(*[F.when(F.col(f"o_{m}").isNotNull(), F.lit(m)) for m in MEASURES]), lambda x: x.isNotNull())
    return both.select(*out, names.alias("overridden"))


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key of an append-only log; a tombstone removes it.

    The log has updated_at, seq (breaks ties) and deleted. One aggregate, no sort.
    """
    rest = [c for c in log.columns if c not in keys]
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("r"))
    return top.select(*keys, "r.*").where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted")


def at_version(log: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The state after the first ``version`` edits: undo by reading less."""
    return latest(log.where(F.col("seq") <= version), keys)
