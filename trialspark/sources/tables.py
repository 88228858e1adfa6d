"""Keyed tables: videos, regions, tracks and the overlay logs.

Overlays are append-only logs of (key..., value columns, updated_at, seq, deleted);
reads take each key's last record. Base tables are written by partition, so that a
trial's rows replace only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.overlays import latest

SCHEMA_VERSION = 7
BUCKETS = 256


def natural_key(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws(":", name, size.cast("string"), modified.cast("string"))


def save_tracks(tracks: DataFrame, path: str, detection: dict, tracker: dict) -> None:
    """Tracks with the parameters that made them. Buckets of trials that ``tracks``
    holds are replaced, so it must hold the buckets' other trials as well."""
    kept = tracks.withColumns({**{f"detection_{k}": F.lit(v) for k, v in detection.items()}, **{f"tracker_{k}": F.lit(v) for k, v in tracker.items()}, "schema_version": F.lit(SCHEMA_VERSION)})
    bucketed = kept.withColumn("bucket", bucket())
    bucketed.repartition("bucket").sortWithinPartitions("trial_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def bucket() -> Column:
    """The folder of a trial: a fixed number of them, however many trials there are."""
    return F.pmod(F.xxhash64("trial_id"), F.lit(BUCKETS)).cast("int")


def append(log: DataFrame, path: str) -> None:
    log.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("append").parquet(path)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return latest(spark.read.option("mergeSchema", True).parquet(path), keys)


def read_trial(table: DataFrame, trial_id: object) -> DataFrame:
    """A point read: the filter reaches the scan, and one bucket where there are some."""
    mine = table.where(F.col("trial_id") == F.lit(trial_id))
    return mine.where(F.col("bucket") == F.pmod(F.xxhash64(F.lit(trial_id).cast(dict(table.dtypes)["trial_id"])), F.lit(BUCKETS))) if "bucket" in table.columns else mine


def list_videos(videos: DataFrame) -> DataFrame:
    """Summaries in order of arrival, without the files' bytes."""
    return videos.drop("blob").orderBy("added_at", "trial_id")


def fetch_missing(wanted: DataFrame, videos: DataFrame) -> DataFrame:
    """Names that aren't loaded yet."""
    return wanted.join(videos.select("name"), "name", "left_anti")


def delete_trials(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the trials; tables without trials (settings) stay."""
    return {n: t.join(gone.select("trial_id"), "trial_id", "left_anti") if "trial_id" in t.columns else t for n, t in tables.items()}


def swap_order(videos: DataFrame, a: object, b: object) -> DataFrame:
    """Two videos trade places in the order of arrival."""
    times = {r.trial_id: r.added_at for r in videos.where(F.col("trial_id").isin(a, b)).select("trial_id", "added_at").collect()}
    if len(times) < 2:
        return videos
    added = F.when(F.col("trial_id") == a, F.lit(times[b])).when(F.col("trial_id") == b, F.lit(times[a])).otherwise(F.col("added_at"))
    return videos.withColumn("added_at", added)


def update_pins(pins: DataFrame, rois: DataFrame) -> DataFrame:
    """Pins of trials that have a region; others have nowhere to go."""
    return pins.join(rois.select("trial_id"), "trial_id", "left_semi")


def neighbour_pins(pins: DataFrame, at: DataFrame) -> DataFrame:
    """The pins just before and after each (trial_id, frame_index): pins and asked
    frames in one order, read once in either direction."""
    asked = at.select("trial_id", "frame_index", F.lit(None).cast("long").alias("pin"), F.lit(1).alias("asks")).distinct()
    marks = pins.select("trial_id", "frame_index", F.col("frame_index").cast("long").alias("pin"), F.lit(0).alias("asks"))
    by = Window.partitionBy("trial_id").orderBy("frame_index")  # a pin on the asked frame is neither
    previous = F.last("pin", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, -1))
    following = F.first("pin", ignorenulls=True).over(by.rangeBetween(1, Window.unboundedFollowing))
    return asked.unionByName(marks).select("trial_id", "frame_index", "asks", previous.alias("previous_pin"), following.alias("next_pin")).where("asks = 1").drop("asks")


def check_order(frames: DataFrame) -> DataFrame:
    """For each trial: frames, duplicates, missing numbers and how late a frame came
    (``arrival``: its place in decoding order), which a bounded buffer must hold."""
    top = F.max("frame_index") + 1
    late = F.max(F.col("arrival") - F.col("frame_index"))
    d = frames.groupBy("trial_id").agg(F.count("*").alias("frames"), F.count_distinct("frame_index").alias("kinds"), top.alias("top"), late.alias("max_displacement"))
    return d.select("trial_id", "frames", (F.col("frames") - F.col("kinds")).alias("duplicates"), (F.col("top") - F.col("kinds")).alias("missing"), "max_displacement")
