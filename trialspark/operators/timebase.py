"""Frame times from run-length encoded durations, and lookups by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reduce_rational


def frame_times(runs: DataFrame) -> DataFrame:
    """(trial_id, frame_index, start_tick, delta, timescale) of every frame.

    ``runs``: trial_id, timescale, stts array<struct<count, delta>>. A run's first
    tick and frame are running sums over the runs of its trial, one row a run, so a
    trial of many runs costs their number.
    """
    frames = F.coalesce(F.aggregate("stts", F.lit(0).cast("long"), lambda n, r: n + r["count"]), F.lit(0))
    # explode would drop a trial without runs in silence
    checked = F.when(~(F.col("timescale") > 0), F.raise_error(F.lit("the timescale must be above zero"))).when(frames <= 0, F.raise_error(F.lit("no frames"))).otherwise(F.col("stts"))
    each = runs.select("trial_id", F.col("timescale").cast("long").alias("timescale"), F.posexplode(checked).alias("pos", "run"))
    each = each.select("trial_id", "timescale", "pos", F.col("run.count").cast("long").alias("count"), F.col("run.delta").cast("long").alias("delta"))
    before = Window.partitionBy("trial_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = each.withColumns({"frame0": F.coalesce(F.sum("count").over(before), zero), "tick0": F.coalesce(F.sum(F.col("count") * F.col("delta")).over(before), zero)})
    made = placed.where(F.col("count") > 0).withColumn("i", F.explode(F.sequence(zero, F.col("count") - 1)))
    return made.select("trial_id", (F.col("frame0") + F.col("i")).alias("frame_index"), (F.col("tick0") + F.col("i") * F.col("delta")).alias("start_tick"), "delta", "timescale")


def time_of(times: DataFrame, wanted: DataFrame) -> DataFrame:
    """(trial_id, frame_index, seconds) of wanted frames; a frame that the trial
    does not have is an error."""
    d = wanted.join(times.select("trial_id", "frame_index", "start_tick", "timescale"), ["trial_id", "frame_index"], "left")
    seconds = F.col("start_tick") / F.col("timescale")
    out_of_range = F.raise_error(F.concat(F.lit("no frame "), F.col("frame_index").cast("string"))).cast("double")
    return d.select("trial_id", "frame_index", F.when(F.col("start_tick").isNull(), out_of_range).otherwise(seconds).alias("seconds"))


def jitter(deltas: DataFrame) -> DataFrame:
    """The most frequent delta of each trial, the least of equals, and how many
    frames have another. ``deltas``: trial_id, delta, and n: frames of that delta."""
    by = deltas.groupBy("trial_id", "delta").agg(F.sum("n").alias("n"))
    out = by.groupBy("trial_id").agg(
        F.max(F.struct("n", (-F.col("delta")).alias("neg"))).alias("top"), F.sum("n").alias("frames"), F.count("*").alias("distinct_deltas")
    )
    off = F.col("frames") - F.col("top.n")
    return out.select(
        "trial_id",
        (-F.col("top.neg")).alias("modal_delta"),
        off.alias("off_modal_frames"),
        F.try_divide(off.cast("double"), F.col("frames")).alias("off_modal_fraction"),
        "distinct_deltas",
        (F.col("distinct_deltas") > 1).alias("is_variable"),
    )


def timebase(runs: DataFrame) -> DataFrame:
    """One row a trial: frame count, duration, nominal rate and jitter."""
    times = frame_times(runs)
    whole = times.groupBy("trial_id", "timescale").agg(F.count("*").alias("frame_count"), F.sum("delta").alias("duration_ticks"))
    counted = times.groupBy("trial_id", "delta").agg(F.count("*").alias("n"))
    both = whole.join(jitter(counted), "trial_id")
    return both.withColumn("duration_seconds", F.col("duration_ticks") / F.col("timescale")).withColumn(
        "nominal_fps", reduce_rational(F.col("timescale"), F.col("modal_delta"))
    )


def with_durations(times: DataFrame, start: str = "t", end: str | None = None) -> DataFrame:
    """``duration``: to the next frame's start; the last frame's to ``end`` or 0."""
    nxt = F.lead(start).over(Window.partitionBy("trial_id").orderBy("frame_index"))
    last = F.greatest(F.col(end) - F.col(start), F.lit(0.0)) if end else F.lit(0.0)
    return times.withColumn("duration", F.coalesce(nxt - F.col(start), last))


def frame_at_time(times: DataFrame, wanted: DataFrame, start: str = "start_tick") -> DataFrame:
    """The last frame that starts no later than each wanted (trial_id, at), clamped
    to the first frame: a backward as-of join.

    Both tables are brought together by trial and read once in time order, so a
    trial costs its rows, not their product.
    """
    marks = times.select("trial_id", F.col(start).alias("at"), F.lit(0).alias("asks"), F.col("frame_index").alias("frame_index"))
    asks = wanted.select("trial_id", F.col("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("frame_index"))
    upto = Window.partitionBy("trial_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("trial_id")
    found = marks.unionByName(asks).withColumn("hit", F.last("frame_index", ignorenulls=True).over(upto)).withColumn("first", F.min("frame_index").over(whole))
    return found.where("asks = 1").select("trial_id", "at", F.coalesce("hit", "first").alias("frame_index"))


def seek_times(times: DataFrame, start: str = "t", end: str | None = None) -> DataFrame:
    """The middle of each frame's interval."""
    return with_durations(times, start, end).withColumn("seek", F.col(start) + F.col("duration") / 2)
