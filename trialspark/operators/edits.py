"""A reviewer's edits as transforms of the overlay tables.

Each takes the present table and a table of requests, any number of trials at once;
repeated requests count once. Appended to a log instead, the same rows are read back
with ``overlays.latest``; ``overlays.at_version`` undoes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .overlays import MEASURES

FIELDS = ("hole_index", "start_frame", "end_frame")
OVERRIDES = (*MEASURES, "search_strategy")
#: States that an undo list keeps.
HISTORY = 20


def remove_auto(removed: DataFrame, gone: DataFrame) -> DataFrame:
    """Ids of detected events that were removed; removing one again changes nothing."""
    return removed.select("trial_id", "id").unionByName(gone.select("trial_id", "id")).distinct()


def add_manual(manual: DataFrame, new: DataFrame) -> DataFrame:
    """New events after the trial's others, in the order of their ids."""
    last = manual.groupBy("trial_id").agg(F.max("ordinal").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("trial_id").orderBy("id"))
    placed = new.dropDuplicates(["trial_id", "id"]).join(last, "trial_id", "left").withColumn("ordinal", (F.coalesce("_last", F.lit(0)) + nth).cast("long"))
    return manual.unionByName(placed.select(*manual.columns))


def update_manual(manual: DataFrame, patch: DataFrame) -> DataFrame:
    """Fields that the patch gives (trial_id, id, any of FIELDS) take its values."""
    given = [c for c in FIELDS if c in patch.columns]
    new = patch.select("trial_id", "id", *[F.col(c).alias(f"_{c}") for c in given]).dropDuplicates(["trial_id", "id"])
    d = manual.join(new, ["trial_id", "id"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in given})
    return d.select(*manual.columns)


def delete_manual(manual: DataFrame, gone: DataFrame) -> DataFrame:
    return manual.join(gone.select("trial_id", "id"), ["trial_id", "id"], "left_anti").select(*manual.columns)


def set_overrides(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Values that ``changes`` gives (trial_id, any of OVERRIDES) replace present ones."""
    given = [c for c in OVERRIDES if c in changes.columns]
    d = overrides.join(changes.select("trial_id", *[F.col(c).alias(f"_{c}") for c in given]), "trial_id", "full")
    return d.select("trial_id", *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in overrides.columns if c != "trial_id"])


def clear_overrides(overrides: DataFrame, cleared: DataFrame) -> DataFrame:
    """``cleared``: trial_id, key. A trial without a value left has no row."""
    keys = cleared.groupBy("trial_id").agg(F.collect_set("key").alias("_keys"))
    d = overrides.join(keys, "trial_id", "left")
    own = [c for c in overrides.columns if c != "trial_id"]
    out = d.select("trial_id", *[F.when(~F.coalesce(F.array_contains("_keys", c), F.lit(False)), F.col(c)).alias(c) for c in own])
    return out.where(F.coalesce(*[F.col(c).cast("string") for c in own]).isNotNull())


def set_corrections(corrections: DataFrame, tracks: DataFrame, points: DataFrame) -> DataFrame:
    """``points``: trial_id, frame_index, which ('centroid' or 'nose'), x, y. The other
    point is the frame's corrected one, else the tracked one, else the same point."""
    key = ["trial_id", "frame_index"]
    at = lambda w: F.max(F.when(F.col("which") == w, F.struct("x", "y"))).alias(w)
    new = points.groupBy(*key).agg(at("centroid"), at("nose"))
    now = corrections.select(*key, *[F.col(c).alias(f"_{c}") for c in ("cx", "cy", "nx", "ny")], F.lit(True).alias("_is"))
    seen = tracks.select(*key, *[F.col(c).alias(f"t_{c}") for c in ("cx", "cy", "nx", "ny")])
    d = new.join(now, key, "left").join(seen, key, "left")

    def point(which: str, other: str, x: str) -> list:
        was = F.when(F.coalesce("_is", F.lit(False)), F.col(f"_{x}")).otherwise(F.coalesce(f"t_{x}", F.col(f"{other}.{x[1]}")))
        return F.coalesce(F.col(f"{which}.{x[1]}"), was).alias(x)

    changed = d.select(*key, point("centroid", "nose", "cx"), point("centroid", "nose", "cy"), point("nose", "centroid", "nx"), point("nose", "centroid", "ny"))
    return corrections.join(new, key, "left_anti").select(*changed.columns).unionByName(changed)


def revert_corrections(corrections: DataFrame, frames: DataFrame) -> DataFrame:
    return corrections.join(frames.select("trial_id", "frame_index"), ["trial_id", "frame_index"], "left_anti").select(*corrections.columns)


def toggle_pins(pins: DataFrame, frames: DataFrame) -> DataFrame:
    """Pins that were not there are set, the others go."""
    key = ["trial_id", "frame_index"]
    each = pins.select(*key).distinct().unionByName(frames.select(*key).distinct())
    return each.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").select(*key)


def history(log: DataFrame) -> DataFrame:
    """The last HISTORY edits of each trial, the newest first: what can be undone."""
    nth = F.row_number().over(Window.partitionBy("trial_id").orderBy(F.desc("seq")))
    return log.withColumn("_nth", nth).where(F.col("_nth") <= HISTORY).drop("_nth")


def nearest_point(path: DataFrame, clicks: DataFrame, reach: float = 14.0) -> DataFrame:
    """``clicks``: trial_id, click, x, y. The frame whose point lies nearest to a click
    and within ``reach`` of it, the first of equals; none for a click elsewhere.

    Path and clicks lie on a grid of cells twice as wide as the reach: a click asks the
    four cells at most that its reach touches, by equality, so it meets the points near
    it and not the trial's path. Points in one place count once, by their first frame,
    and so do clicks in one place: an animal that rests makes no product.
    """
    cell = lambda x: F.floor(x / F.lit(2 * reach)).cast("long")
    c = F.col
    points = path.where(c("cx").isNotNull() & c("cy").isNotNull()).groupBy("trial_id", "cx", "cy").agg(F.min("frame_index").alias("frame_index"))
    points = points.withColumns({"_i": cell(c("cx")), "_j": cell(c("cy"))})
    cells = lambda x: F.explode(F.sequence(cell(c(x) - reach), cell(c(x) + reach)))
    places = clicks.select("trial_id", "x", "y").distinct().withColumn("_i", cells("x")).withColumn("_j", cells("y"))
    d = places.join(points, ["trial_id", "_i", "_j"])
    gap = F.sqrt((c("cx") - c("x")) ** 2 + (c("cy") - c("y")) ** 2)
    near = d.withColumn("d", gap).where(c("d") < reach).groupBy("trial_id", "x", "y").agg(F.min(F.struct("d", "frame_index")).alias("b"))
    best = clicks.join(near, ["trial_id", "x", "y"]).groupBy("trial_id", "click").agg(F.min("b").alias("b"))
    return best.select("trial_id", "click", F.col("b.frame_index").alias("frame_index"), F.col("b.d").alias("d"))
