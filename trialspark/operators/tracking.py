"""From detections to track states, as one window plan.

Everything is ordered inside a trial, so one exchange on trial_id serves all the
windows, and all have one order: it is sorted once before the regions are joined and
once after. A streak is a run of frames that are all found or all not.

* A vanish is judged once, on its first frame, by the state of the found streak
  that it ends, and holds for its streak.
* The nose has one bit of memory: which end it was on. A frame's rule maps the bit
  to a constant, to itself or to its opposite; so the end is the last constant,
  turned as often as opposites have come since.
* Two closing rules look at the run of rows at a trial's end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, nearest_hole
from ..params import TrackerParams

TRACKED, LOST, OCCLUDED, ESCAPED = "TRACKED", "LOST", "OCCLUDED_IN_HOLE", "IN_ESCAPE_BOX"
_STATE = ["trial_id", "frame_index", "state", "cx", "cy", "nx", "ny", "area", "hole_index"]


def streaks(detections: DataFrame) -> DataFrame:
    """``streak``, and ``place``: a row's number in its streak, from 0."""
    order = Window.partitionBy("trial_id").orderBy("frame_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    flip = F.coalesce((F.col("found") != F.lag("found").over(order)).cast("int"), F.lit(1))
    d = detections.withColumns({"flip": flip, "number": F.row_number().over(order)})
    start = F.max(F.when(F.col("flip") == 1, F.col("number"))).over(upto)
    return d.withColumns({"streak": F.sum("flip").over(upto), "place": F.col("number") - start}).drop("flip", "number")


def attribute_vanishes(detections: DataFrame, rois: DataFrame, params: TrackerParams = TrackerParams()) -> DataFrame:
    """``detections`` with streak, place, state, hole_index, before the closing rules.

    For these, target_hole and ``at``: the hole within reach of a found row, where it can
    matter, in a trial's last streak no further from its last row than two reaches.
    Holes are many beside a row, so they are looked at for these rows and vanishes alone.
    """
    order = Window.partitionBy("trial_id").orderBy("frame_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = F.col
    back = params.shrink_window - 1
    at_start = F.last(F.when(c("place") == 0, F.struct("area")), ignorenulls=True).over(upto)["area"]
    first = F.when(c("place") >= back, F.first("area").over(order.rowsBetween(-back, 0))).otherwise(at_start)
    d = streaks(detections).withColumns({"first_area": first, "end": F.last(F.struct("streak", "cx", "cy")).over(whole)})
    shrunk = (F.least(c("place"), F.lit(back)) >= 1) & (c("first_area") > 0) & ((c("first_area") - c("area")) / c("first_area") >= params.shrink_fraction)
    d = d.withColumn("shrunk", F.coalesce(shrunk, F.lit(False)))
    d = d.withColumns({f"was_{n}": F.lag(n).over(order) for n in ("shrunk", "cx", "cy")})
    d = d.join(rois.select("trial_id", "holes", (c("hole_radius") * params.near_factor).alias("reach"), "target_hole"), "trial_id")
    vanishes = (c("place") == 0) & ~c("found") & c("was_shrunk")
    # a little more than two reaches, so that no rounding leaves a row out
    closes = c("found") & (c("streak") == c("end.streak")) & (distance(c("cx"), c("cy"), c("end.cx"), c("end.cy")) <= c("reach") * (2 + 1e-6))
    x, y = (F.when(c("found"), c(n)).otherwise(c(f"was_{n}")) for n in ("cx", "cy"))
    d = d.withColumn("near", F.when(vanishes | closes, nearest_hole(x, y, c("holes"))))
    d = d.withColumn("entered", F.when(c("near.d") <= c("reach"), c("near.i"))).drop("holes", "reach", "near", "shrunk", "first_area", "end", "was_shrunk", "was_cx", "was_cy")
    # the streak's first row decides, NULL too
    hole = F.last(F.when(c("place") == 0, F.struct("entered")), ignorenulls=True).over(upto)["entered"]
    d = d.withColumn("hole_index", F.when(~c("found"), hole)).withColumn("at", F.when(c("found"), c("entered")))
    state = F.when(c("found"), TRACKED).when(c("hole_index").isNotNull(), OCCLUDED).otherwise(LOST)
    return d.withColumn("state", state).drop("entered")


def assign_noses(tracked: DataFrame, params: TrackerParams = TrackerParams()) -> DataFrame:
    """nx, ny: the axis end (ax, ay) or (bx, by) that is the nose of a found frame.

    Needs place. A frame without ends has no nose and no memory is left after it.
    """
    order = Window.partitionBy("trial_id").orderBy("frame_index")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    point = F.struct("cx", "cy")
    start = F.last(F.when(c("place") == 0, point), ignorenulls=True).over(upto)
    base = F.when(c("place") >= params.nose_window, F.first(point).over(order.rowsBetween(-params.nose_window, -1))).when(c("place") >= 1, start)
    d = tracked.withColumns({"span": F.least(c("place"), F.lit(params.nose_window)), "ends": c("ax").isNotNull() & c("bx").isNotNull()})
    before = {f"p_{n}": F.when(c("place") >= 1, F.lag(n).over(order)) for n in ("ax", "ay", "bx", "by", "ends")}
    d = d.withColumns({"base": base, **before})
    dx, dy = c("cx") - c("base.cx"), c("cy") - c("base.cy")
    fast = (c("span") > 0) & (F.sqrt(dx * dx + dy * dy) / F.nullif(c("span"), F.lit(0)) >= params.nose_speed)
    dot_a = (c("ax") - c("cx")) * dx + (c("ay") - c("cy")) * dy
    dot_b = (c("bx") - c("cx")) * dx + (c("by") - c("cy")) * dy

    def after(px: str, py: str):  # 0: end a, if the nose was at that point
        return F.when(distance(c("ax"), c("ay"), c(px), c(py)) <= distance(c("bx"), c("by"), c(px), c(py)), 0).otherwise(1)

    from_a, from_b = after("p_ax", "p_ay"), after("p_bx", "p_by")
    fixed = (
        F.when(~c("ends"), 0)
        .when(F.coalesce(fast, F.lit(False)), F.when(dot_a >= dot_b, 0).otherwise(1))
        .when(~F.coalesce(c("p_ends"), F.lit(False)), 0)
        .when(from_a == from_b, from_a)
    )
    d = d.withColumn("fixed", fixed).withColumn("turns", F.when(c("fixed").isNull() & (from_a == 1), 1).otherwise(0))
    # a streak's first row is always a constant
    d = d.withColumn("turned", F.sum("turns").over(upto))
    d = d.withColumn("mark", F.last(F.when(c("fixed").isNotNull(), F.struct("fixed", "turned")), ignorenulls=True).over(upto))
    d = d.withColumn("end_", (c("mark.fixed") + c("turned") - c("mark.turned")) % 2)
    nose = c("found") & c("ends")
    return d.withColumn("nx", F.when(nose, F.when(c("end_") == 0, c("ax")).otherwise(c("bx")))).withColumn(
        "ny", F.when(nose, F.when(c("end_") == 0, c("ay")).otherwise(c("by")))
    )


def _open_tracks(detections: DataFrame, rois: DataFrame, params: TrackerParams, keep: Sequence[str]) -> DataFrame:
    d = assign_noses(attribute_vanishes(detections, rois, params), params)
    found = F.col("found")
    return d.select(
        "trial_id", "frame_index", "state", *[F.when(found, F.col(c)).alias(c) for c in ("cx", "cy")], "nx", "ny",
        F.when(found, F.col("area")).otherwise(0).cast("double").alias("area"), "hole_index", "at", "target_hole", *keep,
    )


def raw_tracks(detections: DataFrame, rois: DataFrame, params: TrackerParams = TrackerParams()) -> DataFrame:
    return _open_tracks(detections, rois, params, ()).select(*_STATE)


def finalize(tracks: DataFrame, params: TrackerParams = TrackerParams()) -> DataFrame:
    """The closing rules: a trial that ends in the target hole, or in a shrinking
    approach to a hole. At most one applies, since they need other last states.

    Needs at and target_hole. A rule holds for the rows after the last that breaks it.
    """
    whole = Window.partitionBy("trial_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = F.col
    d = tracks.withColumns({"last_at": F.last("at").over(whole), "end_area": F.last("area").over(whole)})
    rules = {"waits": (c("state") == OCCLUDED) & (c("hole_index") == c("target_hole")), "comes": (c("state") == TRACKED) & (c("at") == c("last_at"))}
    broken = {n: F.max(F.when(~F.coalesce(holds, F.lit(False)), c("frame_index"))).over(whole) for n, holds in rules.items()}
    d = d.withColumns({n: F.coalesce(c("frame_index") > at, F.lit(True)) for n, at in broken.items()})
    d = d.withColumn("start_area", F.first(F.when(c("comes"), c("area")), ignorenulls=True).over(whole))
    enters = c("comes") & F.coalesce((c("start_area") > 0) & ((c("start_area") - c("end_area")) / c("start_area") >= params.shrink_fraction), F.lit(False))
    state = F.when(c("waits"), ESCAPED).when(enters, F.when(c("last_at") == c("target_hole"), ESCAPED).otherwise(OCCLUDED)).otherwise(c("state"))
    rest = [n for n in tracks.columns if n not in (*_STATE, "at", "target_hole")]
    return d.select(
        "trial_id", "frame_index", state.alias("state"), *[F.when(~enters, c(x)).alias(x) for x in ("cx", "cy", "nx", "ny")],
        F.when(enters, 0.0).otherwise(c("area")).alias("area"), F.when(enters, c("last_at")).otherwise(c("hole_index")).alias("hole_index"), *rest,
    )


def track(detections: DataFrame, rois: DataFrame, params: TrackerParams = TrackerParams(), keep: Sequence[str] = ()) -> DataFrame:
    """Tracks of all trials, with the columns ``keep`` of their detections.

    ``detections``: trial_id, frame_index, found, cx, cy, area, ax, ay, bx, by.
    ``rois``: trial_id, holes, hole_radius, target_hole.
    """
    return finalize(_open_tracks(detections, rois, params, keep), params)
