"""Queries by name, each with its SQL for the oracle where SQL can say it.

Doubles are rounded to 6 places on both sides, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import scalars
from ..functions.formula import formula_column
from ..operators import investigations as inv
from ..operators import demux, edits, measures, occupancy, overlays, report, roi, stats, strategy, timebase, tracking
from ..params import InvestigationParams
from ..sources import images, mp4, store, tables
from ..sources.files import shared_folder
from ..streaming import frames as frame_stream, tracker
from ..vision import detect, maze
from . import fixture, movies
from .fixture import CX, CY, DIAMETER, HOLE_RADIUS, HOLES, PLATFORM, RING, ROTATION, Trials, table
from .oracle import PER_CM, REACH, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if oracle:
            SQL[run.__name__] = oracle if plain else sql(oracle)
        return run

    return add


def trials(run: Callable[[Trials], DataFrame]) -> Query:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(Trials(spark, sf_dir))

    made.__name__ = run.__name__
    return made


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


XY = "round(cx, 6) AS cx, round(cy, 6) AS cy"


@query("SELECT trial_id, frame_index, found, cx, cy, area FROM det")
@trials
def frames_base(t: Trials) -> DataFrame:
    return t.detections.select("trial_id", "frame_index", "found", "cx", "cy", "area")


@query("SELECT trial_id, frame_index, round(t, 6) AS t FROM det")
@trials
def frame_times(t: Trials) -> DataFrame:
    return r6(t.times, "t")


@query("SELECT trial_id, frame_index, round(coalesce(lead(t) OVER (PARTITION BY trial_id ORDER BY frame_index) - t, 0), 6) AS duration, round(t + coalesce(lead(t) OVER (PARTITION BY trial_id ORDER BY frame_index) - t, 0) / 2, 3) AS seek FROM det")
@trials
def frame_durations(t: Trials) -> DataFrame:
    d = timebase.seek_times(t.times)
    return d.select("trial_id", "frame_index", F.round("duration", 6).alias("duration"), F.round("seek", 3).alias("seek"))


@query("""SELECT trial_id, modal_delta, off_modal_frames, round(off_modal_frames / frames::DOUBLE, 6) AS off_modal_fraction, distinct_deltas, distinct_deltas > 1 AS is_variable FROM (
  SELECT trial_id, arg_max(delta, n * 1000000 - delta) AS modal_delta, sum(n)::BIGINT - max(n) AS off_modal_frames, sum(n)::BIGINT AS frames, count(*) AS distinct_deltas FROM (
    SELECT trial_id, delta, count(*) AS n FROM (SELECT trial_id, (lead(us) OVER (PARTITION BY trial_id ORDER BY frame_index) - us) // 3600000000 AS delta FROM det) WHERE delta IS NOT NULL GROUP BY ALL
  ) GROUP BY trial_id)""")
@trials
def timebase_jitter(t: Trials) -> DataFrame:
    gap = F.lead("us").over(Window.partitionBy("trial_id").orderBy("frame_index")) - F.col("us")
    deltas = t.detections.select("trial_id", F.expr("NULL").alias("n"), gap.alias("gap")).where("gap is not null").select("trial_id", F.expr("gap div 3600000000").alias("delta"), F.lit(1).cast("long").alias("n"))
    return r6(timebase.jitter(deltas), "off_modal_fraction")


_RUNS = "SELECT p_partkey AS trial_id, 1 + p_partkey % 3 AS c0, 100 + p_size AS d0, 1 + p_partkey % 4 AS c1, 90 + p_partkey % 7 AS d1, 600 + p_size AS timescale FROM part"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    run = lambda c, d: F.struct(c.cast("int").alias("count"), d.cast("long").alias("delta"))
    return table(spark, sf_dir, "part").select(k.alias("trial_id"), (600 + size).cast("long").alias("timescale"), F.array(run(1 + k % 3, 100 + size), run(1 + k % 4, 90 + k % 7)).alias("stts"))


@query(f"""WITH runs AS ({_RUNS}), each AS (
  SELECT trial_id, timescale, unnest(range(0, c0)) AS i, 0 AS pos, d0 AS delta FROM runs UNION ALL SELECT trial_id, timescale, unnest(range(0, c1)), 1, d1 FROM runs)
SELECT trial_id, row_number() OVER w - 1 AS frame_index, (sum(delta) OVER w - delta)::BIGINT AS start_tick, delta::BIGINT AS delta, timescale::BIGINT AS timescale FROM each WINDOW w AS (PARTITION BY trial_id ORDER BY pos, i)""", plain=True)
def expand_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timebase.frame_times(_runs(spark, sf_dir))


@query(f"""WITH runs AS ({_RUNS}), by_delta AS (SELECT trial_id, timescale, d0::BIGINT AS delta, c0 AS n FROM runs UNION ALL SELECT trial_id, timescale, d1::BIGINT, c1 FROM runs),
sums AS (SELECT trial_id, timescale, delta, sum(n)::BIGINT AS n FROM by_delta GROUP BY ALL)
SELECT trial_id, sum(n)::BIGINT AS frame_count, sum(n * delta)::BIGINT AS duration_ticks, round(sum(n * delta) / timescale::DOUBLE, 6) AS duration_seconds, arg_max(delta, n * 100000 - delta) AS modal_delta,
  (timescale / gcd(timescale, arg_max(delta, n * 100000 - delta)))::BIGINT AS fps_num, (arg_max(delta, n * 100000 - delta) / gcd(timescale, arg_max(delta, n * 100000 - delta)))::BIGINT AS fps_den, count(*) AS distinct_deltas
FROM sums GROUP BY trial_id, timescale""", plain=True)
def timebase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = timebase.timebase(_runs(spark, sf_dir))
    return r6(d.select("trial_id", "frame_count", "duration_ticks", "duration_seconds", "modal_delta", F.col("nominal_fps.num").alias("fps_num"), F.col("nominal_fps.den").alias("fps_den"), "distinct_deltas"), "duration_seconds")


@query("""SELECT q.trial_id, q.asked AS "at", coalesce((SELECT max(frame_index) FROM det d WHERE d.trial_id = q.trial_id AND d.us <= q.asked), 0) AS frame_index
FROM (SELECT trial_id, min(us) + k * 86400000000 - 3600000000 AS asked FROM det, range(0, 30, 3) r(k) GROUP BY trial_id, k) q""")
@trials
def asof_frame_at_time(t: Trials) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(0), F.lit(27), F.lit(3)))
    wanted = t.detections.groupBy("trial_id").agg(F.min("us").alias("us")).select("trial_id", "us", steps.alias("k")).select("trial_id", (F.col("us") + F.col("k") * F.lit(86400000000) - F.lit(3600000000)).alias("at"))
    return timebase.frame_at_time(t.detections.select("trial_id", "frame_index", F.col("us").alias("start_tick")), wanted)


@query("SELECT trial_id, frame_index, near_i, round(near_d, 6) AS near_d FROM nearest JOIN det USING (trial_id, frame_index) WHERE NOT (cx = 320 AND cy = 240)")
@trials
def nearest_hole(t: Trials) -> DataFrame:
    d = t.detections.where(f"found and not (cx = {CX} and cy = {CY})").withColumn("near", g.nearest_hole(F.col("cx"), F.col("cy"), fixture.holes()))
    return d.select("trial_id", "frame_index", F.col("near.i").alias("near_i"), F.round("near.d", 6).alias("near_d"))


@query(f"""SELECT trial_id, frame_index, i AS hole FROM det, hole WHERE found AND sqrt((cx - hx) * (cx - hx) + (cy - hy) * (cy - hy)) <= {REACH}
QUALIFY row_number() OVER (PARTITION BY trial_id, frame_index ORDER BY sqrt((cx - hx) * (cx - hx) + (cy - hy) * (cy - hy)), i DESC) = 1""")
@trials
def nearest_hole_within(t: Trials) -> DataFrame:
    hole = g.nearest_hole_within(F.col("cx"), F.col("cy"), fixture.holes(), F.lit(REACH))
    return t.detections.where("found").select("trial_id", "frame_index", hole.alias("hole")).where("hole is not null")


@query("SELECT trial_id, frame_index, state, hole_index FROM raw")
@trials
def tracker_states(t: Trials) -> DataFrame:
    return tracking.raw_tracks(t.detections, t.rois).select("trial_id", "frame_index", "state", "hole_index")


@query("SELECT trial_id, frame_index, nx, ny FROM raw WHERE state = 'TRACKED'")
@trials
def tracker_nose(t: Trials) -> DataFrame:
    return tracking.raw_tracks(t.detections, t.rois).where("state = 'TRACKED'").select("trial_id", "frame_index", "nx", "ny")


@query("SELECT trial_id, frame_index, state, cx, cy, nx, ny, area, hole_index FROM tracks")
@trials
def tracker_finalize(t: Trials) -> DataFrame:
    return t.tracks


@query("SELECT trial_id, frame_index, state, cx, cy, nx, ny, is_corrected FROM frames")
@trials
def corrections_overlay(t: Trials) -> DataFrame:
    return overlays.apply_corrections(t.tracks, t.corrections).select("trial_id", "frame_index", "state", "cx", "cy", "nx", "ny", "is_corrected")


@query("SELECT * FROM held_runs")
@trials
def occlusion_runs(t: Trials) -> DataFrame:
    return inv.occlusion_runs(t.frames)


@query("SELECT * FROM close_runs")
@trials
def proximity_runs(t: Trials) -> DataFrame:
    return inv.proximity_runs(inv.near_holes(t.frames, t.rois))


@query("SELECT trial_id, hole_index, is_target, start_frame, end_frame, kind, ordinal FROM auto")
@trials
def investigations(t: Trials) -> DataFrame:
    return t.auto


@query("SELECT trial_id, id, hole_index, is_target, start_frame, end_frame, kind, source FROM edited")
@trials
def investigation_edits(t: Trials) -> DataFrame:
    return t.investigations.drop("ordinal")


@query("SELECT trial_id, id, hole_index, start_frame, visit FROM visited")
@trials
def visits(t: Trials) -> DataFrame:
    return overlays.visits(t.investigations).select("trial_id", "id", "hole_index", "start_frame", "visit")


@query("""SELECT v.trial_id, visit, min(hole_index) AS hole_index, min(start_frame) AS start_frame, least(max(end_frame), max(last_frame)) AS end_frame,
  CASE WHEN bool_or(kind = 'occlusion') THEN 'occlusion' ELSE arg_min(kind, start_frame) END AS kind
FROM visited v JOIN (SELECT trial_id, max(frame_index) AS last_frame FROM det GROUP BY trial_id) USING (trial_id) GROUP BY v.trial_id, visit""")
@trials
def visit_spans(t: Trials) -> DataFrame:
    last = t.detections.groupBy("trial_id").agg(F.max("frame_index").alias("last_frame"))
    return inv.visit_spans(overlays.visits(t.investigations), last)


@query("SELECT trial_id, round(primary_latency_s, 6) AS primary_latency_s, round(total_latency_s, 6) AS total_latency_s FROM measures")
@trials
def latency(t: Trials) -> DataFrame:
    return r6(t.measures.select("trial_id", "primary_latency_s", "total_latency_s"), "primary_latency_s", "total_latency_s")


@query("SELECT trial_id, target_frame, primary_errors, total_errors FROM errors JOIN firsts USING (trial_id)")
@trials
def errors(t: Trials) -> DataFrame:
    return measures.error_counts(t.investigations)


@query("SELECT trial_id, round(path_px, 6) AS path_px, round(path_length_cm, 6) AS path_length_cm, round(avg_speed_cm_s * 1000, 6) AS avg_speed_mm_100s FROM paths")
@trials
def path_speed(t: Trials) -> DataFrame:
    d = measures.path_measures(t.frames, t.rois)
    return r6(d.select("trial_id", "path_px", "path_length_cm", (F.col("avg_speed_cm_s") * 1000).alias("avg_speed_mm_100s")), "path_px", "path_length_cm", "avg_speed_mm_100s")


_Q = "round(q_target_s, 3) AS q_target_s, round(q_opposite_s, 3) AS q_opposite_s, round(q_cw_s, 3) AS q_cw_s, round(q_ccw_s, 3) AS q_ccw_s"


@query(f"SELECT trial_id, {_Q} FROM quadrants")
@trials
def quadrant_time(t: Trials) -> DataFrame:
    d = measures.quadrant_times(t.frames, t.rois)
    return d.select("trial_id", *[F.round(c, 3).alias(c) for c in overlays.QUADRANTS])


_M = "round(primary_latency_s, 3) AS primary_latency_s, round(total_latency_s, 3) AS total_latency_s, primary_errors, total_errors, round(path_length_cm, 3) AS path_length_cm, round(avg_speed_cm_s, 9) AS avg_speed_cm_s"


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({c: F.round(c, 9 if c == "avg_speed_cm_s" else 3) for c in overlays.MEASURES if not c.endswith("errors")})


@query(f"SELECT trial_id, {_M}, {_Q} FROM measures")
@trials
def trial_measures(t: Trials) -> DataFrame:
    return _rounded(t.measures)


@query(f"""SELECT trial_id, {_M}, {_Q}, by_hand FROM (
  SELECT trial_id, CASE WHEN trial_id % 10 = 0 THEN 12.5 ELSE primary_latency_s END AS primary_latency_s, total_latency_s, primary_errors, CASE WHEN trial_id % 10 = 0 THEN 7 ELSE total_errors END AS total_errors, path_length_cm, avg_speed_cm_s,
    CASE WHEN trial_id % 10 = 0 THEN 3.25 ELSE q_target_s END AS q_target_s, q_opposite_s, q_cw_s, q_ccw_s, CASE WHEN trial_id % 10 = 0 THEN 3 ELSE 0 END::BIGINT AS by_hand FROM measures)""")
@trials
def measure_overrides(t: Trials) -> DataFrame:
    d = overlays.apply_measure_overrides(t.measures, t.overrides)
    return _rounded(d.withColumn("by_hand", F.size("overridden").cast("long")).drop("overridden"))


@query("""SELECT trial_id AS video, count(*) AS "frameCount", count(*) FILTER (state = 'TRACKED') AS "trackedFrames", count(*) FILTER (state = 'LOST') AS "lostFrames",
  count(*) FILTER (state = 'OCCLUDED_IN_HOLE') AS "occludedInHoleFrames", count(*) FILTER (state = 'IN_ESCAPE_BOX') AS "inEscapeBoxFrames" FROM frames GROUP BY trial_id""")
@trials
def quality_report(t: Trials) -> DataFrame:
    return report.quality_rows(t.frames).select("video", "frameCount", "trackedFrames", "lostFrames", "occludedInHoleFrames", "inEscapeBoxFrames")


@query("""SELECT video, "frameCount", round(100.0::DOUBLE * tracked / "frameCount", 1) AS "trackedPercent", round(100.0::DOUBLE * lost / "frameCount", 1) AS "lostPercent", coalesce(n, 0) AS "longestLostRunFrames", round(t, 3) AS "longestLostRunStartSeconds" FROM (
  SELECT trial_id AS video, count(*) AS "frameCount", count(*) FILTER (state = 'TRACKED') AS tracked, count(*) FILTER (state = 'LOST') AS lost FROM frames GROUP BY trial_id) a
LEFT JOIN (
  SELECT trial_id, n, start FROM (SELECT trial_id, run, count(*) AS n, min(frame_index) AS start FROM (SELECT *, sum(CASE WHEN state <> 'LOST' THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM frames) WHERE state = 'LOST' GROUP BY trial_id, run)
  QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY n DESC, start) = 1) b ON b.trial_id = a.video
LEFT JOIN det d ON d.trial_id = b.trial_id AND d.frame_index = b.start""")
@trials
def quality_rows(t: Trials) -> DataFrame:
    return report.quality_rows(t.frames).select("video", "frameCount", "trackedPercent", "lostPercent", "longestLostRunFrames", "longestLostRunStartSeconds")


@query("SELECT trial_id, n AS longest_lost, start AS lost_start FROM (SELECT trial_id, run, count(*) AS n, min(frame_index) AS start FROM (SELECT *, sum(CASE WHEN state <> 'LOST' THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM simple) WHERE state = 'LOST' GROUP BY trial_id, run) QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY n DESC, start) = 1")
@trials
def longest_lost_run(t: Trials) -> DataFrame:
    return report.longest_lost_runs(t.simple)


@query("SELECT * FROM crossings")
@trials
def center_crossings(t: Trials) -> DataFrame:
    cut = strategy.cutoffs(t.frames, t.investigations)
    return strategy.center_crossings(t.frames.join(cut, "trial_id").where("frame_index <= cutoff_frame"), t.rois)


@query("SELECT trial_id, holes_in_order, round(order_score, 6) AS order_score FROM orders")
@trials
def hole_order(t: Trials) -> DataFrame:
    cut = strategy.cutoffs(t.frames, t.investigations)
    return r6(strategy.hole_order(t.investigations.join(cut, "trial_id").where("start_frame <= cutoff_frame"), t.rois), "order_score")


@query("SELECT trial_id, label, target_reached, cutoff_frame, round(directness, 6) AS directness, round(order_score, 6) AS order_score, errors, center_crossings FROM labelled")
@trials
def search_strategy(t: Trials) -> DataFrame:
    return r6(t.strategies.drop("reasoning"), "directness", "order_score")


@query("""SELECT trial_id, CASE WHEN trial_id % 20 = 0 THEN 'serial' ELSE label END AS label, trial_id % 20 = 0 AS is_overridden FROM labelled
UNION ALL SELECT trial_id, 'serial', true FROM roi WHERE trial_id % 20 = 0 AND trial_id NOT IN (SELECT trial_id FROM labelled)""")
@trials
def strategy_override(t: Trials) -> DataFrame:
    return strategy.override_label(t.strategies, t.overrides).select("trial_id", "label", "is_overridden")


_GRID = f"""SELECT trial_id, "row", "col", count(*) AS "count" FROM (
  SELECT trial_id, floor((cy - ({CY} - {PLATFORM})) / (2 * {PLATFORM} / 14))::BIGINT AS "row", floor((cx - ({CX} - {PLATFORM})) / (2 * {PLATFORM} / 14))::BIGINT AS "col" FROM frames WHERE state = 'TRACKED' AND cx IS NOT NULL
) WHERE "row" BETWEEN 0 AND 13 AND "col" BETWEEN 0 AND 13 GROUP BY ALL"""


@query(f'SELECT *, max("count") OVER (PARTITION BY trial_id) AS max_count FROM ({_GRID})')
@trials
def occupancy_grid(t: Trials) -> DataFrame:
    return occupancy.occupancy(t.frames, t.rois)


@query(f'SELECT r.trial_id, a.k AS "row", b.k AS "col", coalesce(c."count", 0) AS "count" FROM roi r, range(14) a(k), range(14) b(k) LEFT JOIN ({_GRID}) c ON c.trial_id = r.trial_id AND c."row" = a.k AND c."col" = b.k')
@trials
def occupancy_dense(t: Trials) -> DataFrame:
    return occupancy.dense(occupancy.occupancy(t.frames, t.rois), t.rois)


@query(f'SELECT trial_id, "row", "col", round(0.12::DOUBLE + 0.75::DOUBLE * "count" / max("count") OVER (PARTITION BY trial_id), 6) AS opacity FROM ({_GRID})')
@trials
def occupancy_heatmap(t: Trials) -> DataFrame:
    return r6(occupancy.heatmap(occupancy.occupancy(t.frames, t.rois)), "opacity").select("trial_id", "row", "col", "opacity")


@query("""SELECT c_mktsegment, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max, 0::BIGINT AS excluded
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""", plain=True)
def cohort_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    d = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return stats.describe(d, ["c_mktsegment"], "o_totalprice").withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


_CDF = "0.5 * (1 + (1 - (((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-x * x)))"
_MW = """WITH v AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'A' ELSE 'B' END AS grp, l_quantity AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
ranked AS (SELECT grp, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM v),
s AS (SELECT count(*) FILTER (grp = 'A')::DOUBLE AS na, count(*) FILTER (grp = 'B')::DOUBLE AS nb, sum(r) FILTER (grp = 'A') AS ra FROM ranked),
u AS (SELECT *, least(ra - na * (na + 1) / 2, na * nb - (ra - na * (na + 1) / 2)) AS u FROM s),
z AS (SELECT *, (u - na * nb / 2 + CASE WHEN u < na * nb / 2 THEN 0.5 ELSE -0.5 END) / sqrt(na * nb * (na + nb + 1) / 12) AS z FROM u),
p AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS k FROM z)
"""


@query(_MW + f"SELECT round(u, 3) AS u, round(z, 6) AS z, round(2 * (1 - {_CDF}), 6) AS p, na::BIGINT AS n_a, nb::BIGINT AS n_b, na < 8 OR nb < 8 AS small_sample, 2 * (1 - {_CDF}) < 0.05 AS significant, 0::BIGINT AS excluded FROM p", plain=True)
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    segment = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "A").otherwise("B").alias("grp"))
    d = lines.join(orders.join(segment, F.col("c_custkey") == F.col("o_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    out = stats.mann_whitney(d, "grp", "l_quantity")
    return out.withColumns({"u": F.round("u", 3), "z": F.round("z", 6), "p": F.round("p", 6)})


@query("SELECT l_quantity, count(*) AS n, min(r) AS rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem) GROUP BY l_quantity", plain=True)
def avg_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.average_ranks(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity")
    return d.groupBy("l_quantity").agg(F.count("*").alias("n"), F.min("rank").alias("rank"))


def _trial_rows(t: Trials) -> DataFrame:
    gap = F.lead("us").over(Window.partitionBy("trial_id").orderBy("frame_index")) - F.col("us")
    d = t.detections.select("trial_id", "us", gap.alias("gap"))
    base = d.groupBy("trial_id").agg(F.count("*").alias("frame_count"), ((F.max("us") - F.min("us")) / F.lit(1e6)).alias("duration_seconds")).withColumn("nominal_fps", F.struct(F.lit(30).cast("long").alias("num"), F.lit(1).cast("long").alias("den")))
    done = overlays.apply_measure_overrides(t.measures, t.overrides)
    labels = strategy.override_label(t.strategies, t.overrides)
    return report.trial_rows(done, labels, t.rois, base)


_TRIAL = f"""SELECT m.trial_id AS video, frames AS "frameCount", round(seconds, 3) AS "durationSeconds", {DIAMETER}::DOUBLE AS "platformDiameterCm", target_hole + 1 AS "targetHole",
  round(CASE WHEN m.trial_id % 10 = 0 THEN 12.5 ELSE primary_latency_s END, 3) AS "primaryLatencySeconds", round(total_latency_s, 3) AS "totalLatencySeconds", primary_errors AS "primaryErrors", CASE WHEN m.trial_id % 10 = 0 THEN 7 ELSE total_errors END AS "totalErrors",
  round(path_length_cm, 3) AS "pathLengthCm", round(CASE WHEN m.trial_id % 10 = 0 THEN 3.25 ELSE q_target_s END, 3) AS "quadrant1TargetSeconds", round(q_opposite_s, 3) AS "quadrant3OppositeSeconds", round(q_cw_s, 3) AS "quadrant2Seconds", round(q_ccw_s, 3) AS "quadrant4Seconds", round(avg_speed_cm_s, 9) AS "averageSpeedCmPerSecond", '30' AS "frameRateFps",
  CASE WHEN m.trial_id % 20 = 0 THEN 'serial' ELSE label END AS "searchStrategy", 1.5::DOUBLE AS "investigationRadiusFactor", 3::BIGINT AS "investigationMinFrames"
FROM measures m JOIN roi USING (trial_id) LEFT JOIN labelled l ON l.trial_id = m.trial_id JOIN (SELECT trial_id, count(*) AS frames, (max(us) - min(us)) / 1e6::DOUBLE AS seconds FROM det GROUP BY trial_id) b ON b.trial_id = m.trial_id"""


@query(_TRIAL)
@trials
def trial_rows(t: Trials) -> DataFrame:
    d = _trial_rows(t).drop("searchStrategyReasoning", "toolVersion").withColumn("averageSpeedCmPerSecond", F.round("averageSpeedCmPerSecond", 9))
    return d.withColumns({c: F.round(c, 3) for c in ("quadrant2Seconds", "quadrant4Seconds", "primaryLatencySeconds", "totalLatencySeconds", "pathLengthCm", "quadrant1TargetSeconds", "quadrant3OppositeSeconds")})


@query(f"""SELECT video, round("pathLengthCm" / ("totalErrors" + 1.37::DOUBLE), 3) AS x, round(-("quadrant1TargetSeconds" - "quadrant3OppositeSeconds") * 2 / nullif("totalErrors" - 3, 0), 3) AS y FROM ({_TRIAL})""")
@trials
def custom_formula(t: Trials) -> DataFrame:
    rows = trial_rows(t.spark, t.sf_dir)
    x = formula_column("pathLengthCm / (totalErrors + 1.37)")
    y = formula_column("-(quadrant1TargetSeconds - quadrant3OppositeSeconds) * 2 / (totalErrors - 3)")
    return rows.select("video", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""SELECT video, "totalErrors"::DOUBLE AS x, round("primaryLatencySeconds" / nullif("totalErrors" - 3, 0), 3) AS y FROM ({_TRIAL}) WHERE "primaryLatencySeconds" / nullif("totalErrors" - 3, 0) IS NOT NULL""")
@trials
def custom_metric_xy(t: Trials) -> DataFrame:
    points, _ = report.custom_scatter(trial_rows(t.spark, t.sf_dir), "totalErrors", "primaryLatencySeconds / (totalErrors - 3)")
    return points.withColumn("y", F.round("y", 3))


@query("""SELECT v.trial_id AS video, visit, hole_index + 1 AS hole, is_target AS "isTarget", source, kind AS "detectedBy", start_frame + 1 AS "startFrame", end_frame + 1 AS "endFrame", round(a.t, 3) AS "startSeconds", round(b.t, 3) AS "endSeconds"
FROM visited v LEFT JOIN det a ON a.trial_id = v.trial_id AND a.frame_index = start_frame LEFT JOIN det b ON b.trial_id = v.trial_id AND b.frame_index = end_frame""")
@trials
def investigation_rows(t: Trials) -> DataFrame:
    return report.investigation_rows(t.investigations, t.times)


@query(f"""SELECT row_number() OVER (ORDER BY us, video) AS trial, video, "primaryLatencySeconds" AS latency, "primaryLatencySeconds" IS NULL AS never, greatest(1.0::DOUBLE, max("primaryLatencySeconds") OVER ()) AS axis_top
FROM ({_TRIAL}) JOIN (SELECT trial_id, min(us) AS us FROM det GROUP BY trial_id) a ON a.trial_id = video""")
@trials
def learning_curve(t: Trials) -> DataFrame:
    added = t.detections.groupBy("trial_id").agg(F.min("us").alias("added_at"))
    return report.learning_curve(trial_rows(t.spark, t.sf_dir), added)


@query(f"""SELECT video, "primaryErrors", "totalErrors", "searchStrategy", greatest(1, max("totalErrors") OVER ()) AS axis_top FROM ({_TRIAL})""")
@trials
def cohort_comparison(t: Trials) -> DataFrame:
    return report.cohort_comparison(trial_rows(t.spark, t.sf_dir))


@query(f"SELECT i::BIGINT AS hole, round(hx, 6) AS x, round(hy, 6) AS y FROM hole")
def hole_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = g.hole_ring(F.lit(CX), F.lit(CY), F.lit(RING), F.lit(ROTATION), F.lit(HOLES))
    d = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.posexplode(ring).alias("hole", "p"))
    return d.select(F.col("hole").cast("long").alias("hole"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"""SELECT trial_id, round(2 * {PLATFORM} / {DIAMETER}::DOUBLE, 6) AS per_cm, round({RING} / (2 * {PLATFORM} / {DIAMETER}::DOUBLE), 6) AS ring_cm, round(2 * {RING} * sin(pi() / {HOLES}), 6) AS gap_px, round(10 * 2 * {PLATFORM} / {DIAMETER}::DOUBLE, 6) AS scale_bar_px, round(degrees({ROTATION}), 1) AS rotation_degrees FROM roi""")
@trials
def roi_calibration(t: Trials) -> DataFrame:
    d = roi.calibration(t.rois).withColumn("per_cm", F.col("scale_bar_px") / 10)
    return r6(d.select("trial_id", "per_cm", "ring_cm", "gap_px", "scale_bar_px", "rotation_degrees"), "per_cm", "ring_cm", "gap_px", "scale_bar_px")


@query("SELECT trial_id, true AS has_ring, target_hole IS NOT NULL AS has_target, true AS has_scale, target_hole IS NOT NULL AS is_complete FROM roi")
@trials
def roi_completeness(t: Trials) -> DataFrame:
    return roi.completeness(t.rois)


@query("""SELECT trial_id, event_id, CASE WHEN d < pi() / 4 OR d >= 7 * pi() / 4 THEN 'target' WHEN d < 3 * pi() / 4 THEN 'cw' WHEN d < 5 * pi() / 4 THEN 'opposite' ELSE 'ccw' END AS quadrant FROM (
  SELECT det.trial_id, event_id, ((a % (2 * pi())) + 2 * pi()) % (2 * pi()) AS d FROM (
    SELECT det.trial_id, event_id, ((atan2(cy - 240, cx - 320) % (2 * pi())) + 2 * pi()) % (2 * pi()) - ((atan2(hy - 240, hx - 320) % (2 * pi())) + 2 * pi()) % (2 * pi()) AS a FROM det JOIN roi USING (trial_id) JOIN hole ON i = target_hole WHERE found) det)""")
@trials
def quadrant_of(t: Trials) -> DataFrame:
    d = t.detections.where("found").join(t.rois.select("trial_id", F.get("holes", F.col("target_hole").cast("int")).alias("h")), "trial_id")
    return d.select("trial_id", "event_id", g.quadrant(F.col("cx"), F.col("cy"), F.lit(CX), F.lit(CY), F.col("h.x"), F.col("h.y")).alias("quadrant"))


@query("""SELECT p_partkey, CASE WHEN den = 1 THEN num::VARCHAR ELSE printf('%.3f', num / den::DOUBLE + 1e-9) || ' (' || num || '/' || den || ')' END AS fps, CASE WHEN 1 >= n / 40.0 THEN 1 WHEN 2 >= n / 40.0 THEN 2 WHEN 5 >= n / 40.0 THEN 5 WHEN 10 >= n / 40.0 THEN 10 WHEN 25 >= n / 40.0 THEN 25 WHEN 50 >= n / 40.0 THEN 50 ELSE 100 END AS step,
  (floor(s)::BIGINT // 60) || ':' || lpad((floor(s)::BIGINT % 60)::VARCHAR, 2, '0') AS length, (floor(s)::BIGINT // 60) || ':' || lpad(printf('%.2f', s - 60 * (floor(s)::BIGINT // 60)), 5, '0') AS "time", printf('%.2fs', s) AS seconds,
  CASE WHEN length(p_name) > 14 THEN substr(p_name, 1, 12) || '…' ELSE p_name END AS short, regexp_replace(regexp_replace(p_name || ' v1.mp4', '\\.[^.]*$', ''), '[^A-Za-z0-9_-]', '_', 'g') AS stem, regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') || '-2024-02-03.csv' AS dated
FROM (SELECT p_partkey, p_name, p_partkey // gcd(p_partkey, p_size) AS num, p_size // gcd(p_partkey, p_size) AS den, p_partkey % 4000 AS n, p_partkey % 4000 + p_partkey % 4 * 0.25::DOUBLE AS s FROM part)""", plain=True)
def scalar_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 4000
    r = scalars.reduce_rational(F.col("p_partkey"), F.col("p_size"))
    d = table(spark, sf_dir, "part").select("p_partkey", "p_name", r.alias("r"), n.alias("n"), (n + F.col("p_partkey") % 4 * 0.25).alias("s"))
    return d.select(
        "p_partkey", scalars.format_fps(F.col("r")).alias("fps"), scalars.tick_interval(F.col("n")).alias("step"), scalars.format_duration(F.col("s")).alias("length"), scalars.format_time(F.col("s")).alias("time"),
        scalars.format_seconds(F.col("s")).alias("seconds"), scalars.short_name(F.col("p_name")).alias("short"), scalars.file_stem(F.concat("p_name", F.lit(" v1.mp4"))).alias("stem"),
        scalars.dated_name(scalars.file_stem(F.col("p_name")), F.to_date(F.lit("2024-02-03")), "csv").alias("dated"),
    )


@query("""SELECT o_custkey AS trial_id, arg_max(o_totalprice, us) AS value FROM (SELECT *, epoch(o_orderdate)::BIGINT * 100000000 + o_orderkey AS us FROM orders) GROUP BY o_custkey HAVING arg_max(o_orderstatus, us) <> 'P'""", plain=True)
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trial_id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "P").alias("deleted"))
    return overlays.latest(log, ["trial_id"]).select("trial_id", "value")


@query("""SELECT s.trial_id, s.frame_index, max(p.frame_index) FILTER (p.frame_index < s.frame_index) AS previous_pin, min(p.frame_index) FILTER (p.frame_index > s.frame_index) AS next_pin
FROM (SELECT trial_id, frame_index FROM det WHERE event_id % 50 = 0) s LEFT JOIN (SELECT trial_id, frame_index FROM det WHERE event_id % 11 = 0) p USING (trial_id) GROUP BY ALL""")
@trials
def pin_neighbours(t: Trials) -> DataFrame:
    pick = lambda k: t.detections.where(f"event_id % {k} = 0").select("trial_id", "frame_index")
    return tables.neighbour_pins(pick(11), pick(50))


@query("SELECT trial_id, count(*) AS frames, count(*) - count(DISTINCT frame_index) AS duplicates, max(frame_index) + 1 - count(DISTINCT frame_index) AS missing, max(event_id % 9) AS max_displacement FROM det WHERE event_id % 13 <> 0 GROUP BY trial_id")
@trials
def frame_order_check(t: Trials) -> DataFrame:
    d = t.detections.where("event_id % 13 <> 0").select("trial_id", "frame_index", (F.col("frame_index") + F.col("event_id") % 9).alias("arrival"))
    return tables.check_order(d)


@query("SELECT trial_id, is_defined, is_tracked FROM (SELECT user_id AS trial_id, count(*) FILTER (event_type <> 'error') > 0 AS is_defined, count(*) FILTER (event_type = 'purchase') > 7 AS is_tracked FROM events GROUP BY user_id)", plain=True)
@trials
def cohort_status(t: Trials) -> DataFrame:
    videos = t.detections.select("trial_id").distinct()
    busy = table(t.spark, t.sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("trial_id")).count().where("count > 7")
    return report.status(videos, busy, t.rois)


@query(f"""SELECT l_partkey AS k, value AS threshold FROM (
  SELECT *, w * (total - w) * (s / w - (everything - s) / nullif(total - w, 0)) * (s / w - (everything - s) / nullif(total - w, 0)) AS variance FROM (
    SELECT l_partkey, value, (sum(n) OVER o)::DOUBLE AS w, (sum(n) OVER p)::DOUBLE AS total, (sum(n * value) OVER o)::DOUBLE AS s, (sum(n * value) OVER p)::DOUBLE AS everything FROM (
      SELECT l_partkey % 50 AS l_partkey, (l_extendedprice::BIGINT % 200)::INT AS value, count(*) AS n FROM lineitem GROUP BY ALL)
    WINDOW o AS (PARTITION BY l_partkey ORDER BY value), p AS (PARTITION BY l_partkey)) WHERE total > w
) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY variance DESC, value) = 1""", plain=True)
def otsu_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.rint("l_extendedprice").cast("long") % 200).cast("int")  # halves to the even number, as the SQL casts
    counts = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("k"), v.alias("value")).groupBy("k", "value").agg(F.count("*").alias("n"))
    return detect.otsu(counts, ["k"])


@query("SELECT ps AS cell, list_sort(list(v))[count(*) // 2 + 1] AS background FROM (SELECT l_suppkey % 10 * 10 + l_linenumber AS ps, (l_quantity)::INT AS v FROM lineitem) GROUP BY ps", plain=True)
def median_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of cells with any number of values: by counts, not by
    collecting them."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10 * 10 + F.col("l_linenumber")).alias("cell"), F.col("l_quantity").cast("int").alias("v"))
    counts = d.groupBy("cell", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("cell")))
    return d.where("upto > total div 2").groupBy("cell").agg(F.min("v").alias("background"))


_FIT = """WITH p AS (SELECT s_nationkey AS k, s_acctbal / 100 AS x, (s_suppkey * 37 % 101)::DOUBLE AS y FROM supplier), c AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM p WINDOW w AS (PARTITION BY k)),
m AS (SELECT k, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum((u * u + v * v) * u) / 2 AS qu, sum((u * u + v * v) * v) / 2 AS qv FROM c GROUP BY k),
f AS (SELECT k, mx + (qu * vv - qv * uv) / (uu * vv - uv * uv) AS cx, my + (qv * uu - qu * uv) / (uu * vv - uv * uv) AS cy FROM m WHERE n >= 3 AND abs(uu * vv - uv * uv) >= 1e-9)
SELECT f.k, round(cx, 4) AS cx, round(cy, 4) AS cy, round(median(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 4) AS radius FROM f JOIN p USING (k) GROUP BY f.k, cx, cy"""


@query(_FIT, plain=True)
def circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        got = maze.fit_circle(pdf.x.to_numpy(), pdf.y.to_numpy())
        return pd.DataFrame([[pdf.k.iloc[0], *got]] if got else [], columns=["k", "cx", "cy", "radius"])

    d = points.groupBy("k").applyInPandas(fit, "k int, cx double, cy double, radius double")
    return d.withColumns({c: F.round(c, 4) for c in ("cx", "cy", "radius")})


@query("SELECT trial_id, round(atan2(sum(sin(a)), sum(cos(a))), 6) AS mean_angle FROM (SELECT trial_id, atan2(cy - 240, cx - 320) AS a FROM det WHERE found) GROUP BY trial_id")
@trials
def circular_mean(t: Trials) -> DataFrame:
    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"trial_id": [pdf.trial_id.iloc[0]], "mean_angle": [round(maze.circular_mean(np.arctan2(pdf.cy - CY, pdf.cx - CX).to_numpy()), 6)]})

    return t.detections.where("found").select("trial_id", "cx", "cy").groupBy("trial_id").applyInPandas(mean, "trial_id long, mean_angle double")


#: Frames drawn at a time.
_DRAWN = 512


def _scenes(d: DataFrame) -> DataFrame:
    """Gray frames of a blob that moves as the trials do, one an event of ``d``."""
    names = ["trial_id", "frame_index", "width", "height", "pixels"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _DRAWN):
                batch = whole.slice(start, _DRAWN)
                n = batch.num_rows
                found, cx, cy = (batch.column(i).to_pylist() for i in (2, 3, 4))
                img = np.full((n, 120, 160), 180, np.uint8)
                for i in range(n):
                    if found[i]:
                        x, y = int(cx[i]) % 120 + 15, int(cy[i]) % 80 + 15
                        img[i, y : y + 8, x : x + 14] = 30
                ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (120 * 160))
                pixels = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(img)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.repeat(pa.scalar(160, pa.int32()), n), pa.repeat(pa.scalar(120, pa.int32()), n), pixels], names)

    return d.select("trial_id", "frame_index", "found", "cx", "cy").mapInArrow(draw, "trial_id long, frame_index long, width int, height int, pixels binary")


#: A 14 x 8 block of 30 on 180; its axis is level, so its ends are the middles of its sides.
_BLOB = "(cx::BIGINT % 120 + 120) % 120 + 15", "(cy::BIGINT % 80 + 80) % 80 + 15"


@query(f"""SELECT trial_id, frame_index, found, CASE WHEN found THEN x + 6.5 END AS cx, CASE WHEN found THEN y + 3.5 END AS cy, CASE WHEN found THEN 112 ELSE 0 END::DOUBLE AS area,
  CASE WHEN found THEN 0 END::DOUBLE AS orientation, CASE WHEN found THEN least(x, x + 13) END::DOUBLE AS low_x, CASE WHEN found THEN x + 13 END::DOUBLE AS high_x,
  18::DOUBLE AS threshold, CASE WHEN found THEN 1 ELSE 0 END::INT AS candidate_count, 0::DOUBLE AS runner_up_area
FROM (SELECT *, {_BLOB[0]} AS x, {_BLOB[1]} AS y FROM det)""")
def detect_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Trials(spark, sf_dir).detections
    ground = detect.medians(_scenes(detect.sampled_frames(events)))
    d = detect.detect(_scenes(events), ground, index=events)
    return d.select("trial_id", "frame_index", "found", "cx", "cy", "area", F.abs(F.round("orientation", 6)).alias("orientation"), F.least("ax", "bx").alias("low_x"), F.greatest("ax", "bx").alias("high_x"), "threshold", "candidate_count", "runner_up_area")


#: Opening keeps the 5 x 5 squares that fit into blob and platform; a round platform
#: holds a square if it holds its corners.
_INSIDE = " AND ".join(f"(x + a + {p} - 80) * (x + a + {p} - 80) + (y + b + {q} - 60) * (y + b + {q} - 60) <= 2500" for p in (0, 4) for q in (0, 4))


@query(f"""SELECT trial_id, frame_index, coalesce(n >= 60, false) AS found, CASE WHEN n >= 60 THEN n ELSE 0 END::DOUBLE AS area, CASE WHEN n >= 60 THEN round(sx / n, 6) END AS cx, CASE WHEN n >= 60 THEN round(sy / n, 6) END AS cy, coalesce(n >= 60, false)::INT AS candidate_count
FROM (SELECT *, CASE WHEN found THEN {_BLOB[0]} END AS x, CASE WHEN found THEN {_BLOB[1]} END AS y FROM det) d LEFT JOIN (
  SELECT x, y, count(*) AS n, sum(x + i) AS sx, sum(y + j) AS sy FROM (
    SELECT DISTINCT x, y, a + p AS i, b + q AS j FROM (SELECT DISTINCT {_BLOB[0]} AS x, {_BLOB[1]} AS y FROM det WHERE found), range(0, 10) r(a), range(0, 4) s(b), range(0, 5) t(p), range(0, 5) u(q) WHERE {_INSIDE})
  GROUP BY x, y) m USING (x, y)""")
def detect_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection inside a round platform, which cuts some of the blobs."""
    events = Trials(spark, sf_dir).detections
    ground = detect.medians(_scenes(detect.sampled_frames(events)))
    rois = events.select("trial_id").distinct().select("trial_id", F.lit(80.0).alias("center_x"), F.lit(60.0).alias("center_y"), F.lit(50.0).alias("platform_radius"))
    d = detect.detect(_scenes(events), ground, rois, index=events)
    return r6(d.select("trial_id", "frame_index", "found", "area", "cx", "cy", "candidate_count"), "cx", "cy")


@query("SELECT n_nationkey AS trial_id, true AS ok, 20 AS hole_count, 20 AS matched_holes, 82.0::DOUBLE AS ring_radius, true AS turned_right FROM nation", plain=True)
def detect_maze(spark: SparkSession, sf_dir: str) -> DataFrame:
    def draw(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                y, x = np.mgrid[:240, :320]
                img = np.where((x - 160) ** 2 + (y - 120) ** 2 <= 10_000, 190, 40).astype(np.uint8)
                for k in range(20):
                    a = 0.1 + 0.01 * r.n_nationkey + k * 2 * np.pi / 20
                    img[(x - 160 - 82 * np.cos(a)) ** 2 + (y - 120 - 82 * np.sin(a)) ** 2 <= 25] = 55
                rows.append((r.n_nationkey, 320, 240, img.tobytes()))
            yield pd.DataFrame(rows, columns=["trial_id", "width", "height", "pixels"])

    frames = table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(draw, "trial_id int, width int, height int, pixels binary")
    d = maze.detect_mazes(frames)
    slot = 2 * np.pi / 20
    off = F.pmod(F.col("rotation") - (0.1 + 0.01 * F.col("trial_id")) + slot / 2, F.lit(slot)) - slot / 2
    return d.select("trial_id", "ok", "hole_count", "matched_holes", F.round("ring_radius").alias("ring_radius"), (F.abs(off) < 0.01).alias("turned_right"))


@query("""SELECT trial_id, id, CASE WHEN id = 'manual-1' THEN trial_id % 20 ELSE 5 END AS hole_index, CASE WHEN id = 'manual-1' THEN 4 ELSE 10 END::BIGINT AS start_frame,
  CASE WHEN id = 'm-2' THEN 12 WHEN trial_id % 6 = 0 THEN 15 ELSE 9 END::BIGINT AS end_frame, CASE WHEN id = 'm-2' AND trial_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS ordinal
FROM roi, (VALUES ('manual-1'), ('m-2')) v(id) WHERE (id = 'manual-1' AND trial_id % 3 = 0 AND trial_id % 9 <> 0) OR (id = 'm-2' AND trial_id % 2 = 0)""")
@trials
def edit_manual(t: Trials) -> DataFrame:
    """Manual events after an addition, an update and a deletion."""
    pick = lambda k, i: t.rois.where(f"trial_id % {k} = 0").select("trial_id", F.lit(i).alias("id"))
    new = pick(2, "m-2").select("*", *[F.lit(v).cast("long").alias(c) for c, v in zip(edits.FIELDS, (5, 10, 12), strict=True)])
    d = edits.add_manual(t.manual, new.unionByName(new))
    d = edits.update_manual(d, pick(6, "manual-1").withColumn("end_frame", F.lit(15).cast("long")))
    return edits.delete_manual(d, pick(9, "manual-1")).select("trial_id", "id", *edits.FIELDS, "ordinal")


@query("""SELECT trial_id, id FROM (SELECT trial_id, start_frame, 'auto-' || start_frame AS id FROM auto) WHERE start_frame % 5 = 0 OR start_frame % 7 = 0""")
@trials
def edit_removed(t: Trials) -> DataFrame:
    gone = t.auto.where("start_frame % 7 = 0").select("trial_id", scalars.auto_id(F.col("start_frame")).alias("id"))
    return edits.remove_auto(edits.remove_auto(t.removed, gone), gone)


@query("""SELECT trial_id, CASE WHEN trial_id % 10 = 0 AND trial_id % 15 <> 0 THEN 12.5 END::DOUBLE AS primary_latency_s, CASE WHEN trial_id % 4 = 0 THEN 2 ELSE 7 END::BIGINT AS total_errors,
  CASE WHEN trial_id % 4 = 0 THEN 1.5 END::DOUBLE AS path_length_cm, CASE WHEN trial_id % 10 = 0 THEN 3.25 END::DOUBLE AS q_target_s, CASE WHEN trial_id % 20 = 0 AND trial_id % 40 <> 0 THEN 'serial' END AS search_strategy
FROM roi WHERE trial_id % 10 = 0 OR trial_id % 4 = 0""")
@trials
def edit_overrides(t: Trials) -> DataFrame:
    """Overrides after values were set and cleared."""
    changes = t.rois.where("trial_id % 4 = 0").select("trial_id", F.lit(2).cast("long").alias("total_errors"), F.lit(1.5).alias("path_length_cm"))
    cleared = t.rois.where("trial_id % 15 = 0").select("trial_id", F.lit("primary_latency_s").alias("key")).unionByName(t.rois.where("trial_id % 40 = 0").select("trial_id", F.lit("search_strategy").alias("key")))
    d = edits.clear_overrides(edits.set_overrides(t.overrides, changes), cleared)
    return d.select("trial_id", "primary_latency_s", "total_errors", "path_length_cm", "q_target_s", "search_strategy")


@query("""SELECT trial_id, frame_index, CASE WHEN event_id % 97 = 0 THEN cx + 5 WHEN found THEN cx ELSE cx + 1 END AS cx, CASE WHEN event_id % 97 = 0 THEN cy - 5 WHEN found THEN cy ELSE cy + 1 END AS cy,
  CASE WHEN event_id % 101 = 0 THEN cx + 1 WHEN event_id % 2 = 1 THEN cx + 9 END AS nx, CASE WHEN event_id % 101 = 0 THEN cy + 1 WHEN event_id % 2 = 1 THEN cy - 9 END AS ny
FROM det WHERE (event_id % 97 = 0 OR event_id % 101 = 0) AND event_id % 194 <> 0""")
@trials
def edit_corrections(t: Trials) -> DataFrame:
    """Corrections after noses were set and some frames reverted."""
    points = t.detections.where("event_id % 101 = 0").select("trial_id", "frame_index", F.lit("nose").alias("which"), (F.col("cx") + 1).alias("x"), (F.col("cy") + 1).alias("y"))
    d = edits.set_corrections(t.corrections, t.simple, points)
    return edits.revert_corrections(d, t.detections.where("event_id % 194 = 0"))


@query("SELECT trial_id, frame_index FROM det WHERE (event_id % 11 = 0) <> (event_id % 50 = 0)")
@trials
def pin_toggle(t: Trials) -> DataFrame:
    pick = lambda k: t.detections.where(f"event_id % {k} = 0").select("trial_id", "frame_index")
    return edits.toggle_pins(pick(11), pick(50))


@query("SELECT o_custkey % 50 AS trial_id, o_orderkey AS seq, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey DESC) <= 20", plain=True)
def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.history(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("trial_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value")))


@query("""SELECT trial_id, click, frame_index, round(d, 6) AS d FROM (
  SELECT c.trial_id, c.frame_index AS click, p.frame_index, sqrt((p.cx - c.cx - 2) * (p.cx - c.cx - 2) + (p.cy - c.cy + 1) * (p.cy - c.cy + 1)) AS d FROM det c JOIN det p ON p.trial_id = c.trial_id AND p.found)
WHERE d < 14 QUALIFY row_number() OVER (PARTITION BY trial_id, click ORDER BY d, frame_index) = 1""")
@trials
def nearest_click(t: Trials) -> DataFrame:
    clicks = t.detections.select("trial_id", F.col("frame_index").alias("click"), (F.col("cx") + 2).alias("x"), (F.col("cy") - 1).alias("y"))
    return r6(edits.nearest_point(t.simple, clicks), "d")


@query("SELECT trial_id, 2.5::DOUBLE AS radius_factor, 4::BIGINT AS min_frames FROM (SELECT user_id AS trial_id, count(*) FILTER (event_type <> 'error') > 0 AS a, count(*) FILTER (event_type = 'purchase') > 7 AS b FROM events GROUP BY user_id) WHERE a AND b", plain=True)
@trials
def cohort_assembly(t: Trials) -> DataFrame:
    videos = t.detections.select("trial_id").distinct()
    busy = table(t.spark, t.sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("trial_id")).count().where("count > 7")
    params = table(t.spark, t.sf_dir, "region").where("r_regionkey = 0").select(F.lit(2.5).alias("radius_factor"), F.lit(4).cast("long").alias("min_frames"))
    return report.cohort(videos, busy, t.rois, params)


@query("SELECT user_id AS trial_id, floor(100.0::DOUBLE * count(*) FILTER (event_type = 'click') / count(*) + 0.5)::BIGINT AS phase_percent, count(*) FILTER (event_type <> 'error') > 0 AS is_defined FROM events GROUP BY user_id", plain=True)
@trials
def job_status(t: Trials) -> DataFrame:
    events = table(t.spark, t.sf_dir, "events").groupBy(F.col("user_id").alias("trial_id")).agg(F.count_if(F.col("event_type") == "click").alias("frames_done"), F.count("*").alias("frames"))
    videos = t.detections.select("trial_id").distinct()
    return report.status(videos, videos, t.rois, events).select("trial_id", "phase_percent", "is_defined")


_SIX = " UNION ALL ".join(f"SELECT trial_id, '{m}' AS measure, round({m}::DOUBLE, 6) AS x FROM measures" for m in stats.COMPARED)


@query(f"""SELECT measure, round(u, 3) AS u, round(z, 6) AS z, round(2 * (1 - {_CDF}), 6) AS p, na::BIGINT AS n_a, nb::BIGINT AS n_b, na < 8 OR nb < 8 AS small_sample, excluded FROM (
  SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS k FROM (
    SELECT *, (u - na * nb / 2 + CASE WHEN u < na * nb / 2 THEN 0.5 ELSE -0.5 END) / sqrt(na * nb * (na + nb + 1) / 12) AS z FROM (
      SELECT *, least(ra - na * (na + 1) / 2, na * nb - (ra - na * (na + 1) / 2)) AS u FROM (
        SELECT measure, (count(*) FILTER (grp = 'A' AND x IS NOT NULL))::DOUBLE AS na, (count(*) FILTER (grp = 'B' AND x IS NOT NULL))::DOUBLE AS nb, sum(r) FILTER (grp = 'A' AND x IS NOT NULL) AS ra, count(*) FILTER (x IS NULL) AS excluded FROM (
          SELECT *, rank() OVER (PARTITION BY measure ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY measure, x) - 1) / 2.0::DOUBLE AS r FROM (
            SELECT measure, x, CASE trial_id % 3 WHEN 0 THEN 'A' ELSE 'B' END AS grp FROM ({_SIX}) WHERE trial_id % 3 < 2)) GROUP BY measure))))""")
@trials
def cohort_statistics(t: Trials) -> DataFrame:
    """Six measures of two groups of trials, some of which have no value."""
    groups = t.rois.where("trial_id % 3 < 2").select("trial_id", F.when(F.col("trial_id") % 3 == 0, "A").otherwise("B").alias("grp"))
    d = t.measures.withColumns({m: F.round(F.col(m).cast("double"), 6) for m in stats.COMPARED})
    out = stats.compare_groups(d, groups).drop("significant")
    return out.withColumns({"u": F.round("u", 3), "z": F.round("z", 6), "p": F.round("p", 6)})


@query(f"""WITH runs AS ({_RUNS}), each AS (
  SELECT trial_id, timescale, unnest(range(0, c0)) AS i, 0 AS pos, d0 AS delta FROM runs UNION ALL SELECT trial_id, timescale, unnest(range(0, c1)), 1, d1 FROM runs)
SELECT * FROM (SELECT trial_id, row_number() OVER w - 1 AS frame_index, round((sum(delta) OVER w - delta) / timescale::DOUBLE, 6) AS seconds FROM each WINDOW w AS (PARTITION BY trial_id ORDER BY pos, i)) WHERE frame_index % 2 = 0""", plain=True)
def frame_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = timebase.frame_times(_runs(spark, sf_dir))
    return r6(timebase.time_of(times, times.where("frame_index % 2 = 0").select("trial_id", "frame_index")), "seconds")


#: Samples lie in chunks of 3, 3, 3, then 5, from byte 24 on, with 7 bytes between.
_SAMPLES = """chunked AS (SELECT trial_id, event_id, frame_index AS sample, 20 + event_id % 50 AS size, CASE WHEN event_id % 3 = 0 THEN 45 ELSE 40 END AS delta, event_id % 4 * 60 - 60 AS shift,
    CASE WHEN frame_index < 9 THEN frame_index // 3 ELSE 3 + (frame_index - 9) // 5 END AS chunk FROM det),
timed AS (SELECT *, sum(delta) OVER w - delta AS tick, 24 + 7 * chunk + sum(size) OVER w - size AS spot FROM chunked WINDOW w AS (PARTITION BY trial_id ORDER BY sample))"""


def _trial_of_path() -> F.Column:
    return F.regexp_extract("path", r"trial-(\d+)\.mp4$", 1).cast("long").alias("trial_id")


@query(f"""SELECT * FROM (WITH {_SAMPLES} SELECT trial_id, sample, chunk::BIGINT AS chunk, spot::BIGINT AS "offset", size, tick::BIGINT AS tick, delta::BIGINT AS delta, (tick + shift)::BIGINT AS composition_tick,
  row_number() OVER (PARTITION BY trial_id ORDER BY tick + shift, sample) - 1 AS composition_index, sample = 0 OR event_id % 10 = 0 AS is_key, event_id % 251 AS first_byte, true AS whole FROM timed)""")
@trials
def video_samples(t: Trials) -> DataFrame:
    """A video file of each trial, demuxed: where its samples lie, when they are shown,
    and their bytes as fetched from there."""
    moov = mp4.read_mp4(t.spark, movies.write_movies(t.spark, t.detections), "moov", files_per_partition=8)
    d = demux.sample_data(demux.samples(moov, expected=t.detections.count()).sortWithinPartitions("path", "offset"))
    byte = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("long")
    return d.select(_trial_of_path(), "sample", "chunk", "offset", "size", "tick", "delta", "composition_tick", "composition_index", "is_key", byte.alias("first_byte"), (F.octet_length("data") == F.col("size")).alias("whole"))


@query(f"""SELECT * FROM (WITH {_SAMPLES}, total AS (SELECT trial_id, count(*) AS samples, sum(delta)::BIGINT AS ticks, sum(size)::BIGINT AS bytes FROM timed GROUP BY trial_id)
SELECT trial_id, 'trial-' || trial_id || '.mp4' AS name, true AS ok, 1000::BIGINT AS timescale, samples, ticks, 'avc1.64001e' AS codec, 64 AS width, 48 AS height FROM total)""")
@trials
def video_tracks(t: Trials) -> DataFrame:
    """The files' timing and codec, read from their tables alone."""
    d = mp4.read_mp4(t.spark, movies.write_movies(t.spark, t.detections), files_per_partition=8)
    ticks = F.aggregate("stts", F.lit(0).cast("long"), lambda a, r: a + r["count"] * r["delta"])
    return d.select(_trial_of_path(), "name", "ok", "timescale", "samples", ticks.alias("ticks"), "codec", "width", "height")


#: Spans that overlap and nest: edited events, and a longer one of every fourth event.
_SPANS = """SELECT trial_id, start_frame, end_frame FROM edited UNION ALL SELECT trial_id, frame_index, frame_index + event_id % 9 - 1 FROM det WHERE event_id % 4 = 0"""


@query(f"""SELECT trial_id, frame_index, EXISTS (SELECT 1 FROM ({_SPANS}) s WHERE s.trial_id = d.trial_id AND d.frame_index BETWEEN s.start_frame AND s.end_frame) AS covered FROM det d""")
@trials
def covered_frames(t: Trials) -> DataFrame:
    more = t.detections.where("event_id % 4 = 0").select("trial_id", F.col("frame_index").alias("start_frame"), (F.col("frame_index") + F.col("event_id") % 9 - 1).alias("end_frame"))
    spans = t.investigations.select("trial_id", F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame")).unionByName(more)
    return inv.covered(t.detections.select("trial_id", "frame_index"), spans)


@query("""SELECT trial_id, frame_index, state, round(cx, 6) AS cx, round(cy, 6) AS cy, round(nx, 6) AS nx, round(ny, 6) AS ny, area, hole_index::BIGINT AS hole_index FROM tracks""")
@trials
def stream_tracks(t: Trials) -> DataFrame:
    """The tracker as a stream: frames come in bounded batches, each trial's ring is its
    initial state, an end marker closes it."""
    spark = t.spark
    cols = ["trial_id", "frame_index", "found", "cx", "cy", "area", "ax", "ay", "bx", "by"]
    found = t.detections.select(*cols)
    ends = t.rois.select("trial_id", *[F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in cols[1:]])
    folder, out = shared_folder(spark, "frames"), shared_folder(spark, "tracks")
    inputs = found.join(t.rois.select("trial_id"), "trial_id", "left_semi").unionByName(ends)
    # videos come one after another, so that few batches meet a trial again
    order = ["trial_id", F.asc_nulls_last("frame_index")]
    inputs.repartitionByRange(8, *order).sortWithinPartitions(*order).write.parquet(folder)
    frames = frame_stream.read_frames(spark, folder, found.schema, max_frames=20_000)
    q = tracker.track_trials(frames, t.rois).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "stream")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return r6(spark.read.parquet(out).where("error is null").drop("error"), "cx", "cy", "nx", "ny")


@query("""SELECT trial_id, target_hole::BIGINT AS target_hole, CASE WHEN trial_id % 5 = 0 THEN 99.5 WHEN trial_id % 7 = 3 THEN 50 ELSE 92 END::DOUBLE AS platform_diameter_cm, CASE WHEN trial_id % 3 = 1 THEN 'late' END AS note, coalesce(pins, 0) AS pins
FROM roi LEFT JOIN (SELECT trial_id, count(*) AS pins FROM det WHERE event_id % 11 = 0 GROUP BY trial_id) USING (trial_id) WHERE trial_id % 6 <> 0 OR trial_id % 5 = 0""")
@trials
def stored_regions(t: Trials) -> DataFrame:
    """Regions and pins in a store after an upsert, a partial update, a new column, a
    cascading delete, a key put again and a compaction."""
    s = store.Store(t.spark, shared_folder(t.spark, "store"), {"regions": ["trial_id"], "pins": ["trial_id", "frame_index"]})
    regions = t.rois.select("trial_id", F.col("target_hole").cast("long").alias("target_hole"), "platform_diameter_cm")
    pins = t.detections.where("event_id % 11 = 0").select("trial_id", "frame_index")
    s.commit({"regions": store.Change(put=regions), "pins": store.Change(put=pins)})
    s.update("regions", regions.where("trial_id % 7 = 3").select("trial_id", F.lit(50.0).alias("platform_diameter_cm")))
    s.put("regions", s.read("regions").where("trial_id % 3 = 1").withColumn("note", F.lit("late")))
    s.delete(regions.where("trial_id % 6 = 0").select("trial_id"))
    again = regions.where("trial_id % 5 = 0").withColumns({"platform_diameter_cm": F.lit(99.5), "note": F.when(F.col("trial_id") % 3 == 1, "late")})
    s.commit({"regions": store.Change(put=again), "pins": store.Change(put=pins.where("trial_id % 5 = 0"))})
    s.compact("regions", 4)
    counts = s.read("pins").groupBy("trial_id").agg(F.count("*").alias("pins"))
    return s.read("regions").join(counts, "trial_id", "left").select("trial_id", "target_hole", "platform_diameter_cm", "note", F.coalesce("pins", F.lit(0)).alias("pins"))


@query(f"""SELECT trial_id, frame_index, round(sqrt((cx - {CX}) * (cx - {CX}) + (cy - {CY}) * (cy - {CY})), 6) AS platform_radius, round(sqrt((ax - {CX}) * (ax - {CX}) + (ay - {CY}) * (ay - {CY})), 6) AS ring_radius,
  round(atan2(ay - {CY}, ax - {CX}), 6) AS rotation, (5 + event_id % 30)::BIGINT AS hole_count, CASE WHEN event_id % 3 > 0 THEN round(cx / (event_id % 3), 6) END AS cm FROM det""")
@trials
def ring_clicks(t: Trials) -> DataFrame:
    """A ring from three clicks of each frame, and lengths where there is a scale."""
    c, middle = F.col, (F.lit(CX), F.lit(CY))
    ring = g.ring_from_clicks(*middle, c("cx"), c("cy"), c("ax"), c("ay"), (5 + c("event_id") % 30).cast("long"))
    d = t.detections.select("trial_id", "frame_index", ring.alias("r"), g.px_to_cm(c("cx"), (c("event_id") % 3).cast("double")).alias("cm"))
    return r6(d.select("trial_id", "frame_index", "r.*", "cm"), "platform_radius", "ring_radius", "rotation", "cm")


@query("""SELECT event_id, round(CASE WHEN top <= 0 THEN 1 ELSE p * CASE WHEN raw / p < 1.5 THEN 1 WHEN raw / p < 3 THEN 2 WHEN raw / p < 7 THEN 5 ELSE 10 END END, 6) AS step, greatest(-20.0::DOUBLE, least(300.0::DOUBLE, floor(top + 0.5)))::BIGINT AS held
FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(raw))) AS p FROM (SELECT *, greatest(top, 1e-300::DOUBLE) / 5 AS raw FROM (SELECT event_id, ((event_id % 977 - 40) * 1.37)::DOUBLE AS top FROM events)))""", plain=True)
def axis_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an axis up to each value, and values held in a range."""
    top = (F.col("event_id") % 977 - 40) * F.lit(1.37)
    held = scalars.clamp(top, F.lit(-20), F.lit(300)).cast("long")
    return r6(table(spark, sf_dir, "events").select("event_id", scalars.nice_tick_step(top, 5).cast("double").alias("step"), held.alias("held")), "step")


@query(f"""WITH first AS (SELECT min(trial_id) AS m FROM roi WHERE trial_id % 4 <> 0)
SELECT v.trial_id, (CASE WHEN r.trial_id IS NULL THEN (SELECT target_hole FROM roi WHERE trial_id = m) ELSE r.target_hole END)::BIGINT AS target_hole,
  CASE WHEN r.trial_id IS NULL THEN 'template' ELSE 'own' END AS source, CASE WHEN coalesce(r.trial_id, m) % 3 = 0 THEN 80.5 ELSE {DIAMETER} END::DOUBLE AS platform_diameter_cm
FROM (SELECT DISTINCT trial_id FROM det) v CROSS JOIN first LEFT JOIN (SELECT * FROM roi WHERE trial_id % 4 <> 0) r USING (trial_id)""".replace("WITH first AS", "SELECT * FROM (WITH first AS") + ")")
@trials
def region_defaults(t: Trials) -> DataFrame:
    """Trials without a region take the template, regions without a diameter the setting."""
    own = t.rois.where("trial_id % 4 <> 0").select("trial_id", F.col("target_hole").cast("long").alias("target_hole"), F.lit("own").alias("source"), F.when(F.col("trial_id") % 3 != 0, F.col("platform_diameter_cm")).alias("platform_diameter_cm"))
    setting = table(t.spark, t.sf_dir, "region").where("r_regionkey = 0").select(F.lit(80.5).alias("diameter_cm"))
    whole = roi.from_template(own, own.orderBy("trial_id"), t.detections.select("trial_id").distinct())
    return roi.with_default_diameter(whole, setting)


@query(f"""SELECT trial_id, k::BIGINT AS k, round(atan2(hy - {CY}, hx - {CX}) + (2 * k + 1) * pi() / 4, 6) AS border FROM roi JOIN hole ON i = target_hole, range(0, 4) r(k)""")
@trials
def quadrant_borders(t: Trials) -> DataFrame:
    d = roi.quadrant_legend(t.rois).select("trial_id", F.posexplode("borders").alias("k", "border"))
    return r6(d.withColumn("k", F.col("k").cast("long")), "border")


@query("""WITH v AS (SELECT user_id AS trial_id, epoch_us(min(ts)) AS us FROM events GROUP BY user_id), e AS (SELECT min(trial_id) AS a, max(trial_id) AS b FROM v)
SELECT trial_id, CASE trial_id WHEN a THEN (SELECT us FROM v WHERE trial_id = b) WHEN b THEN (SELECT us FROM v WHERE trial_id = a) ELSE us END AS added_at, trial_id % 3 <> 0 AS is_new FROM v, e""", plain=True)
@trials
def video_order(t: Trials) -> DataFrame:
    """Videos after two of them traded places, and which of them weren't loaded yet."""
    videos = t.detections.groupBy("trial_id").agg(F.min("us").alias("added_at")).withColumn("name", F.concat(F.lit("v"), F.col("trial_id").cast("string")))
    ends = videos.agg(F.min("trial_id").alias("a"), F.max("trial_id").alias("b")).first()
    missing = tables.fetch_missing(videos.select("name"), videos.where("trial_id % 3 = 0")).withColumn("is_new", F.lit(True))
    moved = tables.list_videos(tables.swap_order(videos.withColumn("blob", F.lit(b"x")), ends.a, ends.b))
    return moved.join(missing, "name", "left").select("trial_id", "added_at", F.coalesce("is_new", F.lit(False)).alias("is_new"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to trial rows: tracker, overlays, investigations, measures, strategy."""
    return _trial_rows(Trials(spark, sf_dir))
