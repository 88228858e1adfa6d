"""The same trials in DuckDB's SQL: common tables that query texts build on."""

from __future__ import annotations

from .fixture import CENTERS, CX, CY, DIAMETER, HOLE_RADIUS, HOLES, PLATFORM

REACH = HOLE_RADIUS * 1.5
PER_CM = 2 * PLATFORM / DIAMETER
_HOLES = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(CENTERS))

COMMON = f"""
hole(i, hx, hy) AS (VALUES {_HOLES}),
ev AS (SELECT event_id, user_id AS trial_id, epoch_us(ts) AS us, event_type FROM events),
det0 AS (
  SELECT trial_id, event_id, row_number() OVER w - 1 AS frame_index, us, (us - min(us) OVER (PARTITION BY trial_id)) / 1e6::DOUBLE AS t, event_type <> 'error' AS found,
    ({CX} + sum(event_id * 7919 % 25 - 12) OVER w)::DOUBLE AS cx, ({CY} + sum(event_id * 104729 % 25 - 12) OVER w)::DOUBLE AS cy, (100 + event_id * 31 % 200)::DOUBLE AS area
  FROM ev WINDOW w AS (PARTITION BY trial_id ORDER BY us, event_id)
),
det AS (SELECT *, cx + (event_id % 7 + 3) AS ax, cy + (event_id % 5 - 2) AS ay, cx - (event_id % 7 + 3) AS bx, cy - (event_id % 5 - 2) AS by_ FROM det0),
nearest AS (
  SELECT trial_id, frame_index, i AS near_i, sqrt((cx - hx) * (cx - hx) + (cy - hy) * (cy - hy)) AS near_d FROM det, hole WHERE found
  QUALIFY row_number() OVER (PARTITION BY trial_id, frame_index ORDER BY near_d, i) = 1
),
roi AS (
  SELECT d.trial_id, n.near_i AS target_hole FROM det d JOIN nearest n USING (trial_id, frame_index) WHERE found
  QUALIFY row_number() OVER (PARTITION BY d.trial_id ORDER BY frame_index DESC) = 1
),
simple AS (
  SELECT trial_id, frame_index, t, CASE WHEN found THEN 'TRACKED' ELSE 'LOST' END AS state, CASE WHEN found THEN cx END AS cx, CASE WHEN found THEN cy END AS cy,
    CASE WHEN found THEN cx END AS nx, CASE WHEN found THEN cy END AS ny FROM det
),
streaks AS (
  SELECT *, sum(flip) OVER (PARTITION BY trial_id ORDER BY frame_index)::BIGINT AS streak
  FROM (SELECT *, CASE WHEN found IS DISTINCT FROM lag(found) OVER (PARTITION BY trial_id ORDER BY frame_index) THEN 1 ELSE 0 END AS flip FROM det)
),
shrinking AS (
  SELECT *, count(*) OVER r >= 2 AND first_value(area) OVER r > 0 AND (first_value(area) OVER r - area) / first_value(area) OVER r >= 0.25 AS shrunk
  FROM streaks WINDOW r AS (PARTITION BY trial_id, streak ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
),
judged AS (
  SELECT s.*, CASE WHEN NOT found AND row_number() OVER (PARTITION BY s.trial_id, streak ORDER BY s.frame_index) = 1
      AND lag(shrunk) OVER o AND lag(near_d) OVER o <= {REACH} THEN lag(near_i) OVER o END AS entered
  FROM shrinking s LEFT JOIN nearest n USING (trial_id, frame_index) WINDOW o AS (PARTITION BY s.trial_id ORDER BY s.frame_index)
),
vanished AS (
  SELECT *, CASE WHEN NOT found THEN first_value(entered) OVER (PARTITION BY trial_id, streak ORDER BY frame_index) END AS hole_index FROM judged
),
nose1 AS (
  SELECT *, first_value(cx) OVER b AS base_x, first_value(cy) OVER b AS base_y, count(*) OVER b AS span,
    lag(ax) OVER s AS pax, lag(ay) OVER s AS pay, lag(bx) OVER s AS pbx, lag(by_) OVER s AS pby
  FROM vanished WINDOW s AS (PARTITION BY trial_id, streak ORDER BY frame_index), b AS (PARTITION BY trial_id, streak ORDER BY frame_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
),
nose2 AS (
  SELECT *, coalesce(span > 0 AND sqrt((cx - base_x) * (cx - base_x) + (cy - base_y) * (cy - base_y)) / nullif(span, 0) >= 1.5, false) AS fast,
    CASE WHEN (ax - cx) * (cx - base_x) + (ay - cy) * (cy - base_y) >= (bx - cx) * (cx - base_x) + (by_ - cy) * (cy - base_y) THEN 0 ELSE 1 END AS ahead,
    CASE WHEN sqrt((ax - pax) * (ax - pax) + (ay - pay) * (ay - pay)) <= sqrt((bx - pax) * (bx - pax) + (by_ - pay) * (by_ - pay)) THEN 0 ELSE 1 END AS from_a,
    CASE WHEN sqrt((ax - pbx) * (ax - pbx) + (ay - pby) * (ay - pby)) <= sqrt((bx - pbx) * (bx - pbx) + (by_ - pby) * (by_ - pby)) THEN 0 ELSE 1 END AS from_b
  FROM nose1
),
nose3 AS (SELECT *, CASE WHEN fast THEN ahead WHEN pax IS NULL THEN 0 WHEN from_a = from_b THEN from_a END AS fixed FROM nose2),
nose4 AS (SELECT *, count(fixed) OVER (PARTITION BY trial_id, streak ORDER BY frame_index) AS since, CASE WHEN fixed IS NULL AND from_a = 1 THEN 1 ELSE 0 END AS turn FROM nose3),
nose5 AS (SELECT *, (first_value(fixed) OVER p + sum(turn) OVER p) % 2 AS side FROM nose4 WINDOW p AS (PARTITION BY trial_id, streak, since ORDER BY frame_index)),
raw AS (
  SELECT trial_id, frame_index, CASE WHEN found THEN 'TRACKED' WHEN hole_index IS NOT NULL THEN 'OCCLUDED_IN_HOLE' ELSE 'LOST' END AS state, CASE WHEN found THEN cx END AS cx, CASE WHEN found THEN cy END AS cy,
    CASE WHEN found THEN CASE WHEN side = 0 THEN ax ELSE bx END END AS nx, CASE WHEN found THEN CASE WHEN side = 0 THEN ay ELSE by_ END END AS ny, CASE WHEN found THEN area ELSE 0 END AS area, hole_index
  FROM nose5
),
close1 AS (
  SELECT r.*, target_hole, CASE WHEN state = 'TRACKED' AND near_d <= {REACH} THEN near_i END AS at_hole
  FROM raw r JOIN roi USING (trial_id) LEFT JOIN nearest n USING (trial_id, frame_index)
),
close2 AS (SELECT *, first_value(at_hole) OVER (PARTITION BY trial_id ORDER BY frame_index DESC) AS last_at FROM close1),
close3 AS (
  SELECT *, bool_and(coalesce(state = 'OCCLUDED_IN_HOLE' AND hole_index = target_hole, false)) OVER c AS waits, bool_and(coalesce(state = 'TRACKED' AND at_hole = last_at, false)) OVER c AS comes
  FROM close2 WINDOW c AS (PARTITION BY trial_id ORDER BY frame_index DESC)
),
close4 AS (
  SELECT *, first_value(area) OVER (PARTITION BY trial_id ORDER BY frame_index DESC) AS end_area,
    arg_min(area, frame_index) FILTER (comes) OVER (PARTITION BY trial_id) AS start_area FROM close3
),
close5 AS (SELECT *, comes AND coalesce(start_area > 0 AND (start_area - end_area) / start_area >= 0.25, false) AS enters FROM close4),
tracks AS (
  SELECT trial_id, frame_index, CASE WHEN waits THEN 'IN_ESCAPE_BOX' WHEN enters THEN CASE WHEN last_at = target_hole THEN 'IN_ESCAPE_BOX' ELSE 'OCCLUDED_IN_HOLE' END ELSE state END AS state,
    CASE WHEN NOT enters THEN cx END AS cx, CASE WHEN NOT enters THEN cy END AS cy, CASE WHEN NOT enters THEN nx END AS nx, CASE WHEN NOT enters THEN ny END AS ny,
    CASE WHEN enters THEN 0 ELSE area END AS area, CASE WHEN enters THEN last_at ELSE hole_index END AS hole_index
  FROM close5
),
fixes AS (
  SELECT trial_id, frame_index, cx + 5 AS fx, cy - 5 AS fy, CASE WHEN event_id % 2 = 1 THEN cx + 9 ELSE cx + 5 END AS fnx, CASE WHEN event_id % 2 = 1 THEN cy - 9 ELSE cy - 5 END AS fny FROM det WHERE event_id % 97 = 0
),
frames AS (
  SELECT k.trial_id, k.frame_index, state, CASE WHEN fx IS NULL THEN k.cx ELSE fx END AS cx, CASE WHEN fx IS NULL THEN k.cy ELSE fy END AS cy, CASE WHEN fx IS NULL THEN nx ELSE fnx END AS nx, CASE WHEN fx IS NULL THEN ny ELSE fny END AS ny,
    k.area, hole_index, fx IS NOT NULL AS is_corrected, d.t, coalesce(lead(d.t) OVER (PARTITION BY k.trial_id ORDER BY k.frame_index) - d.t, 0) AS duration
  FROM tracks k JOIN det d USING (trial_id, frame_index) LEFT JOIN fixes USING (trial_id, frame_index)
),
held AS (SELECT trial_id, frame_index, CASE WHEN state = 'OCCLUDED_IN_HOLE' THEN hole_index END AS h FROM frames),
held_runs AS (
  SELECT trial_id, min(h) AS hole_index, min(frame_index) AS start_frame, max(frame_index) AS end_frame FROM (
    SELECT *, sum(new) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM (SELECT *, CASE WHEN h IS DISTINCT FROM lag(h) OVER (PARTITION BY trial_id ORDER BY frame_index) THEN 1 ELSE 0 END AS new FROM held)
  ) WHERE h IS NOT NULL GROUP BY trial_id, run
),
close_to AS (
  SELECT trial_id, frame_index, i AS h FROM frames, hole WHERE state = 'TRACKED' AND nx IS NOT NULL AND sqrt((nx - hx) * (nx - hx) + (ny - hy) * (ny - hy)) <= {REACH}
  QUALIFY row_number() OVER (PARTITION BY trial_id, frame_index ORDER BY sqrt((nx - hx) * (nx - hx) + (ny - hy) * (ny - hy)), i DESC) = 1
),
close_all AS (SELECT trial_id, frame_index, h FROM frames LEFT JOIN close_to USING (trial_id, frame_index)),
close_runs AS (
  SELECT trial_id, min(h) AS hole_index, min(frame_index) AS start_frame, max(frame_index) AS end_frame FROM (
    SELECT *, sum(new) OVER (PARTITION BY trial_id ORDER BY frame_index) AS run FROM (SELECT *, CASE WHEN h IS DISTINCT FROM lag(h) OVER (PARTITION BY trial_id ORDER BY frame_index) THEN 1 ELSE 0 END AS new FROM close_all)
  ) WHERE h IS NOT NULL GROUP BY trial_id, run HAVING max(frame_index) - min(frame_index) + 1 >= 3
),
auto AS (
  SELECT a.trial_id, hole_index, coalesce(hole_index = target_hole, false) AS is_target, start_frame, end_frame, kind, row_number() OVER (PARTITION BY a.trial_id ORDER BY start_frame, rank) AS ordinal
  FROM (SELECT *, 'occlusion' AS kind, 0 AS rank FROM held_runs UNION ALL SELECT *, 'proximity', 1 FROM close_runs) a JOIN roi USING (trial_id)
),
edited AS (
  SELECT trial_id, 'auto-' || start_frame AS id, hole_index, is_target, start_frame, end_frame, kind, 'auto' AS source, ordinal FROM auto WHERE start_frame % 5 <> 0
  UNION ALL
  SELECT trial_id, 'manual-1', trial_id % {HOLES}, coalesce(trial_id % {HOLES} = target_hole, false), 4, 9, 'manual', 'manual', (1::BIGINT << 40) + 1 FROM roi WHERE trial_id % 3 = 0
),
visited AS (
  SELECT *, sum(moved) OVER (PARTITION BY trial_id ORDER BY start_frame, ordinal)::BIGINT AS visit
  FROM (SELECT *, CASE WHEN hole_index IS DISTINCT FROM lag(hole_index) OVER (PARTITION BY trial_id ORDER BY start_frame, ordinal) THEN 1 ELSE 0 END AS moved FROM edited)
),
firsts AS (SELECT trial_id, min(start_frame) FILTER (is_target) AS target_frame FROM edited GROUP BY trial_id),
errors AS (
  SELECT e.trial_id, count(DISTINCT CASE WHEN NOT is_target AND (target_frame IS NULL OR start_frame < target_frame) THEN hole_index END) AS primary_errors, count(DISTINCT CASE WHEN NOT is_target THEN hole_index END) AS total_errors
  FROM edited e JOIN firsts USING (trial_id) GROUP BY e.trial_id
),
steps AS (
  SELECT trial_id, frame_index, CASE WHEN state = 'TRACKED' AND lag(state) OVER o = 'TRACKED' AND frame_index = lag(frame_index) OVER o + 1
      THEN sqrt((cx - lag(cx) OVER o) * (cx - lag(cx) OVER o) + (cy - lag(cy) OVER o) * (cy - lag(cy) OVER o)) END AS px,
    CASE WHEN state = 'TRACKED' AND lag(state) OVER o = 'TRACKED' AND frame_index = lag(frame_index) OVER o + 1 THEN t - lag(t) OVER o END AS dt
  FROM frames WINDOW o AS (PARTITION BY trial_id ORDER BY frame_index)
),
paths AS (SELECT trial_id, coalesce(sum(px), 0) AS path_px, coalesce(sum(px), 0) / {PER_CM!r} AS path_length_cm, coalesce(sum(px), 0) / {PER_CM!r} / nullif(coalesce(sum(dt), 0), 0) AS avg_speed_cm_s FROM steps GROUP BY trial_id),
placed AS (
  SELECT f.trial_id, duration, coalesce(f.cx, CASE WHEN state = 'OCCLUDED_IN_HOLE' THEN h.hx WHEN state = 'IN_ESCAPE_BOX' THEN g.hx END) AS x, coalesce(f.cy, CASE WHEN state = 'OCCLUDED_IN_HOLE' THEN h.hy WHEN state = 'IN_ESCAPE_BOX' THEN g.hy END) AS y, g.hx AS gx, g.hy AS gy
  FROM frames f JOIN roi USING (trial_id) LEFT JOIN hole h ON h.i = f.hole_index LEFT JOIN hole g ON g.i = roi.target_hole
),
turned AS (
  SELECT *, ((norm % (2 * pi())) + 2 * pi()) % (2 * pi()) AS d FROM (
    SELECT *, ((atan2(y - {CY}, x - {CX}) % (2 * pi())) + 2 * pi()) % (2 * pi()) - ((atan2(gy - {CY}, gx - {CX}) % (2 * pi())) + 2 * pi()) % (2 * pi()) AS norm FROM placed
  )
),
quadrants AS (
  SELECT trial_id, coalesce(sum(duration) FILTER (d < pi() / 4 OR d >= 7 * (pi() / 4)), 0) AS q_target_s, coalesce(sum(duration) FILTER (d >= 3 * (pi() / 4) AND d < 5 * (pi() / 4)), 0) AS q_opposite_s,
    coalesce(sum(duration) FILTER (d >= pi() / 4 AND d < 3 * (pi() / 4)), 0) AS q_cw_s, coalesce(sum(duration) FILTER (d >= 5 * (pi() / 4) AND d < 7 * (pi() / 4)), 0) AS q_ccw_s
  FROM turned GROUP BY trial_id
),
measures AS (
  SELECT f.trial_id, p.t AS primary_latency_s, f.escaped AS total_latency_s, coalesce(primary_errors, 0) AS primary_errors, coalesce(total_errors, 0) AS total_errors, path_length_cm, avg_speed_cm_s, q_target_s, q_opposite_s, q_cw_s, q_ccw_s
  FROM (SELECT trial_id, min(t) FILTER (state = 'IN_ESCAPE_BOX') AS escaped FROM frames GROUP BY trial_id) f
  LEFT JOIN firsts USING (trial_id) LEFT JOIN det p ON p.trial_id = f.trial_id AND p.frame_index = target_frame
  LEFT JOIN errors e ON e.trial_id = f.trial_id LEFT JOIN paths ON paths.trial_id = f.trial_id LEFT JOIN quadrants q ON q.trial_id = f.trial_id
),
cut AS (
  SELECT f.trial_id, coalesce(target_frame, max(frame_index)) AS cutoff_frame, target_frame IS NOT NULL AS target_reached FROM frames f LEFT JOIN firsts USING (trial_id) GROUP BY f.trial_id, target_frame
),
seen AS (SELECT f.* FROM frames f JOIN cut USING (trial_id) WHERE frame_index <= cutoff_frame),
seen_events AS (SELECT e.* FROM edited e JOIN cut USING (trial_id) WHERE start_frame <= cutoff_frame),
crossings AS (
  SELECT trial_id, count(*) FILTER (inside AND NOT was) AS center_crossings FROM (
    SELECT *, coalesce(lag(inside) OVER (PARTITION BY trial_id ORDER BY frame_index), false) AS was FROM (
      SELECT trial_id, frame_index, sqrt((cx - {CX}) * (cx - {CX}) + (cy - {CY}) * (cy - {CY})) <= {PLATFORM} * 0.2 AS inside FROM seen WHERE state = 'TRACKED' AND cx IS NOT NULL
    )
  ) GROUP BY trial_id
),
sequence_ AS (
  SELECT s.trial_id, start_frame, ordinal, atan2(hy - {CY}, hx - {CX}) AS angle FROM (
    SELECT *, lag(hole_index) OVER (PARTITION BY trial_id ORDER BY start_frame, ordinal) AS prev FROM seen_events
  ) s JOIN hole ON hole.i = s.hole_index WHERE s.hole_index IS DISTINCT FROM prev
),
turns AS (
  SELECT trial_id, (((angle - lag(angle) OVER o) % (2 * pi())) + 2 * pi()) % (2 * pi()) AS turn FROM sequence_ WINDOW o AS (PARTITION BY trial_id ORDER BY start_frame, ordinal)
),
orders AS (
  SELECT trial_id, count(*) AS holes_in_order, CASE WHEN count(*) >= 3 THEN greatest(count(*) FILTER (turn > 0 AND turn <= pi()), count(*) FILTER (turn > pi())) / (count(*) - 1)::DOUBLE END AS order_score FROM turns GROUP BY trial_id
),
travel AS (
  SELECT trial_id, coalesce(sum(px), 0) AS travelled FROM steps JOIN cut USING (trial_id) WHERE frame_index <= cutoff_frame GROUP BY trial_id
),
strategies AS (
  SELECT c.trial_id, target_reached, cutoff_frame, CASE WHEN travelled > 0 THEN sqrt((fx - ex) * (fx - ex) + (fy - ey) * (fy - ey)) / travelled END AS directness, order_score, coalesce(errors, 0) AS errors, coalesce(center_crossings, 0) AS center_crossings
  FROM (
    SELECT cut.*, a.fx, a.fy, CASE WHEN target_reached THEN g.hx ELSE coalesce(l.lx, a.fx) END AS ex, CASE WHEN target_reached THEN g.hy ELSE coalesce(l.ly, a.fy) END AS ey
    FROM cut JOIN roi USING (trial_id) JOIN hole g ON g.i = roi.target_hole
    JOIN (SELECT trial_id, arg_min(cx, frame_index) AS fx, arg_min(cy, frame_index) AS fy FROM frames WHERE state = 'TRACKED' AND cx IS NOT NULL GROUP BY trial_id) a ON a.trial_id = cut.trial_id
    LEFT JOIN (SELECT trial_id, arg_max(cx, frame_index) AS lx, arg_max(cy, frame_index) AS ly FROM seen WHERE state = 'TRACKED' AND cx IS NOT NULL GROUP BY trial_id) l ON l.trial_id = cut.trial_id
  ) c LEFT JOIN travel USING (trial_id) LEFT JOIN orders USING (trial_id) LEFT JOIN crossings USING (trial_id)
  LEFT JOIN (SELECT trial_id, count(DISTINCT CASE WHEN NOT is_target THEN hole_index END) AS errors FROM seen_events GROUP BY trial_id) w USING (trial_id)
),
labelled AS (
  SELECT *, CASE WHEN coalesce(directness >= 0.7 AND errors <= 1, false) THEN 'spatial' WHEN coalesce(order_score >= 0.7, false) THEN 'serial' ELSE 'random' END AS label FROM strategies
)
"""


def sql(body: str) -> str:
    return f"WITH {COMMON.strip()}\n{body.strip()}"
