"""The tracker as a stateful stream: each trial on its own ring, closed when it ends.

State of a trial, all typed: one value with its ring (given as initial state), the tail
that the next frame's judgement needs and the place of the run it is in now, and a list
of that run's rows, as far as the closing rules may still change them. Other rows go out
as they come. A trial ends with a row that has no frame_index, or when nothing has come
for ``idle_ms``; then the closing rules decide on the held run, which goes out too. The
rows are those of ``operators.tracking.track``.

Each call of the state costs more than a frame, so a trial's value is read once and
written once in a batch, and what begins and ends in one batch is never stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..params import TrackerParams
from .sequential import close, extend, nearest

TRACK = "trial_id long, frame_index long, state string, cx double, cy double, nx double, ny double, area double, hole_index long, error string"
_ROW = "frame_index long, state string, cx double, cy double, nx double, ny double, area double, hole_index long"
_TRIAL = (
    "xs array<double>, ys array<double>, hole_radius double, target_hole long, upto long, tail_xs array<double>, tail_ys array<double>, tail_areas array<double>, "
    "nose array<double>, gone string, gone_hole long, place string, place_hole long"
)
_FRESH = (-1, [], [], [], None, None, None, None, None)
_OUT = Row(*[c.split()[0] for c in TRACK.split(", ")])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long an ended trial is remembered, so that frames after its end are told as such:
#: with timers; without them there is no clock, and it is remembered for good.
REMEMBERED_MS = 24 * 3600 * 1000
Ring = tuple[list[tuple[float, float]], float, int | None]


class TrackTrials(StatefulProcessor):
    def __init__(self, params: TrackerParams, idle_ms: int):
        self.params, self.idle_ms = params, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trial = handle.getValueState("trial", _TRIAL)
        self.held = handle.getListState("held", _ROW)
        self.ended = handle.getValueState("ended", "ended boolean", ttlDurationMs=REMEMBERED_MS if self.idle_ms else None)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        r = initialState
        self.trial.update(([float(h["x"]) for h in r.holes], [float(h["y"]) for h in r.holes], float(r.hole_radius), r.target_hole, *_FRESH))

    def _place(self, row: tuple, ring: Ring) -> tuple[str, int] | None:
        """What the closing rules go by, if they may change the row."""
        holes, radius, target = ring
        if row[1] == "TRACKED":
            gap, i = nearest(row[2], row[3], holes)
            return ("near", i) if gap <= radius * self.params.near_factor else None
        return (row[1], row[7]) if row[1] == "OCCLUDED_IN_HOLE" and row[7] == target else None

    def _let_go(self) -> list[tuple]:
        rows = [tuple(r) for r in self.held.get()]
        self.held.clear()
        return rows

    def _forward(self, rows: list[tuple], ring: Ring, now: tuple[str, int] | None) -> tuple[list[tuple], list[tuple], tuple[str, int] | None, bool]:
        """Rows that can go; those of the last run, which can't, its place, and whether
        the state holds earlier rows of it. ``now``: the place of the run before."""
        out: list[tuple] = []
        fresh: list[tuple] = []
        stored = now is not None
        for row in rows:
            place = self._place(row, ring)
            if place != now:
                out += (self._let_go() if stored else []) + fresh
                fresh, now, stored = [], place, False
            (out if place is None else fresh).append(row)
        return out, fresh, now, stored

    def _stop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _end(self, ring: Ring, fresh: list[tuple], stored: bool) -> list[tuple]:
        rows = (self._let_go() if stored else []) + fresh
        self.trial.clear()
        if self.idle_ms:
            self._stop_timers()
        self.ended.update((True,))
        return close(rows, *ring, self.params) if rows else []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = list(rows)
        frames = sorted((r.asDict() for r in came if r.frame_index is not None), key=lambda f: f["frame_index"])
        known = self.trial.get()
        if known is None:
            yield from self._errors(key, frames, "the trial has ended" if self.ended.exists() else "the trial has no ring")
            return
        hole_xs, hole_ys, radius, target, upto, xs, ys, areas, nose, gone, hole, place, place_hole = known
        ring = list(zip(hole_xs, hole_ys, strict=True)), radius, target
        memory = {} if upto < 0 else {"tail": list(zip(xs, ys, areas, strict=True)), "nose": tuple(nose) if nose else None, "gone": [gone, hole] if gone else None}
        good, bad = [], []
        for f in frames:
            if f["frame_index"] <= upto:
                bad.append(f)
            else:
                upto = f["frame_index"]
                good.append((upto, f))
        out, fresh, now, stored = self._forward(extend(memory, good, *ring[:2], self.params), ring, (place, place_hole) if place else None)
        if len(frames) < len(came):
            out += self._end(ring, fresh, stored)
        else:
            tail = [[float(v) for v in c] for c in zip(*memory["tail"], strict=True)] if memory.get("tail") else [[], [], []]
            nose, gone = memory.get("nose"), memory.get("gone") or (None, None)
            self.trial.update((hole_xs, hole_ys, radius, target, upto, *tail, [float(v) for v in nose] if nose else None, *gone, *(now or (None, None))))
            if fresh:
                self.held.appendList(fresh)
            if self.idle_ms:
                self._stop_timers()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        for row in out:
            yield _OUT(key[0], *row, None)
        yield from self._errors(key, bad, "already passed")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        known = self.trial.get()
        if known is not None:
            ring = list(zip(known[0], known[1], strict=True)), known[2], known[3]
            for row in self._end(ring, [], known[11] is not None):
                yield _OUT(key[0], *row, None)

    def _errors(self, key: Any, frames: list[dict], why: str) -> Iterator[Row]:
        for f in frames:
            yield _OUT(key[0], f["frame_index"], *[None] * 7, why)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """States of many kinds for one key need the RocksDB store, set before a start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def track_trials(stream: DataFrame, rois: DataFrame, params: TrackerParams = TrackerParams(), idle_ms: int = 0) -> DataFrame:
    """Tracks of ``stream`` (detections in order of frames; trial_id, frame_index, found,
    cx, cy, area, ax, ay, bx, by), as TRACK. ``rois``: a batch table of trial_id, holes,
    hole_radius, target_hole. Frames that can't be tracked are rows with an error."""
    use_rocksdb(stream.sparkSession)
    cols = ["trial_id", "frame_index", "found", "cx", "cy", "area", "ax", "ay", "bx", "by"]
    rings = rois.select("trial_id", "holes", "hole_radius", F.col("target_hole").cast("long").alias("target_hole"))
    return stream.select(*cols).groupBy("trial_id").transformWithState(
        TrackTrials(params, idle_ms), StructType.fromDDL(TRACK), "Append", "ProcessingTime" if idle_ms else "None", rings.groupBy("trial_id")
    )
