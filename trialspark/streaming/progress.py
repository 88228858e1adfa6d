"""How far a job of phases is: frames done of all frames, phase by phase.

Counts are observed where the rows pass, in the plans that do the work: a task that is
run again counts once, and nothing is read a second time to be counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..params import TrackerParams
from ..vision import detect

BACKGROUND, TRACKING = "background", "tracking"


@dataclass(frozen=True)
class Step:
    phase: str
    frames_processed: int
    total_frames: int


def observed(df: DataFrame, phase: str, name: str | Observation) -> DataFrame:
    """``df``, whose rows are counted as frames of ``phase`` when they are made."""
    return df.observe(name, F.lit(phase).alias("phase"), F.count(F.lit(1)).alias("frames"))


class Progress(StreamingQueryListener):
    """Steps of streaming queries whose frames were ``observed`` under a name; those of
    all triggers add up. ``steps`` has one entry a trigger and phase."""

    def __init__(self, total_frames: int, tell: Callable[[Step], None] | None = None):
        self.total, self.tell = total_frames, tell
        self.steps: list[Step] = []
        self.done: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for metrics in event.progress.observedMetrics.values():
            row = metrics.asDict()
            if "phase" not in row or "frames" not in row or not row["frames"]:
                continue
            self.done[row["phase"]] = self.done.get(row["phase"], 0) + row["frames"]
            step = Step(row["phase"], self.done[row["phase"]], self.total)
            self.steps.append(step)
            if self.tell:
                self.tell(step)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def track_in_phases(frames: DataFrame, rois: DataFrame, write: Callable[[DataFrame, str], DataFrame], params: TrackerParams = TrackerParams()) -> tuple[DataFrame, list[Step]]:
    """Frames to tracks in two written phases, and what each has done.

    ``write(df, name)`` writes a table and reads it again. The background phase reads
    all frames and keeps a sample; the tracking phase detects all frames.
    """
    from ..operators.tracking import track

    first, second, steps = Observation(), Observation(), []
    ground = write(detect.backgrounds(frames, seen=observed(frames, BACKGROUND, first)), "backgrounds")
    found = write(observed(detect.detect(frames, ground, rois), TRACKING, second), "detections")
    for phase, seen in ((BACKGROUND, first), (TRACKING, second)):
        steps.append(Step(phase, seen.get["frames"], second.get["frames"]))
    return track(found, rois, params), steps
