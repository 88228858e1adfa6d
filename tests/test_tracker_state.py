"""Calls of the state, each of which costs more than a frame."""

from pyspark.sql import Row

from trialspark.params import TrackerParams
from trialspark.streaming.tracker import TrackTrials


class State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            if name in ("update", "appendList"):
                self.value = given[0]
            elif name == "clear":
                self.value = None
            return self.value is not None if name == "exists" else self.value

        return call


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_, **__):
        return State(self.calls)

    getListState = getValueState


def test_a_trial_within_a_batch_reads_and_clears_its_state_once():
    handle, tracker = Handle(), TrackTrials(TrackerParams(), 0)
    tracker.init(handle)
    ring = Row(trial_id=1, holes=[Row(x=200.0, y=100.0), Row(x=100.0, y=200.0)], hole_radius=10.0, target_hole=0)
    tracker.handleInitialState((1,), ring, None)
    handle.calls.clear()
    frame = Row("trial_id", "frame_index", "found", "cx", "cy", "area", "ax", "ay", "bx", "by")
    rows = [frame(1, i, True, 197.0, 100.0, float(a), 192.0, 100.0, 202.0, 100.0) for i, a in enumerate((200, 170, 140, 110, 80))]
    rows.append(frame(1, None, *[None] * 8))
    out = list(tracker.handleInputRows((1,), iter(rows), None))
    assert [r.frame_index for r in out] == [0, 1, 2, 3, 4] and {r.error for r in out} == {None}
    assert handle.calls == ["get", "clear", "update"]
