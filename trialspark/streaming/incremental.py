"""Frames that arrive out of order, put in order with keyed state.

State is kept by trial, and the rows are those of the batch plan. Spark drops
late rows in silence; here a late, repeated or overflowing frame is an error row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = 32
ORDERED = "trial_id long, frame_index long, payload string, error string"


def release(held: dict[int, str], upto: int, arrived: list[tuple[int, str]], window: int = WINDOW) -> tuple[list[tuple[int, str | None, str | None]], int]:
    """Frames in order that can go now, as (index, payload, error), and the next
    index that is waited for. ``held`` is changed.

    The awaited frame always goes, and what it held up with it; only then may no
    more than ``window`` frames wait: one that comes beyond that is an error row.
    """
    out: list[tuple[int, str | None, str | None]] = []
    for index, payload in arrived:
        if index < upto or index in held:
            out.append((index, None, "already passed" if index < upto else "duplicate"))
            continue
        held[index] = payload
        while upto in held:
            out.append((upto, held.pop(upto), None))
            upto += 1
        if len(held) > window:
            del held[index]
            out.append((index, None, "overflow"))
    return out, upto


def flush(held: dict[int, str]) -> list[tuple[int, str | None, str | None]]:
    """All frames that still wait, in order: for a trial that has ended."""
    out = [(i, held[i], None) for i in sorted(held)]
    held.clear()
    return out


def reorder(stream: DataFrame, window: int = WINDOW) -> DataFrame:
    """``stream``: trial_id, frame_index, payload. Emits each trial's frames in
    ascending order, at most ``window`` held back. A row without a frame_index ends
    its trial: what is held goes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, indices, payloads = state.get if state.exists else (0, [], [])
        held = dict(zip(indices, payloads, strict=True))
        for pdf in batches:
            ends = pdf.frame_index.isna()
            rows = pdf[~ends]
            out, upto = release(held, upto, list(zip(rows.frame_index.astype(int).tolist(), rows.payload.tolist(), strict=True)), window)
            if ends.any():
                upto = max([upto, *(i + 1 for i in held)])
                out += flush(held)
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["trial_id", "frame_index", "payload", "error"])
        state.update((upto, list(held), list(held.values())))

    return stream.groupBy("trial_id").applyInPandasWithState(step, ORDERED, "upto long, indices array<long>, payloads array<string>", "append", GroupStateTimeout.NoTimeout)
