"""Rolling clips: the last ``window`` frames at every frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqseg.operators.ordered import BUCKET_ROWS, FRAME, KEYS, neighbours


def rolling_clips_batch(
    frames: DataFrame,
    value: str,
    window: int = 16,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Clips in frame order; nothing until ``window`` frames exist."""
    found = neighbours(
        frames,
        {"clip": lambda w: F.collect_list(value).over(w.rowsBetween(-(window - 1), 0))},
        before=window - 1,
        keys=keys,
        order=order,
        rows=rows,
    )
    return found.where(F.col(order) >= window - 1)


def rolling_clips(
    frames: DataFrame,
    value: str,
    window: int = 16,
    key: str = "stream_id",
    ts: str = "ts",
    order: str = FRAME,
    delay: str = "10 seconds",
    idle_timeout_ms: int = 3_600_000,
    end: str | None = None,
) -> DataFrame:
    """Clips of live streams; state holds at most ``window - 1`` emitted frames.

    A row whose ``end`` column is true completes its key.
    """
    from seqseg.streaming._state import ordered_state_stream

    def advance(recent: list, rows) -> tuple[list, list]:
        out = []
        for stamp, position, x in rows:
            recent = [*recent, x][-window:]
            if len(recent) == window:
                out.append((stamp, position, list(recent)))
        return recent[-(window - 1):] if window > 1 else [], out

    return ordered_state_stream(
        frames, key, ts, order, value, "double", advance, delay, idle_timeout_ms, "clip", "array<double>", end
    )
