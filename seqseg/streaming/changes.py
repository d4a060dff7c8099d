"""Emit a label only when it differs from the last emitted one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F

from seqseg.operators.ordered import BUCKET_ROWS, FRAME, KEYS, neighbours

NO_ACTION = "(no primitive)"


def label_changes_batch(
    frames: DataFrame,
    keys: Sequence[str] = KEYS,
    label: str = "label",
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Frames whose label differs from the frame before; the first frame counts."""
    found = neighbours(
        frames, {"_before": lambda w: F.lag(label).over(w)}, before=1, keys=keys, order=order, rows=rows
    )
    changed = (F.col(order) == 0) | ~F.col("_before").eqNullSafe(F.col(label))
    return found.where(changed).drop("_before")


def attach_actions(changes: DataFrame, actions: DataFrame, label: str = "label") -> DataFrame:
    """Action of each label; stream-static join when ``changes`` is a stream."""
    return changes.join(actions.select(label, "action"), label, "left").withColumn(
        "action", F.coalesce("action", F.lit(NO_ACTION))
    )


def label_changes(
    frames: DataFrame,
    key: str = "stream_id",
    ts: str = "ts",
    order: str = FRAME,
    label: str = "label",
    delay: str = "10 seconds",
    idle_timeout_ms: int = 3_600_000,
    end: str | None = None,
) -> DataFrame:
    """Label changes of live streams.

    Rows wait in state until the watermark has passed them, so that late rows within
    ``delay`` are put in order by ``(ts, frame_index)``; older rows are dropped. A key
    without rows for ``idle_timeout_ms`` of event time gives up its state after its
    waiting rows were emitted. A row whose ``end`` column is true completes its key.
    """
    from seqseg.streaming._state import ordered_state_stream

    def advance(last: list, rows) -> tuple[list, list]:
        out = []
        for stamp, position, value in rows:
            if not last or value != last[0]:
                out.append((stamp, position, value))
                last = [value]
        return last, out

    return ordered_state_stream(
        frames, key, ts, order, label, "string", advance, delay, idle_timeout_ms, label, "string", end
    )
