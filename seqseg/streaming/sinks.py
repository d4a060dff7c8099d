"""Starting a stream: paced, or bounded by what the source holds now."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def trigger_options(update_hz: float = 1.0, bounded: bool = False) -> dict:
    """Trigger arguments: ``update_hz`` micro-batches per second, or one bounded run."""
    if bounded:
        return {"availableNow": True}
    period = 1000.0 / max(update_hz, 1e-3)
    return {"processingTime": f"{round(period)} milliseconds"}


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    update_hz: float = 1.0,
    bounded: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Append a stream to Parquet with a checkpoint; restarts continue where they stopped."""
    writer = df.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**trigger_options(update_hz, bounded)).start()


class LateRows(StreamingQueryListener):
    """Counts rows that came after the watermark and were left out, from the first batch on.

    A query keeps its last progress reports only; a listener sees them all. Add it with
    ``spark.streams.addListener`` before the query starts; ``of(query)`` is its count.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(int(operator.numRowsDroppedByWatermark) for operator in event.progress.stateOperators)
        self.counts[run] = self.counts.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return self.counts.get(str(query.runId), 0)


def stop_after(query: StreamingQuery, max_iters: int, poll_s: float = 0.2) -> None:
    """Let a stream run ``max_iters`` micro-batches (0: until it ends), then stop it."""
    while query.isActive:
        done = (query.lastProgress or {"batchId": -1})["batchId"] + 1
        if max_iters and done >= max_iters:
            query.stop()
            break
        time.sleep(poll_s)
