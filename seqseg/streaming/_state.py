"""Shared stateful step: hold rows back until the watermark, then process in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqseg.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting rows of a key are kept by stretches of event time of this length.
SLOT_MS = 1000


class _InOrder(StatefulProcessor):
    """Waiting rows by slot (a map), and what ``advance`` carries on (a value).

    New rows rewrite only the slots they fall into. A timer at the end of each slot hands
    its rows to ``advance`` once the watermark is there; timers of a key come in order.
    """

    def __init__(self, names, types, advance, idle_ms: int, end: str | None) -> None:
        self.key, self.ts, self.order, self.value, self.out = names
        self.value_type = types
        self.advance, self.idle_ms, self.end = advance, idle_ms, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = f"stamps array<bigint>, positions array<bigint>, vals array<{self.value_type}>"
        self.slots = handle.getMapState("slots", "slot bigint", rows)
        self.memory = handle.getValueState("memory", f"items array<{self.value_type}>, latest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        added: dict[int, list] = {}
        ended = False
        for batch in rows:
            if self.end is not None:
                marks = batch[self.end].fillna(False).astype(bool)
                ended = ended or bool(marks.any())
                batch = batch[~marks]
            stamps = batch[self.ts].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            for row in zip(stamps, batch[self.order].tolist(), batch[self.value].tolist()):
                added.setdefault(row[0] // (1000 * SLOT_MS), []).append(row)
        for slot, new in added.items():
            old = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else ([], [], [])
            columns = [[*before, *now] for before, now in zip(old, zip(*new))]
            self.slots.updateValue((slot,), tuple(columns))
            self.handle.registerTimer((slot + 1) * SLOT_MS)
        if ended:
            for slot in sorted(k[0] for k in self.slots.keys()):
                self.handle.deleteTimer((slot + 1) * SLOT_MS)
                yield from self._emit(key, slot)
            self.memory.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = expiredTimerInfo.getExpiryTimeInMs()
        slot = now // SLOT_MS - 1
        if self.slots.containsKey((slot,)):
            yield from self._emit(key, slot)
            self.handle.registerTimer(now + self.idle_ms)
        elif self.memory.exists():
            latest = self.memory.get()[1]
            if (latest + 1) * SLOT_MS + self.idle_ms <= now and not any(True for _ in self.slots.keys()):
                self.memory.clear()

    def _emit(self, key, slot: int) -> Iterator:
        import pandas as pd

        ready = sorted(zip(*self.slots.getValue((slot,))), key=lambda r: (r[0], r[1]))
        self.slots.removeKey((slot,))
        items = list(self.memory.get()[0]) if self.memory.exists() else []
        items, emitted = self.advance(items, ready)
        self.memory.update((items, slot))
        if emitted:
            yield pd.DataFrame(
                {
                    self.key: [key[0]] * len(emitted),
                    self.ts: pd.to_datetime([e[0] for e in emitted], unit="us"),
                    self.order: [e[1] for e in emitted],
                    self.out: [e[2] for e in emitted],
                }
            )

    def close(self) -> None:
        pass


def ordered_state_stream(
    frames: DataFrame,
    key: str,
    ts: str,
    order: str,
    value: str,
    value_type: str,
    advance: Callable[[list, list], tuple[list, list]],
    delay: str,
    idle_timeout_ms: int,
    out_name: str,
    out_type: str,
    end: str | None = None,
) -> DataFrame:
    """Run ``advance(items, rows)`` over rows of each key in ``(ts, order)`` order.

    State is the short list of values that ``advance`` carries on and the rows still
    waiting for the watermark, which bounds how long rows wait. A row whose ``end`` column
    is true says that its key is complete: all that waits is emitted with it and the
    state is given up, so that a bounded run ends with nothing left behind.
    """
    spark = frames.sparkSession
    ship(spark)
    # Maps, lists and timers need the state store that keeps rows outside the heap.
    if spark.conf.get(PROVIDER) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    out_schema = (
        f"{key} {frames.schema[key].dataType.simpleString()}, {ts} timestamp, {order} bigint, {out_name} {out_type}"
    )
    columns = [key, ts, order, value, *([end] if end else [])]
    processor = _InOrder((key, ts, order, value, out_name), value_type, advance, idle_timeout_ms, end)
    emitted = (
        frames.select(*columns)
        .withWatermark(ts, delay)
        .groupBy(key)
        .transformWithStateInPandas(processor, out_schema, "Append", "EventTime")
    )
    # The stateful step hands on Arrow-backed rows, which an exchange right behind it
    # cannot write; computing one column copies them to plain rows.
    return emitted.withColumn(order, F.coalesce(order, F.lit(-1).cast("long")))
