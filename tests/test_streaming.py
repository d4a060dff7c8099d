"""Streams replayed from files give the rows of their batch twins."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest

from conftest import rows_of
from seqseg.streaming.changes import attach_actions, label_changes, label_changes_batch
from seqseg.streaming.clips import rolling_clips, rolling_clips_batch
from seqseg.streaming.sinks import write_stream

SCHEMA = "stream_id bigint, ts timestamp, frame_index bigint, label string, value double, end boolean"
START = dt.datetime(2024, 1, 1)


def make_rows(seed=0, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(3):
        for i in range(n):
            label = ["a", "b", "c"][int(rng.integers(0, 3))]
            rows.append((key, START + dt.timedelta(seconds=i), i, label, float(rng.random()), False))
    return rows


def replay(spark, tmp_path, batches, build, name, ends=True):
    """Feed each batch as one file; the last has a row that completes every key, or rows that move the watermark follow."""
    folder = tmp_path / "in"
    folder.mkdir()
    keys = sorted({r[0] for rows in batches for r in rows})
    last = max(r[1] for rows in batches for r in rows)
    if ends:
        batches = [*batches[:-1], [*batches[-1], *[(k, last, -1, None, None, True) for k in keys]]]
    else:
        batches = [*batches, *[[(99, START + dt.timedelta(minutes=3 * d), 0, "z", 0.0, None)] for d in (1, 2, 3)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i:03d}")
    stream = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    )
    target = str(tmp_path / f"out_{name}")
    query = write_stream(build(stream), target, str(tmp_path / f"check_{name}"), bounded=True)
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(target).where("stream_id <> 99")


def shuffled_batches(rows, size, seed=1):
    """Arrival out of order within a few seconds."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(rows)), key=lambda i: rows[i][2] + rng.random() * 4)
    placed = [rows[i] for i in order]
    return [placed[i : i + size] for i in range(0, len(placed), size)]


@pytest.mark.parametrize("ends", [True, False])
def test_label_changes_match_batch(spark, tmp_path, ends):
    rows = make_rows()
    end = "end" if ends else None
    build = lambda s: label_changes(s, delay="20 seconds", end=end)
    got = replay(spark, tmp_path, shuffled_batches(rows, 45), build, "changes", ends)
    batch = label_changes_batch(spark.createDataFrame(rows, SCHEMA), ["stream_id"])
    assert rows_of(got, "stream_id", "frame_index", "label") == rows_of(batch, "stream_id", "frame_index", "label")


def test_late_rows_are_counted_from_the_first_batch(spark, tmp_path):
    from seqseg.streaming.sinks import LateRows

    rows = make_rows(2, 30)
    late = [(0, START + dt.timedelta(seconds=i), 1000 + i, "late", 0.0, False) for i in range(4)]
    far = [(5, START + dt.timedelta(minutes=9 + i), i, "a", 0.0, False) for i in range(3)]
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        build = lambda s: label_changes(s, delay="20 seconds", end="end")
        got = replay(spark, tmp_path, [rows, far[:1], far[1:2], late, far[2:]], build, "late")
        assert got.where("label = 'late'").count() == 0
        deadline = time.time() + 20
        while sum(listener.counts.values()) < 4 and time.time() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(listener.counts.values()) == 4


def test_a_key_rewrites_only_the_slots_of_new_rows():
    from seqseg.streaming import _state

    class Map(dict):
        writes = 0

        def updateValue(self, k, v):
            self.writes += len(v[0])
            self[k] = v

        containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, v: setattr(self, "held", v)
        clear = lambda self: setattr(self, "held", None)

    class Handle:
        def __init__(self):
            self.timers, self.map, self.value = set(), Map(), Value()

        getMapState = lambda self, *a: self.map
        getValueState = lambda self, *a: self.value
        registerTimer = lambda self, t: self.timers.add(t)
        deleteTimer = lambda self, t: self.timers.discard(t)

    handle = Handle()
    step = _state._InOrder(("k", "ts", "i", "v", "v"), "double", lambda items, rows: (items, rows), 1000, "end")
    step.init(handle)

    def batch(first, n, end=False):
        ts = pd.to_datetime(START) + pd.to_timedelta(np.arange(first, first + n) * 100, unit="ms")
        return pd.DataFrame({"ts": ts, "i": range(first, first + n), "v": 0.5, "end": end})

    assert list(step.handleInputRows((1,), iter([batch(0, 100_000)]), None)) == []
    before = handle.map.writes
    assert list(step.handleInputRows((1,), iter([batch(100_000, 5)]), None)) == []
    assert before == 100_000 and handle.map.writes - before == 5 and len(handle.timers) == 10_001
    out = pd.concat(step.handleInputRows((1,), iter([batch(0, 1, True)]), None))
    assert out["i"].tolist() == list(range(100_005))
    assert not handle.map and not handle.timers and handle.value.held is None


def test_rolling_clips_match_batch(spark, tmp_path):
    rows = make_rows(3, 40)
    got = replay(
        spark, tmp_path, shuffled_batches(rows, 60), lambda s: rolling_clips(s, "value", 16, delay="20 seconds", end="end"), "clips"
    )
    batch = rolling_clips_batch(spark.createDataFrame(rows, SCHEMA), "value", 16, ["stream_id"], rows=10)
    left = sorted((r["stream_id"], r["frame_index"], tuple(r["clip"])) for r in got.collect())
    right = sorted((r["stream_id"], r["frame_index"], tuple(r["clip"])) for r in batch.collect())
    assert left == right and len(left) == 3 * (40 - 15)


def test_actions_on_a_stream(spark, tmp_path):
    actions = spark.createDataFrame([("a", "reach out")], "label string, action string")
    rows = make_rows(5, 20)
    got = replay(
        spark, tmp_path, [rows], lambda s: attach_actions(label_changes(s, end="end"), actions), "actions"
    )
    assert {r["action"] for r in got.where("label = 'a'").collect()} == {"reach out"}
    assert {r["action"] for r in got.where("label <> 'a'").collect()} == {"(no primitive)"}


def test_trigger_choice():
    from seqseg.streaming.sinks import trigger_options

    assert trigger_options(update_hz=2.0) == {"processingTime": "500 milliseconds"}
    assert trigger_options(bounded=True) == {"availableNow": True}
