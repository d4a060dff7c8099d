"""Peaks and segments against brute force written from the definitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import KEYS, rows_of
from seqseg.operators import ordered as od, peaks as pk


def plateau_tops(x):
    found, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    return found


def keep_distant(x, tops, distance, later=True):
    left = sorted(tops, key=lambda p: (-x[p], -p if later else p))
    kept = []
    for p in left:
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def height_over_sides(x, p):
    sides = []
    for step in (-1, 1):
        i, low = p, x[p]
        while 0 <= i < len(x) and x[i] <= x[p]:
            low = min(low, x[i])
            i += step
        sides.append(low)
    return x[p] - max(sides)


def merge(segments, min_length):
    segments = list(segments)
    while len(segments) > 1:
        sizes = [e - s for s, e in segments]
        i = sizes.index(min(sizes))
        if sizes[i] >= min_length:
            break
        if i == 0:
            a = 0
        elif i == len(sizes) - 1 or sizes[i - 1] <= sizes[i + 1]:
            a = i - 1
        else:
            a = i
        segments[a : a + 2] = [(segments[a][0], segments[a + 1][1])]
    return segments


def curves(seed, digits=1):
    rng = np.random.default_rng(seed)
    out = {e: np.round(rng.random(n), digits).tolist() for e, n in enumerate((1, 3, 30, 90))}
    out[10] = np.round(np.abs(np.sin(np.arange(70) / 9)) * 0.8 + rng.random(70) * 0.2, 2).tolist()
    out[11] = [i / 40 + 0.05 * (i % 2) for i in range(40)]
    out[12] = [0.5] * 20
    return out


@pytest.mark.parametrize("rows", [4, 9, 1000])
def test_plateaus_and_prominence(frames, rows):
    data = curves(rows)
    curve = pk.value_runs(frames(data, "p", "double"), rows=rows)
    tops = {e: plateau_tops(x) for e, x in data.items()}
    assert rows_of(curve.where("is_peak"), "episode_index", "peak") == sorted(
        (e, p) for e, ps in tops.items() for p in ps
    )
    found = pk.prominences(curve, "p", rows=rows, fan_in=3)
    got = {(r["episode_index"], r["peak"]): r["prominence"] for r in found.collect()}
    expected = {(e, p): height_over_sides(data[e], p) for e, ps in tops.items() for p in ps}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in expected)


@pytest.mark.parametrize("rows", [4, 1000])
@pytest.mark.parametrize("distance", [2, 3, 7])
@pytest.mark.parametrize("prefer", ["later", "earlier"])
def test_suppression(frames, rows, distance, prefer):
    data = curves(distance)
    peaks = pk.plateau_peaks(frames(data, "p", "double"), rows=rows)
    found = pk.suppress_near(peaks, distance, prefer, rows=rows)
    expected = [
        (e, p) for e, x in data.items() for p in keep_distant(x, plateau_tops(x), distance, prefer == "later")
    ]
    assert rows_of(found, "episode_index", "peak") == sorted(expected)


def test_suppression_with_many_candidates(spark):
    """Chains of rising heights: every peak depends on the next one."""
    n = 60
    rows = [("d", 0, i, i / n, n) for i in range(n)] + [("d", 1, i, ((i * 7) % 13) / 13, n) for i in range(n)]
    peaks = spark.createDataFrame(rows, "dataset string, episode_index bigint, peak bigint, height double, length bigint")
    found = pk.suppress_near(peaks, 4, "later", rows=8)
    expected = [(e, p) for e in (0, 1) for p in keep_distant([r[3] for r in rows if r[1] == e], range(n), 4)]
    assert rows_of(found, "episode_index", "peak") == sorted(expected)


@pytest.mark.parametrize("rows", [3, 1000])
@pytest.mark.parametrize("min_length", [1, 3, 5, 12])
def test_minimum_length(spark, rows, min_length):
    rng = np.random.default_rng(min_length)
    lengths = {0: 25, 1: 60, 2: 7, 3: 200, 4: 0}
    bounds = {e: sorted(rng.integers(-2, t + 3, size=t // 4 + 1).tolist()) for e, t in lengths.items()}
    b = spark.createDataFrame(
        [("d", e, x, lengths[e]) for e, xs in bounds.items() for x in xs],
        "dataset string, episode_index bigint, peak bigint, length bigint",
    )
    ep = spark.createDataFrame([("d", e, t) for e, t in lengths.items()], "dataset string, episode_index bigint, length bigint")
    found = pk.segments_from_boundaries(b, ep, min_length, rows=rows)
    expected = []
    for e, t in lengths.items():
        inner = sorted({x for x in bounds[e] if 0 < x < t})
        edges = [0, *inner, t]
        tiles = merge(zip(edges, edges[1:]), min_length) if t > 0 else []
        expected += [(e, i, s, x) for i, (s, x) in enumerate(tiles)]
    assert rows_of(found, "episode_index", "segment_index", "start_frame", "end_frame") == sorted(expected)


def test_minimum_length_over_small_batches(spark):
    """Evenly short segments never meet a cut: one group that spans many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = {0: [3] * 100, 1: [1 + (i * 5) % 4 for i in range(90)], 2: [2]}
        rows, expected = [], []
        for e, parts in sizes.items():
            edges = np.cumsum([0, *parts]).tolist()
            tiles = list(zip(edges, edges[1:]))
            rows += [("d", e, i, s, t, edges[-1]) for i, (s, t) in enumerate(tiles)]
            expected += [(e, s, t) for s, t in merge(tiles, 9)]
        table = spark.createDataFrame(
            rows,
            "dataset string, episode_index bigint, segment_index bigint, start_frame bigint, end_frame bigint, length bigint",
        )
        found = pk.merge_short(table, 9, rows=16)
        assert rows_of(found, "episode_index", "start_frame", "end_frame") == sorted(expected)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


@pytest.mark.parametrize(
    "bounds, length, minimum, expected",
    [
        ([3, 10, 12, 20], 25, 5, [(0, 12), (12, 20), (20, 25)]),
        ([10, 12, 20], 25, 5, [(0, 10), (10, 20), (20, 25)]),
        ([0, 25, 30], 25, 5, [(0, 25)]),
        ([], 7, 5, [(0, 7)]),
        ([], 0, 5, []),
    ],
)
def test_segment_examples(spark, bounds, length, minimum, expected):
    b = spark.createDataFrame(
        [("d", 0, x, length) for x in bounds], "dataset string, episode_index bigint, peak bigint, length bigint"
    )
    ep = spark.createDataFrame([("d", 0, length)], "dataset string, episode_index bigint, length bigint")
    assert rows_of(pk.segments_from_boundaries(b, ep, minimum, rows=4), "start_frame", "end_frame") == expected


def test_local_detector(frames):
    values = [v for v in (0.1, 0.6, 0.9, 0.2, 0.1) for _ in range(8)]
    found = pk.local_peaks(frames({0: values}, "p", "double"), 1, 0.0, suppress=False, rows=6)
    assert rows_of(found, "peak") == [(0,), (8,), (16,), (23,), (31,), (39,)]
    top = pk.plateau_peaks(frames({0: values}, "p", "double"), rows=6)
    assert rows_of(top, "peak") == [(19,)]


@pytest.mark.parametrize("rows", [16, 1000])
def test_segments_from_probs(frames, rows):
    rng = np.random.default_rng(3)
    data = {e: rng.random(n).tolist() for e, n in enumerate((1, 4, 12, 30))}
    found = pk.segments_from_probs(frames(data, "p", "double"), F.col("length") * 8 + 3, rows=rows)
    expected = []
    for e, p in data.items():
        t = len(p) * 8 + 3
        up = [p[min(int(np.floor((j + 0.5) * (len(p) / t))), len(p) - 1)] for j in range(t)]
        kept = [q for q in keep_distant(up, plateau_tops(up), 3) if height_over_sides(up, q) >= 0.1 and up[q] >= 0.5]
        edges = [0, *[q for q in kept if 0 < q < t], t]
        expected += [(e, s, x) for s, x in merge(zip(edges, edges[1:]), 5)]
    assert rows_of(found, "episode_index", "start_frame", "end_frame") == sorted(expected)


def test_segments_tile_the_episode(frames):
    rng = np.random.default_rng(8)
    data = {e: rng.random(50).tolist() for e in range(3)}
    found = pk.segments_from_probs(frames(data, "p", "double"), F.col("length"), threshold=0.2)
    by_episode: dict = {}
    for e, s, t in rows_of(found, "episode_index", "start_frame", "end_frame"):
        by_episode.setdefault(e, []).append((s, t))
    for tiles in by_episode.values():
        assert tiles[0][0] == 0 and tiles[-1][1] == 50
        assert all(a[1] == b[0] for a, b in zip(tiles, tiles[1:]))


def test_prominence_runs_without_python(frames):
    curve = pk.value_runs(frames({0: [0.1, 0.5, 0.2, 0.9, 0.3] * 9}, "p", "double"), rows=8)
    plan = pk.prominences(curve, "p", fan_in=3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
