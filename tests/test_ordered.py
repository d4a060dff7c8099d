"""Bucketed operations give the same result for every bucket size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import KEYS, rows_of
from seqseg.operators import ordered as od, runs as rn


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_runs_match_plain_encoding(frames, rows):
    rng = np.random.default_rng(rows)
    episodes = {e: rng.integers(0, 3, size=n).tolist() for e, n in enumerate((1, 2, 17, 40))}
    episodes[9] = [5] * 30
    found = rn.runs(frames(episodes), rows=rows, edges=True)
    expected = []
    for e, values in episodes.items():
        starts = [i for i, v in enumerate(values) if i == 0 or v != values[i - 1]]
        for k, (s, t) in enumerate(zip(starts, [*starts[1:], len(values)])):
            before = values[s - 1] if s else None
            after = values[t] if t < len(values) else None
            expected.append((e, k, s, t, values[s], len(values), before, after))
    got = [
        tuple(r)
        for r in found.select(
            "episode_index", "segment_index", "start_frame", "end_frame", "label", "length",
            "previous_label", "next_label",
        ).collect()
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("rows", [2, 5, 1000])
def test_expand_is_inverse_of_runs(frames, rows):
    rng = np.random.default_rng(1)
    table = frames({e: rng.integers(0, 2, size=23 + e).tolist() for e in range(4)})
    back = rn.expand_segments(rn.runs(table, rows=rows), od.lengths(table), "label", rows=rows)
    assert rows_of(back, *KEYS, "frame_index", "label") == rows_of(table, *KEYS, "frame_index", "label")


def test_null_labels_form_their_own_run(frames):
    found = rn.runs(frames({0: [None, None, 1, None]}), rows=2)
    assert rows_of(found, "start_frame", "end_frame") == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("rows", [2, 5, 1000])
def test_carry(frames, rows):
    values = {0: [3, None, 5, 1, None, 2, 9, 4], 1: [None, 7]}
    found = od.carry(
        frames(values, "x"),
        {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))},
        rows=rows,
    )
    expected = []
    for e, xs in values.items():
        for i in range(len(xs)):
            seen = [x for x in xs[:i] if x is not None]
            expected.append((e, i, sum(seen), max(seen, default=None), seen[-1] if seen else None))
    got = [tuple(r) for r in found.select("episode_index", "frame_index", "s", "m", "l").collect()]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("rows", [3, 1000])
def test_with_length_and_neighbours(frames, rows):
    table = frames({0: list(range(10)), 1: [4]})
    sized = od.with_length(table, rows=rows)
    assert set(rows_of(sized, "episode_index", "length")) == {(0, 10), (1, 1)}
    around = od.neighbours(
        table, {"a": lambda w: F.lag("label", 4).over(w), "b": lambda w: F.lead("label", 2).over(w)}, 4, 2, rows=rows
    )
    got = {r["frame_index"]: (r["a"], r["b"]) for r in around.where("episode_index = 0").collect()}
    assert got == {i: (i - 4 if i >= 4 else None, i + 2 if i < 8 else None) for i in range(10)}


def test_rank_rows_spreads_a_hot_key(spark):
    rows = [(0 if i % 3 else i, i // 10, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, minute bigint, i bigint").repartition(5)
    ranked = od.rank_rows(df, ["k"], ["minute", "i"], [F.col("minute")], total="n")
    groups: dict = {}
    for k, _, i in rows:
        groups.setdefault(k, []).append(i)
    expected = sorted((k, i, p, len(v)) for k, v in groups.items() for p, i in enumerate(sorted(v)))
    assert rows_of(ranked, "k", "i", "frame_index", "n") == expected


def test_rank_rows_keeps_null_keys_and_null_order(spark):
    rows = [(None, 3), (None, None), (1, 5), (1, None), (1, 2)]
    df = spark.createDataFrame(rows, "k bigint, x bigint")
    ranked = od.rank_rows(df, ["k"], ["x"], [F.col("x")], total="n")
    got = {(r["k"], r["x"]): r["frame_index"] for r in ranked.collect()}
    assert got == {(1, None): 0, (1, 2): 1, (1, 5): 2, (None, None): 0, (None, 3): 1}
    assert {(r["k"], r["n"]) for r in ranked.collect()} == {(1, 3), (None, 2)}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_positions_follow_time_across_clock_changes(spark, kind):
    """Eight rows around the hour that occurs twice, in a zone with clock changes."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        base = 1762059600  # 2025-11-02 05:00 UTC; clocks go back at 06:00 UTC
        df = spark.createDataFrame([(1, i, base + 1800 * (i - 2)) for i in range(8)], "k int, i int, s bigint")
        ts = F.timestamp_seconds("s") if kind == "timestamp" else F.expr("timestamp_ntz '2025-11-02 00:00:00' + make_dt_interval(0, 0, 30 * i)")
        df = df.withColumn("ts", ts)
        ranked = od.rank_rows(df, ["k"], ["ts"], [od.time_hours(df, "ts")])
        assert rows_of(ranked, "i", "frame_index") == [(i, i) for i in range(8)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rank_all_is_one_order_over_all_partitions(spark):
    rng = np.random.default_rng(3)
    names = [f"pick up the {i:05d}" for i in range(2000)]
    df = spark.createDataFrame([(names[i],) for i in rng.permutation(2000)], "name string").repartition(9)
    assert rows_of(od.rank_all(df, ["name"], "n"), "name", "n") == [(x, i) for i, x in enumerate(names)]
    assert od.rank_all(df.where("false"), ["name"], "n").count() == 0


def test_partition_count_does_not_matter(spark, frames):
    rng = np.random.default_rng(5)
    table = frames({e: rng.integers(0, 3, size=50).tolist() for e in range(5)})
    results = []
    for n in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(rows_of(rn.runs(table, rows=8), "episode_index", "segment_index", "start_frame", "end_frame"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_map_sorted_groups_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(k, i) for k in range(6) for i in range(k + 1)], "k bigint, x bigint")
        out = od.map_sorted_groups(
            df, ["k"], ["x"], lambda g: {"n": g["x"][-1:] + 1, "s": g["x"].sum(keepdims=True)},
            "k bigint, n bigint, s bigint", ["x"],
        )
        assert rows_of(out, "k", "n", "s") == [(k, k + 1, k * (k + 1) // 2) for k in range(6)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def test_segment_helpers(spark, frames):
    table = frames({0: [1, 0, 1]})
    kept = rn.runs_without(table, [0])
    assert rows_of(kept, "start_frame", "end_frame", "label") == [(0, 1, 1), (2, 3, 1)]
    background = spark.createDataFrame([(0,)], "label bigint")
    assert rows_of(rn.runs_without(table, background), "start_frame") == [(0,), (2,)]

    vocab = spark.createDataFrame([(0, "background")], "action_text_id bigint, name string")
    named = rn.segment_texts(rn.runs(frames({0: [0, 0, 7]}, "action_text_id"), "action_text_id"), vocab)
    assert rows_of(named, "english_action_text") == [("background",), ("class_7",)]
    nested = rn.nested_segments(named).collect()[0]
    assert [tuple(s) for s in nested["action_config"]] == [(0, 2, "background", 0), (2, 3, "class_7", 7)]
    flat = rn.flatten_action_config(rn.nested_segments(named))
    assert rows_of(flat, "segment_index", "start_frame") == [(0, 0), (1, 2)]


def test_an_episode_of_any_size_is_one_record(spark):
    """10,001 segments and 10,001 names come back with the same numbers, from one record each."""
    from seqseg.sinks import metadata as mt

    n = 10_001
    segments = spark.range(n).select(
        F.lit("d").alias("dataset"), F.lit(0).cast("long").alias("episode_index"), F.col("id").alias("segment_index"),
        (F.col("id") * 2).alias("start_frame"), (F.col("id") * 2 + 2).alias("end_frame"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("english_action_text"), F.col("id").alias("action_text_id"),
    )
    nested = rn.nested_segments(segments)
    assert nested.count() == 1
    flat = rn.flatten_action_config(nested)
    assert flat.where("segment_index * 2 = start_frame").select("segment_index").distinct().count() == n
    assert mt.dictionary_json(segments.select("action_text_id", F.col("english_action_text").alias("name"))).count() == 1


def test_expand_open_vocabulary(spark):
    from seqseg.operators import vocab as vc

    segments = spark.createDataFrame(
        [("d", 0, 0, 1, 3, "Reach"), ("d", 0, 1, 3, 5, "reach "), ("d", 0, 2, 6, 9, "")],
        "dataset string, episode_index bigint, segment_index bigint, start_frame bigint, end_frame bigint, text string",
    )
    vocab = vc.first_seen(segments)
    assert rows_of(vocab, "action_text_id", "name") == [(0, "background"), (1, "Reach")]
    episodes = spark.createDataFrame([("d", 0, 8)], "dataset string, episode_index bigint, length bigint")
    dense = rn.expand_segments(vc.apply_first_seen(segments, vocab), episodes, rows=3)
    labels = [r["action_text_id"] for r in dense.orderBy("frame_index").collect()]
    assert labels == [0, 1, 1, 1, 1, 0, 0, 0]


def test_later_segment_wins(spark):
    segments = spark.createDataFrame(
        [("d", 0, 0, -2, 4, 1), ("d", 0, 1, 2, 3, 2), ("d", 0, 2, 5, 99, 3), ("d", 0, 3, 5, 5, 9)],
        "dataset string, episode_index bigint, segment_index bigint, start_frame bigint, end_frame bigint, action_text_id bigint",
    )
    episodes = spark.createDataFrame([("d", 0, 7), ("d", 1, 2), ("d", 2, 0)], "dataset string, episode_index bigint, length bigint")
    dense = rn.expand_segments(segments, episodes, rows=2)
    assert rows_of(dense, "episode_index", "frame_index", "action_text_id") == [
        (0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 1), (0, 4, 0), (0, 5, 3), (0, 6, 3), (1, 0, 0), (1, 1, 0),
    ]
