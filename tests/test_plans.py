"""Composed jobs, and the shape of physical plans."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from conftest import KEYS, rows_of
from seqseg.operators import metrics as mt, ordered as od, peaks as pk, runs as rn, transitions as tr
from seqseg.plans import adapters as ad
from seqseg.plans.boundary_data import boundary_rows
from seqseg.plans.evaluate import evaluate_scores
from seqseg.plans.labelling import label_segments, relabel_dataset
from seqseg.session import settle

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def tree(df) -> str:
    return physical(df).split("\n\n\n")[0]


def test_relabel_dataset(spark, frames):
    steps = {e: [0.1] * 10 for e in range(3)}
    for e, at in ((0, 4), (1, 7)):
        steps[e][at] = 0.9
    table = frames({e: list(range(80)) for e in range(3)}, "value")
    schema = "dataset string, episode_index bigint, tasks string, task_index bigint, task string"
    episodes = spark.createDataFrame([("d", e, '["tidy up"]', None, None) for e in range(3)], schema)
    tasks = spark.createDataFrame([], "dataset string, task_index bigint, task string")

    def labeler(batch):
        return ["Reach" if s == 0 else " assistant: reach " if s < 40 else "Lift" for s in batch["start_frame"]]

    out = relabel_dataset(frames(steps, "p", "double"), table, episodes, tasks, labeler, F.col("length") * 8)
    cuts = {0: 35, 1: 59}
    assert rows_of(out["segments"], "episode_index", "start_frame", "end_frame", "text") == [
        (0, 0, 35, "Reach"), (0, 35, 80, "reach"), (1, 0, 59, "Reach"), (1, 59, 80, "Lift"), (2, 0, 80, "Reach"),
    ]
    assert rows_of(out["vocab"], "action_text_id", "name") == [(0, "background"), (1, "Reach"), (2, "Lift")]
    dense = {(e, t): i for e, t, i in rows_of(out["frames"], "episode_index", "frame_index", "action_text_id")}
    assert len(dense) == 240 and dense[0, 79] == 1 and dense[1, cuts[1]] == 2 and dense[1, cuts[1] - 1] == 1
    nested = {r["episode_index"]: r["action_config"] for r in out["episodes"].collect()}
    assert [tuple(s) for s in nested[0]] == [(0, 80, "Reach", 1)]
    assert [s["action_text_id"] for s in nested[1]] == [1, 2]
    assert tuple(out["info"].first()) == (3, 240, "0:3")
    summary = {r["episode_index"]: r for r in out["summary"].collect()}
    assert summary[0]["n_segments"] == 2 and summary[0]["n_frames"] == 80
    assert list(summary[1]["subtask_texts"]) == ["Reach", "Lift"] and summary[2]["task_text"] == "tidy up"


def test_labels_from_a_table_are_aligned(spark, frames):
    texts = spark.createDataFrame(
        [("d", 0, 0, "a"), ("d", 0, 5, "extra")], "dataset string, episode_index bigint, segment_index bigint, text string"
    )
    segments = rn.runs(frames({0: [1, 2, 2, 3]}))
    aligned = rn.align_texts(segments, texts)
    assert rows_of(aligned, "segment_index", "text") == [(0, "a"), (1, ""), (2, "")]


def test_labeler_failures_become_unknown(spark, frames):
    def labeler(batch):
        if (batch["label"] == 2).any():
            raise RuntimeError("no")
        return [None if v == 3 else f"do {v}" for v in batch["label"]]

    segments = rn.runs(frames({0: [1, 2, 3, 4]}))
    found = label_segments(segments, labeler, ["dataset", "episode_index", "segment_index", "label"])
    assert rows_of(found, "segment_index", "text") == [(0, "do 1"), (1, "unknown"), (2, "unknown"), (3, "do 4")]


def test_evaluate_scores(spark):
    rows = []
    for e, labels in enumerate([[0, 0, 1, 1], [1, 1, 0, 0]]):
        for t, label in enumerate(labels):
            z = [1.0, 0.0] if label == 0 else [0.0, 1.0]
            rows.append(("d", e, t, z, label, 1))
        rows.append(("d", e, 4, [9.0, 0.0], 1, 0))
    table = spark.createDataFrame(
        rows, "dataset string, episode_index bigint, frame_index bigint, logits array<double>, label bigint, mask int"
    )
    report = evaluate_scores(table).first()
    assert (report["acc"], report["edit"], report["f1_50"], report["num_videos"]) == (100, 100, 100, 2)
    members = spark.createDataFrame([("d", 1)], "dataset string, episode_index bigint")
    assert evaluate_scores(table, members=members).first()["num_videos"] == 1


def test_boundary_rows(spark, frames):
    table = frames({0: [0] * 20 + [1] * 20, 1: [3] * 40, 2: [None] * 40}, "action_text_id")
    done = spark.createDataFrame([("d", 1)], "dataset string, episode_index bigint")
    found = boundary_rows(table, done)
    assert rows_of(found, "episode_index", "step", "boundary") == [(0, 0, 0), (0, 1, 0), (0, 2, 1)]
    assert abs(dict(rows_of(found, "step", "soft"))[1] - 0.882497) < 1e-6


def test_neighbour_windows_share_one_exchange(spark, frames):
    plan = tree(tr.frame_transitions(frames({0: [1, 2]})))
    assert plan.count("Exchange") == 1 and plan.count("Sort") == 1 and "Join" not in plan


def test_windows_never_partition_by_the_episode_alone(spark):
    """Frame-level windows have the bucket in their partition keys."""
    for build in (rn.runs, tr.frame_transitions):
        plan = physical(build(ad.ev_frames(spark, SF)))
        specs = re.findall(r"(?:row_number|lag|lead)\([^)]*\) windowspecdefinition\((.*?)specifiedwindowframe", plan)
        assert specs and all("_bucket" in s or "_c0" in s for s in specs)


def test_runs_read_the_frames_once(spark):
    """Segments and bucket rows come from one exchange of the frames."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = tree(rn.runs(ad.li_frames(spark, SF)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("ReusedExchange") >= 1
    # The rows, and the counts of their coarse groups.
    assert plan.count("Scan parquet") == 2


def test_column_pruning_and_pushdown(spark):
    plan = physical(rn.runs(ad.ev_frames(spark, SF)).where("label = 'view'"))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_no_forced_broadcast_of_growing_sides(spark):
    """No operator here has a hint: Spark broadcasts what it has measured to be small."""
    import pathlib

    import seqseg

    base = pathlib.Path(seqseg.__file__).parent
    hints = [p.name for p in base.rglob("*.py") if "llm" not in p.parts for line in p.read_text().splitlines() if "F.broadcast(" in line]
    assert hints == []


def test_hot_episode_is_spread(spark):
    """One episode with most of the rows: no task gets more than a few buckets."""
    n = 40_000
    table = spark.range(n).select(
        F.lit("d").alias("dataset"),
        F.when(F.col("id") < n - 100, 0).otherwise(F.col("id")).alias("episode_index"),
        F.when(F.col("id") < n - 100, F.col("id")).otherwise(0).alias("frame_index"),
        F.floor(F.col("id") / 3).alias("label"),
    )
    spread = od.halo(table, before=1, rows=1000).repartition(40, *KEYS, od.BUCKET)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 8_000
    found = rn.runs(table, rows=1000)
    assert found.where("episode_index = 0").count() == -(-(n - 100) // 3)
    assert found.where("length > 1").agg(F.max("segment_index")).first()[0] == -(-(n - 100) // 3) - 1


def test_report_is_the_same_for_any_bucket_size(spark):
    rng = np.random.default_rng(1)
    rows = [("d", e, t, int(rng.integers(0, 3)), int(rng.integers(0, 3))) for e in range(4) for t in range(30)]
    table = spark.createDataFrame(rows, "dataset string, episode_index bigint, frame_index bigint, gt bigint, pred bigint")
    small = mt.segmentation_report(table, rows=4).first()
    assert tuple(small) == pytest.approx(tuple(mt.segmentation_report(table).first()))


def settled_segments(spark):
    """Runs of both sides in files: Spark knows no more of them than their compressed size, here a few kilobytes."""
    schema = "dataset string, episode_index bigint, frame_index bigint, gt bigint, pred bigint"
    table = spark.createDataFrame([("d", e, t, t // 5, t // 7) for e in range(4) for t in range(30)], schema)
    return settle(mt.paired_runs(table))


def test_matching_never_broadcasts_segments(spark):
    shape = tree(mt.best_matches(settled_segments(spark)))
    assert "SortMergeJoin" in shape and "BroadcastExchange" not in shape


def test_edit_distance_never_broadcasts_segments(spark):
    shape = tree(mt.edit_scores(settled_segments(spark)))
    assert "SortMergeJoin" in shape and "BroadcastExchange" not in shape


def test_report_joins_segments_by_sorting(spark):
    schema = "dataset string, episode_index bigint, frame_index bigint, gt bigint, pred bigint"
    table = spark.createDataFrame([("d", e, t, t // 5, t // 7) for e in range(4) for t in range(30)], schema)
    shape = tree(mt.segmentation_report(table))
    assert shape.count("SortMergeJoin Inner") == 2


def test_ranking_never_broadcasts_its_groups(spark):
    """There is a group for nearly every row, and Spark knows only the compressed size of the files."""
    from seqseg.plans.catalog.scoring import ev_pred

    for frames in (ad.ev_frames, ad.li_frames, ev_pred):
        shape = tree(frames(spark, SF))
        assert "SortMergeJoin Inner" in shape and "BroadcastExchange" not in shape


def test_pyramid_levels_are_written_once(spark, frames, monkeypatch):
    """The last plan reads each level from its files: nothing in it builds a level again."""
    table = frames({0: [(i * 37) % 101 / 100 for i in range(600)]}, "p", "double")
    curve = settle(pk.value_runs(table, rows=64))
    expected = rows_of(pk.prominences(curve, "p", fan_in=64), "peak", "height", "prominence")
    for sent in (4096, 0):
        monkeypatch.setattr(pk, "SENT_BLOCKS", sent, raising=False)
        found = pk.prominences(curve, "p", fan_in=4)
        assert "collect_list" not in physical(found)
        assert rows_of(found, "peak", "height", "prominence") == expected
    assert "BroadcastExchange" not in tree(found)


def test_every_demonstration_has_weights_or_is_listed_as_too_short(spark, tmp_path):
    from seqseg.plans.catalog import all_queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    users = [r[0] for r in events.groupBy("user_id").count().where("count >= 3").orderBy("user_id").limit(3).collect()]
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kept = F.when(F.col("user_id") == users[0], 1).when(F.col("user_id") == users[1], 2).otherwise(10**9)
    events.withColumn("nth", nth).where(F.col("nth") <= kept).drop("nth").write.parquet(f"{tmp_path}/events.parquet")
    queries = all_queries()
    short = {r["episode_index"]: r["n_frames"] for r in queries["demos_too_short"](spark, str(tmp_path)).collect()}
    weighed = {r[0] for r in queries["demo_weights"](spark, str(tmp_path)).select("episode_index").distinct().collect()}
    every = {r[0] for r in ad.ev_frames(spark, str(tmp_path)).select("episode_index").distinct().collect()}
    assert (short[users[0]], short[users[1]]) == (1, 2)
    assert not weighed & set(short) and weighed | set(short) == every
