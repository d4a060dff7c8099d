"""Sources and sinks against generated files."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from seqseg.operators import runs as rn
from seqseg.plans.tasks import resolve_task_text
from seqseg.sinks import features as sf, frames as sk, media as md, metadata as mt
from seqseg.sources import annotations as an, datasets as ds, features as fe


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("data") / "robot"
    for part in ("meta", "data/chunk-000", "videos/chunk-000/top", "videos/chunk-000/side"):
        (base / part).mkdir(parents=True)
    (base / "meta/info.json").write_text(json.dumps({"chunks_size": 1000, "fps": 30, "total_episodes": 3}, indent=4))
    (base / "meta/tasks.jsonl").write_text('{"task_index": 2, "task": "b"}\n\n{"task_index": 5, "task": "e"}\n{"task_index": 2, "task": "a2"}\n')
    config = [{"start_frame": 0, "end_frame": 4, "english_action_text": "reach", "action_text_id": 1}]
    episodes = [
        {"episode_index": 0, "length": 4, "tasks": ["a"], "action_config": config, "extra": {"k": 1}},
        {"episode_index": 1, "length": 3, "tasks": [2]},
        {"episode_index": 2, "length": 2, "task_index": 2},
        {"episode_index": 3, "task": "c"},
        {"episode_index": 4, "tasks": [9], "task_index": 5},
        {"episode_index": 5, "tasks": [""], "task": "x"},
        {"length": 7},
    ]
    (base / "meta/episodes.jsonl").write_text("\n".join(json.dumps(e) for e in episodes) + "\n")
    (base / "meta/action_text.json").write_text(json.dumps({"0": "background", "1": "reach", "x": "no"}, indent=4))
    for i, ids in enumerate([[0, 0, 1, 1], [1, 7, 7], None]):
        n = 2 if ids is None else len(ids)
        columns = {"value": np.arange(n) / 2}
        if ids is not None:
            columns["action_text_id"] = np.asarray(ids, dtype=np.int64)
        pq.write_table(pa.table(columns), base / f"data/chunk-000/episode_{i:06d}.parquet")
    for camera in ("top", "side"):
        (base / f"videos/chunk-000/{camera}/episode_000000.mp4").write_bytes(camera.encode())
    (base / "videos/chunk-000/top/notes.txt").write_text("no video")
    return base


def test_label_lines(spark, tmp_path):
    folder = tmp_path / "gt"
    folder.mkdir()
    (folder / "a.txt").write_text("reach\nreach \n\n pick\n\n")
    (folder / "b.c.txt").write_text("place")
    (folder / "empty.txt").write_text("\n \n")
    labels = an.read_label_lines(spark, str(folder))
    assert rows_of(labels, "video_id", "frame_index", "subtask") == [
        ("a", 0, "reach"), ("a", 1, "reach"), ("a", 2, "pick"), ("b.c", 0, "place"),
    ]
    assert rows_of(an.empty_annotations(spark, str(folder), labels), "video_id") == [("empty",)]


def test_label_lines_over_many_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("\n".join(f"l{i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        labels = an.read_label_lines(spark, str(path))
        assert labels.rdd.getNumPartitions() >= 1
        assert rows_of(labels, "frame_index", "subtask") == sorted((i, f"l{i}") for i in range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_label_csv(spark, tmp_path):
    cases = {
        "good": "frame_idx,subtask\n0,reach\n\n1, pick\n,\n2,\"a, b\"\n",
        "spaced": " Frame_Idx , SubTask ,note\n0,reach,x\n",
        "header": "idx,subtask\n0,reach\n",
        "gap": "frame_idx,subtask\n0,a\n1,a\n3,a\n",
        "twice": "frame_idx,subtask\n0,a\n1,a\n1,a\n",
        "late": "frame_idx,subtask\n1,a\n2,a\n",
        "text": "frame_idx,subtask\nzero,a\n",
        "blank": "frame_idx,subtask\n0,\n",
        "short": "frame_idx,subtask\n0\n",
    }
    for name, text in cases.items():
        (tmp_path / f"{name}.csv").write_text(text)
    labels, violations = an.read_label_csv(spark, str(tmp_path))
    assert rows_of(labels, "video_id", "frame_index", "subtask") == [
        ("good", 0, "reach"), ("good", 1, "pick"), ("good", 2, "a, b"), ("spaced", 0, "reach"),
    ]
    got = {r["video_id"]: (r["frame_index"], r["reason"]) for r in violations.collect()}
    assert got == {
        "header": (-1, "bad header"),
        "gap": (2, "missing frame_idx"),
        "twice": (2, "out of order or duplicate frame_idx"),
        "late": (0, "missing frame_idx"),
        "text": (0, "frame_idx is not an integer"),
        "blank": (0, "empty label"),
        "short": (0, "expected at least 2 columns"),
    }


def test_mapping_and_split(spark, tmp_path):
    (tmp_path / "mapping.txt").write_text("# ids\n0 background\n\n1 reach cup\nbad\nx pick\n3 reach cup\n")
    vocab, bad = an.read_mapping(spark, str(tmp_path / "mapping.txt"))
    assert rows_of(vocab, "name", "action_text_id") == [("background", 0), ("reach cup", 3)]
    assert rows_of(bad, "line") == [("bad",), ("x pick",)]
    (tmp_path / "train.bundle").write_text("S1_A.txt\n# no\n\nS2.v1.txt\n")
    split = an.read_split(spark, str(tmp_path / "train.bundle"), "train")
    assert rows_of(split, "split", "file_name", "video_id") == [("train", "S1_A.txt", "S1_A"), ("train", "S2.v1.txt", "S2.v1")]


def test_missing_labels(spark):
    features = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "video_id string, frame_index bigint")
    labels = spark.createDataFrame([("a", 0, 4)], "video_id string, frame_index bigint, label bigint")
    found = an.missing_labels_as(features, labels)
    assert rows_of(found, "video_id", "frame_index", "label") == [("a", 0, 4), ("b", 0, 0)]


def test_metadata(spark, root):
    episodes = ds.read_episodes(spark, str(root), "robot")
    tasks = ds.read_tasks(spark, str(root), "robot")
    texts = resolve_task_text(episodes, tasks)
    assert rows_of(texts, "episode_index", "task_text") == [(0, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "e"), (5, "")]
    raw = resolve_task_text(episodes, tasks, raw=True)
    assert rows_of(raw, "episode_index", "task_text")[1] == (1, "2")
    info = ds.read_info(spark, str(root), "robot").collect()[0]
    assert (info["chunks_size"], info["total_episodes"], info["data_path"]) == (1000, 3, ds.DATA_PATH)
    assert rows_of(ds.read_action_text(spark, str(root / "meta/action_text.json")), "action_text_id", "name") == [
        (0, "background"), (1, "reach"),
    ]
    assert ds.read_json_lines(spark, str(root / "meta/none.jsonl")).count() == 0
    assert ds.read_json_object(spark, str(root / "meta/none.json")).count() == 0
    given = rn.flatten_action_config(episodes)
    assert rows_of(given, "episode_index", "start_frame", "end_frame", "english_action_text") == [(0, 0, 4, "reach")]


def test_frames(spark, root):
    frames = ds.read_frames(spark, str(root), "robot")
    assert rows_of(frames, "episode_index", "frame_index", "value")[:4] == [(0, 0, 0.0), (0, 1, 0.5), (0, 2, 1.0), (0, 3, 1.5)]
    assert rows_of(frames.where("action_text_id is null"), "episode_index", "frame_index") == [(2, 0), (2, 1)]
    vocab = ds.read_action_text(spark, str(root / "meta/action_text.json"))
    found = rn.segment_texts(rn.runs(frames.where("action_text_id is not null"), "action_text_id"), vocab)
    assert rows_of(found, "episode_index", "start_frame", "end_frame", "english_action_text") == [
        (0, 0, 2, "background"), (0, 2, 4, "reach"), (1, 0, 1, "reach"), (1, 1, 3, "class_7"),
    ]
    import re

    assert re.search(ds.episode_pattern(), "x/data/chunk-012/episode_012345.parquet").group(1) == "012345"


def test_media(spark, root):
    media = ds.read_media(spark, str(root), "robot", content_hash=True)
    expected = sorted((0, c, hashlib.md5(c.encode()).hexdigest()) for c in ("top", "side"))
    assert rows_of(media, "episode_index", "camera", "md5") == expected
    existing = media.where("camera = 'top'").select("path")
    episodes = spark.createDataFrame([("robot", 0)], "dataset string, episode_index bigint")
    plan = md.link_plan(media, episodes, existing)
    assert rows_of(plan, "camera", "status") == [("side", "hardlink"), ("top", "skipped")]
    assert rows_of(md.link_counts(plan), "status", "n") == [("hardlink", 1), ("skipped", 1)]


def test_grammar_file(spark, tmp_path):
    path = tmp_path / "grammar.yaml"
    path.write_text("tasks:\n  tiny:\n    sequence: [reach, pick]\n")
    assert rows_of(ds.read_grammar(spark, str(path)), "task", "pos", "name") == [("tiny", 0, "reach"), ("tiny", 1, "pick")]
    for bad in ({}, {"tasks": {}}, {"tasks": {"a": {}}}, {"tasks": {"a": {"sequence": []}}}, {"tasks": {"a": {"sequence": [1]}}}):
        with pytest.raises(ValueError):
            ds.grammar_table(spark, bad)


def test_array_files(spark, tmp_path):
    values = np.arange(24, dtype=np.float32).reshape(6, 4)
    np.save(tmp_path / "rows.npy", values)
    np.save(tmp_path / "columns.npy", values.T)
    np.save(tmp_path / "wide.npy", np.zeros((3, 5), dtype=np.float32))
    found = fe.read_two_stream_arrays(spark, str(tmp_path), width=2)
    for name in ("rows", "columns"):
        got = found.where(F.col("video_id") == name).orderBy("frame_index").collect()
        assert [list(r["rgb"]) + list(r["flow"]) for r in got] == values.tolist()
    assert [r["problem"] for r in found.where("problem is not null").collect()] == ["expected width 4, got 5"]


def test_feature_archives(spark, tmp_path):
    def save(name, **arrays):
        buffer = io.BytesIO()
        np.savez_compressed(buffer, **arrays)
        (tmp_path / f"{name}.npz").write_bytes(buffer.getvalue())

    x = np.ones((3, 2), dtype=np.float16)
    save("full", rgb=x, flow=x * 2, labels=np.array([1, 0, 2], dtype=np.int32), meta=np.array('{"fps": 30.0, "T_feat": 3}'))
    save("one", rgb=x, flow=np.empty((0, 0)), labels=np.empty(0, dtype=np.int32), meta=np.array("{}"))
    save("bad", rgb=x, flow=x[:2], labels=np.zeros(3, dtype=np.int32))
    save("less", rgb=x)
    found = fe.read_feature_archives(spark, str(tmp_path), width=2)
    full = found.where("video_id = 'full'").orderBy("frame_index").collect()
    assert [r["label"] for r in full] == [1, 0, 2] and list(full[1]["flow"]) == [2.0, 2.0]
    one = found.where("video_id = 'one'").collect()
    assert len(one) == 3 and one[0]["flow"] is None and one[0]["label"] is None
    problems = {r["video_id"] for r in found.where("problem is not null").collect()}
    assert problems == {"bad", "less"}
    target = str(tmp_path / "features")
    sf.write_features(found.where("problem is null").drop("problem").withColumn("dataset", F.lit("d")), target)
    back = spark.read.parquet(target)
    assert back.count() == 6 and back.where("video_id = 'full'").first()["meta"]["T_feat"] == 3


def test_relabel_pads_and_cuts(spark, frames):
    table = frames({0: [5, 6, 7, 8], 1: [1, 1], 2: [3]}, "action_text_id")
    predicted = frames({0: [1, 2], 1: [4, 5, 6]}, "action_text_id")
    for rows in (2, 1000):
        found = sk.relabel(table, predicted, rows=rows)
        assert rows_of(found, "episode_index", "frame_index", "action_text_id") == [
            (0, 0, 1), (0, 1, 2), (0, 2, 2), (0, 3, 2), (1, 0, 4), (1, 1, 5), (2, 0, 0),
        ]


def test_dataset_round_trip(spark, root, tmp_path):
    out = str(tmp_path / "out")
    frames = ds.read_frames(spark, str(root), "robot").where("action_text_id is not null")
    vocab = ds.read_action_text(spark, str(root / "meta/action_text.json"))
    sk.write_frames(frames, f"{out}/data", rows=2)
    back = ds.read_frames(spark, out, "robot")
    columns = ("episode_index", "frame_index", "action_text_id", "value")
    assert rows_of(back, *columns) == rows_of(frames, *columns)
    segments = rn.segment_texts(rn.runs(back, "action_text_id"), vocab)
    nested = rn.nested_segments(segments).join(
        segments.groupBy("dataset", "episode_index").agg(F.max("length").alias("length")), ["dataset", "episode_index"]
    )
    episodes = ds.read_episodes(spark, str(root), "robot")
    records = mt.episode_records(episodes, nested)
    info = mt.updated_info(ds.read_info(spark, str(root), "robot"), nested)
    mt.write_metadata(out, info, ds.read_tasks(spark, str(root), "robot").drop("dataset", "place"), records, vocab)
    again = ds.read_episodes(spark, out, "robot")
    got = {r["episode_index"]: r for r in again.collect()}
    assert set(got) == {0, 1} and got[0]["length"] == 4 and got[1]["length"] == 3
    assert [s["english_action_text"] for s in got[1]["action_config"]] == ["reach", "class_7"]
    assert json.loads(got[0]["tasks"]) == ["a"]
    extra = again.select("episode_index", F.try_variant_get("record", "$.extra.k", "int").alias("k"))
    assert rows_of(extra.where("k is not null"), "episode_index", "k") == [(0, 1)]
    assert rows_of(ds.read_action_text(spark, f"{out}/meta/action_text.json"), "action_text_id", "name") == [
        (0, "background"), (1, "reach"),
    ]
    written = json.loads("".join(r["value"] for r in spark.read.text(f"{out}/meta/info.json").collect()))
    source = json.loads((root / "meta/info.json").read_text())
    assert written == source | {"total_episodes": 2, "total_frames": 7, "splits": {"train": "0:2"}}
