"""Worked examples: metrics, resampling, windows, boundaries, text, grammar, scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import KEYS, rows_of
from seqseg.functions import grid, text as tx
from seqseg.operators import (
    features as ft,
    grammar as gr,
    metrics as mt,
    ordered as od,
    resample as rs,
    runlog as rl,
    sampling as sp,
    scores as sc,
    select as sl,
    trajectory as tj,
    transitions as tr,
    validate as va,
    vocab as vc,
)


def pairs(spark, cases):
    rows = [("d", e, t, g, p) for e, (gt, pred) in enumerate(cases) for t, (g, p) in enumerate(zip(gt, pred))]
    return spark.createDataFrame(rows, "dataset string, episode_index bigint, frame_index bigint, gt bigint, pred bigint")


CASES = [
    ([1, 1, 1, 2, 2, 3, 3, 3, 3], [1, 1, 1, 2, 2, 3, 3, 3, 3]),
    ([1, 2, 3], [3, 2, 1]),
    ([1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4], [1, 1, 2, 2, 2, 2, 2, 3, 3, 1, 1, 1, 1]),
    ([1] * 10 + [2] * 5 + [3] * 5, [1] * 4 + [2] * 11 + [3] * 5),
]


def test_metric_examples(spark):
    segments = mt.paired_runs(pairs(spark, CASES), rows=4).cache()
    edit = {r["episode_index"]: r["edit"] for r in mt.edit_scores(segments).collect()}
    assert edit[0] == 100 and abs(edit[1] - 100 / 3) < 1e-9 and edit[2] == 75 and edit[3] == 100
    counts = {
        (r["episode_index"], r["overlap"]): (r["tp"], r["fp"], r["fn"]) for r in mt.f1_counts(segments).collect()
    }
    for k in (10, 25, 50):
        assert counts[0, k] == (3, 0, 0) and counts[2, k] == (3, 1, 1)
    assert counts[3, 50] == (1, 2, 2) and counts[3, 10] == counts[3, 25] == (3, 0, 0)
    rows = spark.createDataFrame([(3, 1, 1), (1, 2, 2), (0, 0, 0)], "tp bigint, fp bigint, fn bigint")
    f1 = [r[0] for r in rows.select(mt.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))[2]).collect()]
    assert abs(f1[0] - 75) < 1e-9 and abs(f1[1] - 100 / 3) < 1e-9 and f1[2] == 0


def test_accuracy_examples(spark):
    cases = [([1, 1, -100, 2, -100, 3, 3], [1, 1, 9, 2, 9, 3, 3]), ([-100] * 3, [1, 2, 3])]
    found = mt.frame_accuracy(pairs(spark, cases), by=["episode_index"])
    assert rows_of(found, "episode_index", "acc") == [(0, 1.0), (1, 0.0)]
    plain = mt.frame_accuracy(pairs(spark, cases[:1]), ignore=None)
    assert abs(plain.first()["acc"] - 5 / 7) < 1e-12


def test_all_background(spark):
    segments = mt.paired_runs(pairs(spark, [([0, 0, 0], [0, 0, 0])]))
    assert mt.edit_scores(segments, [0]).first()["edit"] == 100
    assert {(r["tp"], r["fp"], r["fn"]) for r in mt.f1_counts(segments, background=[0]).collect()} == {(0, 0, 0)}
    report = mt.segmentation_report(pairs(spark, [([0, 0], [0, 0])]), background=[0]).first()
    assert (report["acc"], report["edit"], report["f1_50"], report["num_videos"]) == (100, 100, 0, 1)
    empty = mt.segmentation_report(pairs(spark, [])).first()
    assert all(v == 0 for v in empty)


def greedy_f1(gt, pred, overlap, background):
    def runs(labels):
        edges = [i for i in range(len(labels)) if i == 0 or labels[i] != labels[i - 1]] + [len(labels)]
        return [(labels[a], a, b) for a, b in zip(edges, edges[1:]) if labels[a] not in background]

    g, p = runs(gt), runs(pred)
    taken, tp = set(), 0
    for label, a, b in p:
        best, at = 0.0, None
        for j, (other, c, d) in enumerate(g):
            if other == label:
                iou = (min(b, d) - max(a, c)) / (max(b, d) - min(a, c))
                if iou > best:
                    best, at = iou, j
        if at is not None and best >= overlap and at not in taken:
            taken.add(at)
            tp += 1
    return tp, len(p) - tp, len(g) - tp


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    cases = []
    for n in (5, 40, 150, 300):
        gt = np.repeat(rng.integers(0, 4, size=n), rng.integers(1, 6, size=n))[:n].tolist()
        pred = np.where(rng.random(n) < 0.3, rng.integers(0, 4, size=n), gt).tolist()
        cases.append((gt, pred))
    segments = mt.paired_runs(pairs(spark, cases), rows=32).cache()
    for background in ([], [0]):
        found = mt.f1_counts(segments, (10, 50), background).collect()
        for r in found:
            gt, pred = cases[r["episode_index"]]
            assert (r["tp"], r["fp"], r["fn"]) == greedy_f1(gt, pred, r["overlap"] / 100, background)
            assert r["tp"] + r["fp"] == sum(
                1 for i, v in enumerate(pred) if (i == 0 or v != pred[i - 1]) and v not in background
            )
        for r in mt.edit_scores(segments, background).collect():
            sequences = [
                [v for i, v in enumerate(x) if (i == 0 or v != x[i - 1]) and v not in background]
                for x in cases[r["episode_index"]]
            ]
            assert r["distance"] == edit_distance(*sequences)


def test_many_classes_get_distinct_symbols(spark):
    symbols = spark.range(20_000).select(mt.symbol(F.col("id")).alias("s"))
    assert symbols.distinct().count() == 20_000
    assert symbols.where(F.length("s") != 1).count() == 0


@pytest.mark.parametrize(
    "rule, n, k, expected",
    [
        ("nearest", 11, 5, [0, 2, 5, 8, 10]),
        ("floor", 11, 5, [0, 2, 5, 7, 10]),
        ("nearest", 10, 4, [0, 3, 6, 9]),
        ("floor", 10, 4, [0, 3, 6, 9]),
        ("centre", 3, 10, [0, 0, 0, 1, 1, 1, 1, 2, 2, 2]),
        ("nearest", 7, 1, [0]),
        ("nearest", 1, 4, [0, 0, 0, 0]),
        ("nearest", 6, 6, [0, 1, 2, 3, 4, 5]),
        ("centre", 6, 6, [0, 1, 2, 3, 4, 5]),
    ],
)
def test_resample_examples(frames, rule, n, k, expected):
    found = rs.resample(frames({0: list(range(n))}), ["label"], F.lit(k), rule, rows=4)
    assert [r["label"] for r in found.orderBy("frame_index").collect()] == expected


@pytest.mark.parametrize("rule", ["nearest", "floor", "centre"])
def test_resample_against_numpy(frames, rule):
    shapes = [(n, k) for n in (1, 2, 5, 17, 64) for k in (1, 2, 3, 16, 63, 200)]
    table = frames({i: list(range(n)) for i, (n, _) in enumerate(shapes)})
    targets = F.element_at(F.array(*[F.lit(k) for _, k in shapes]), (F.col("episode_index") + 1).cast("int"))
    found = rs.resample(table, ["label"], targets, rule, rows=16)
    got: dict = {}
    for e, t, v in rows_of(found, "episode_index", "frame_index", "label"):
        got.setdefault(e, []).append(v)
    for i, (n, k) in enumerate(shapes):
        if rule == "centre":
            index = np.clip(np.floor((np.arange(k) + 0.5) * (n / k)).astype(int), 0, n - 1)
        elif rule == "floor":
            index = np.linspace(0, n - 1, num=k, dtype=np.int64)
        else:
            index = np.linspace(0, n - 1, num=k).round().astype(int)
        assert got[i] == index.tolist(), (n, k)


def test_missing_episodes_become_defaults(spark, frames):
    found = rs.resample(frames({0: [4, 5]}), ["label"], F.lit(3))
    episodes = spark.createDataFrame([("d", 0, 3), ("d", 1, 2), ("d", 2, 0)], "dataset string, episode_index bigint, k bigint")
    filled = rs.fill_missing_episodes(found, episodes, "k", {"label": F.lit(0).cast("long")})
    assert rows_of(filled, "episode_index", "frame_index", "label") == [(0, 0, 4), (0, 1, 4), (0, 2, 5), (1, 0, 0), (1, 1, 0)]


def test_window_counts(spark, frames):
    lengths = [16, 17, 24, 25, 33, 100]
    table = frames({t: [0] * t for t in lengths})
    count = rs.sliding_windows(table, {}, both_streams=True).groupBy("episode_index").count()
    got = dict(rows_of(count, "episode_index", "count"))
    assert [got.get(t, 0) for t in lengths] == [0, 1, 1, 2, 3, 11]
    formula = spark.createDataFrame([(t,) for t in lengths], "t bigint").select(
        "t", rs.window_count(F.col("t"), 16, 8, True).alias("n")
    )
    assert dict(rows_of(formula, "t", "n")) == {t: got.get(t, 0) for t in lengths}
    padded = rs.padded_windows(table, {"n": lambda w: F.sum(w)}, rows=32)
    got = dict(rows_of(padded.groupBy("episode_index").count(), "episode_index", "count"))
    assert [got[t] for t in lengths] == [1, 2, 2, 3, 4, 12]
    assert {r["n"] for r in padded.collect()} == {16}
    short = rs.padded_windows(frames({0: [1, 2, 3]}), {"s": lambda w: F.sum(F.col("label") * w)}, 5, 2)
    assert rows_of(short, "window_index", "s") == [(0, 1 + 2 + 3 * 3)]
    far = rs.padded_windows(frames({0: [1, 2, 3]}), {"s": lambda w: F.sum(F.col("label") * w)}, 1, 5)
    assert rows_of(far, "window_index", "s") == [(0, 1), (1, 3)]


def test_stride_sample_offsets(frames):
    table = frames({e: list(range(20)) for e in range(30)})
    plain = rs.stride_sample(table, 4)
    assert rows_of(plain.where("episode_index = 0"), "frame_index", "label") == [(i, 4 * i) for i in range(5)]
    moved = rs.stride_sample(table, 4, jitter=3, seed=1)
    starts = dict(rows_of(moved.where("frame_index = 0"), "episode_index", "label"))
    assert set(starts.values()) <= {0, 1, 2, 3} and len(set(starts.values())) > 1
    assert rows_of(moved, "episode_index", "label") == rows_of(rs.stride_sample(table, 4, 3, 1), "episode_index", "label")


@pytest.mark.parametrize("rows", [5, 1000])
@pytest.mark.parametrize(
    "ids, mode, expected",
    [
        ([0] * 8 + [1] * 16, "code", [0, 0, 0]),
        ([0] * 8 + [1] * 16, "spec", [0, 1, 0]),
        ([0] * 8 + [1] * 4 + [2] * 12, "code", [0, 1, 0]),
        ([0] * 8 + [1] * 4 + [2] * 12, "spec", [0, 1, 0]),
    ],
)
def test_step_boundaries(spark, frames, rows, ids, mode, expected):
    steps = spark.createDataFrame([("d", 0, 3)], "dataset string, episode_index bigint, t_feat bigint")
    found = tr.step_boundaries(frames({0: ids}), steps, 8, mode, rows=rows)
    assert [b for _, b in rows_of(found, "step", "boundary")] == expected


def test_soft_boundaries(spark):
    rows = [("d", 0, t, int(t == 10)) for t in range(30)] + [("d", 1, t, int(t in (4, 5))) for t in range(9)]
    table = spark.createDataFrame(rows, "dataset string, episode_index bigint, step bigint, boundary int")
    soft = {(e, t): x for e, t, x in rows_of(tr.soft_boundaries(table), "episode_index", "step", "soft")}
    weights = [1, 0.882497, 0.606531, 0.324652, 0.135335, 0.043937, 0.011109, 0]
    assert all(abs(soft[0, 10 + d] - w) < 1e-6 and abs(soft[0, 10 - d] - w) < 1e-6 for d, w in enumerate(weights))
    assert soft[1, 4] == soft[1, 5] == 1.0 and len(soft) == 39
    hard = tr.soft_boundaries(table, 0.0)
    assert rows_of(hard.where("soft > 0"), "episode_index", "step") == [(0, 10), (1, 4), (1, 5)]


def test_sampled_frames(spark):
    rows = [("d", 0, 0, 0, 20, 200), ("d", 0, 1, 5, 9, 200), ("d", 0, 2, 300, 310, 200), ("d", 0, 3, 7, 7, 200)]
    table = spark.createDataFrame(
        rows, "dataset string, episode_index bigint, segment_index bigint, start_frame bigint, end_frame bigint, length bigint"
    )
    found = sp.centre_frames(table, 8)
    got: dict = {}
    for s, _, f in rows_of(found, "segment_index", "slot", "frame"):
        got.setdefault(s, []).append(f)
    assert got[0] == [1, 3, 6, 8, 11, 13, 16, 18] and got[1] == [5, 5, 6, 6, 7, 7, 8, 8]
    assert got[2] == [199] * 8 and got[3] == [7] * 8
    four = sp.centre_frames(spark.createDataFrame([("d", 0, 0, 0, 100, 100)], table.schema), 4)
    assert [f for _, f in rows_of(four, "slot", "frame")] == [12, 37, 62, 87]
    binned = sp.binned_frames(table, 8, seed=3)
    for r in binned.collect():
        assert r["bin_start"] <= r["frame"] < r["bin_end"]
    assert {r["frame"] for r in binned.where("segment_index = 3").collect()} == {7}


def test_supervised_spans(spark):
    rows = [(0, [5, 6, 7], 1), (1, [8], 4), (2, [1, 2], 0)]
    table = spark.createDataFrame(rows, "id bigint, input_ids array<bigint>, prompt_len int")
    found = sp.supervised_spans(table, 2, ["id"])
    got = {r["id"]: (r["batch_id"], r["input_ids"], r["labels"], r["attention_mask"]) for r in found.collect()}
    assert got[0] == (0, [5, 6, 7], [-100, 6, 7], [1, 1, 1])
    assert got[1] == (0, [8, 0, 0], [-100, -100, -100], [1, 0, 0])
    assert got[2] == (1, [1, 2], [1, 2], [1, 1])


@pytest.mark.parametrize("rows", [2, 1000])
def test_padded_batches(spark, frames, rows):
    table = frames({0: [1, 2, 3, 4, 5], 1: [7], 2: [8, 9]})
    found = sp.padded_batches(table, od.lengths(table), 2, {"label": F.lit(-100)}, rows=rows)
    got: dict = {}
    for b, s, t, v, m in rows_of(found, "batch_id", "slot", "frame_index", "label", "mask"):
        got.setdefault((b, s), []).append((v, m))
    assert got[0, 0] == [(v, 1) for v in (1, 2, 3, 4, 5)]
    assert got[0, 1] == [(7, 1)] + [(-100, 0)] * 4
    assert got[1, 0] == [(8, 1), (9, 1)]


def test_feature_augmentation(spark):
    rows = [("d", e, t, [1.0] * 8, [2.0] * 8) for e in range(20) for t in range(10)]
    table = spark.createDataFrame(rows, "dataset string, episode_index bigint, frame_index bigint, rgb array<double>, flow array<double>")
    channels: dict = {}
    for r in sp.feature_dropout(table, p_channel=0.3, seed=1).collect():
        channels.setdefault(r["episode_index"], set()).add((tuple(r["rgb"]), tuple(r["flow"])))
    assert all(len(v) == 1 for v in channels.values()) and len({next(iter(v)) for v in channels.values()}) > 1
    kept = np.mean([np.mean(next(iter(v))[0]) for v in channels.values()])
    assert 0.5 < kept < 0.9
    for r in sp.feature_dropout(table, p_time=0.4, seed=1).collect():
        assert sum(r["rgb"]) in (0, 8) and (sum(r["rgb"]) == 0) == (sum(r["flow"]) == 0)
    noisy = np.array([r["rgb"] for r in sp.gaussian_noise(table, 0.5, seed=2).collect()]) - 1.0
    assert abs(noisy.mean()) < 0.05 and abs(noisy.std() - 0.5) < 0.05
    with pytest.raises(ValueError):
        sp.feature_dropout(table, p_channel=1.0)


def test_open_vocabulary(spark):
    texts = ["Reach cup", "reach cup ", "", "Background", "Lift"]
    rows = [("d", 0, i, i, i + 1, t) for i, t in enumerate(texts)] + [("d", 0, 9, 5, 5, "Nothing")]
    table = spark.createDataFrame(
        rows, "dataset string, episode_index bigint, segment_index bigint, start_frame bigint, end_frame bigint, text string"
    )
    vocab = vc.first_seen(table)
    assert rows_of(vocab, "action_text_id", "name") == [(0, "background"), (1, "Reach cup"), (2, "Lift")]
    ids = vc.apply_first_seen(table, vocab)
    assert [i for _, i in rows_of(ids, "segment_index", "action_text_id")] == [1, 1, 0, 0, 2, 0]


def test_union_vocabulary(spark):
    names = spark.createDataFrame([("pick",), ("background",), ("move",), ("pick",), ("Zip",)], "name string")
    vocab = vc.union_vocab(names)
    assert rows_of(vocab, "action_text_id", "name") == [(0, "background"), (1, "Zip"), (2, "move"), (3, "pick")]
    bad = spark.createDataFrame([("throw",)], "label string")
    assert rows_of(vc.unknown_labels(bad, vocab), "label") == [("throw",)]
    with pytest.raises(Exception, match="unknown label: throw"):
        vc.strict_ids(bad, vocab).collect()


def test_cleaned_labels(spark):
    cases = {
        " Assistant: pick<|im_end|> ": "pick",
        "<|endoftext|>": "unknown",
        "assistant\n  assistant: ASSISTANT: assistant: go": "assistant: go",
        "　 lift  ": "lift",
        "assistants wave": "assistants wave",
        "": "unknown",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, "unknown")], "raw string, want string")
    for r in rows.select("want", tx.clean_label(F.col("raw")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_chat_examples(spark):
    rows = spark.createDataFrame([("make tea", "pick cup"), ("make tea", None)], "task string, target string")
    chats = [r[0] for r in rows.select(tx.segment_chat(F.col("task"), F.col("target"))).collect()]
    assert [m["role"] for m in chats[0]] == ["system", "user", "assistant"]
    assert [m["role"] for m in chats[1]] == ["system", "user"]
    assert chats[0][1]["content"][0]["type"] == "video" and chats[0][2]["content"][0]["text"] == "pick cup"
    assert "Task: make tea." in chats[0][1]["content"][1]["text"]
    summary = spark.range(1).select(tx.summary_chat(2)).first()[0]
    assert [c["type"] for c in summary[1]["content"]] == ["image", "image", "text"]


TINY = [("tiny", i, n) for i, n in enumerate(["reach", "pick", "place", "retract"])]


def test_grammar_example(spark):
    grammar = spark.createDataFrame(TINY, "task string, pos int, name string")
    names = ["background", *[n for _, _, n in TINY]]
    vocab = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, action_text_id bigint")
    allowed = gr.allowed_pairs(grammar, vocab)
    pairs_ = set(rows_of(allowed, "src", "dst"))
    assert len(pairs_) == 16 and ("pick", "reach") not in pairs_
    assert all((n, n) in pairs_ for n in names) and ("background", "reach") in pairs_ and ("reach", "background") in pairs_
    summary = gr.pair_summary(allowed, vocab).first()
    assert tuple(summary) == (5, 16, 9, 0.64)
    assert gr.forbidden_pairs(allowed, vocab).count() == 9
    assert rows_of(gr.missing_names(grammar, vocab.where("name <> 'background' and name <> 'pick'")), "name") == [("background",), ("pick",)]


def test_summary_of_many_classes_looks_at_allowed_pairs_only(spark):
    n = 10_000
    vocab = spark.range(n).selectExpr("concat('c', id) AS name", "id AS action_text_id")
    allowed = spark.range(n).selectExpr("concat('c', id) AS src", "concat('c', (id + 1) % 10001) AS dst")
    summary = gr.pair_summary(allowed.unionByName(allowed), vocab)
    assert tuple(summary.first()) == (n, n - 1, n * n - n + 1, (n - 1) / (n * n))
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert tuple(gr.pair_summary(allowed, vocab.where("false")).first()) == (0, 0, 0, None)


def test_mass_of_many_classes_takes_the_allowed_pairs(spark):
    n = 10_000
    rows = [("d", 0, t, [5.0 if c == t % 3 else 0.0 for c in range(n)]) for t in range(4)]
    table = spark.createDataFrame(rows, "dataset string, episode_index bigint, frame_index bigint, logits array<double>")
    allowed = [(i, i) for i in range(n)] + [(0, 1), (1, 2)]
    p = np.exp(np.array([r[3] for r in rows]))
    p /= p.sum(axis=1, keepdims=True)
    expected = np.mean([1 - sum(a[i] * b[j] for i, j in allowed) for a, b in zip(p, p[1:])])
    assert abs(sc.forbidden_mass(table, allowed=allowed).first()["trans"] - expected) < 1e-9


def test_composite_reads_the_scores_once(spark):
    table = scores_table(spark, [[[1.0, 2.0]] * 4]).withColumn("stage", F.lit(0))
    plan = sc.composite(table, [[0, 1], [1, 0]])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_cells_of_a_very_long_segment(spark):
    row = [("d", 0, "pred", "x", 5, 10**9 + 5, 3 * 10**9)]
    table = spark.createDataFrame(
        row, "dataset string, episode_index bigint, side string, label string, start_frame bigint, end_frame bigint, length bigint"
    )
    assert mt._in_cells(table, ["dataset", "episode_index"], mt.CELL).count() < 70


@pytest.mark.parametrize("cell", [1, 3, 64])
def test_best_matches_of_any_lengths_equal_brute_force(spark, cell):
    rng = np.random.default_rng(cell)
    rows = []
    for side in ("pred", "gt"):
        for e, scale in ((0, 3), (1, 40), (2, 700)):
            cuts = sorted(set(rng.integers(0, 2000, size=2000 // scale).tolist()))
            rows += [("d", e, side, str(rng.integers(0, 2)), a, b, 2000) for a, b in zip(cuts, cuts[1:])]
    table = spark.createDataFrame(
        rows, "dataset string, episode_index bigint, side string, label string, start_frame bigint, end_frame bigint, length bigint"
    )
    expected = {}
    for _, e, side, label, a, b, _ in rows:
        if side == "pred":
            over = [
                ((min(b, y) - max(a, x)) / (max(b, y) - min(a, x)), -x)
                for _, f, s, lab, x, y, _ in rows
                if s == "gt" and f == e and lab == label and min(b, y) > max(a, x)
            ]
            if over:
                expected[e, a] = (max(over)[0], -max(over)[1])
    for given in (table, table.drop("length")):
        found = mt.best_matches(given, cell=cell).collect()
        assert {(r["episode_index"], r["p_start"]): (r["iou"], r["g_start"]) for r in found} == expected


def test_contiguity(spark):
    cases = {0: [0, 1, 3], 1: [0, 1, 1], 2: [1, 2], 3: [0, 1]}
    rows = [("d", e, p, i) for e, idx in cases.items() for p, i in enumerate(idx)]
    table = spark.createDataFrame(rows, "dataset string, episode_index bigint, position bigint, frame_idx bigint")
    found = va.contiguity_violations(table)
    assert rows_of(found, "episode_index", "kind", "offending") == [
        (0, "missing", 2), (1, "out_of_order_or_duplicate", 1), (2, "missing", 0),
    ]


def scores_table(spark, logits, labels=None):
    rows = [("d", e, t, list(map(float, z)), 0, 1) for e, seq in enumerate(logits) for t, z in enumerate(seq)]
    return spark.createDataFrame(
        rows, "dataset string, episode_index bigint, frame_index bigint, logits array<double>, label bigint, mask int"
    )


def test_score_examples(spark):
    constant = scores_table(spark, [[[1.0, 2.0, 3.0]] * 6])
    assert sc.smoothness(constant, rows=2).first()["tmse"] == 0
    forbidden = [[0, 1], [1, 0]]
    still = scores_table(spark, [[[50.0, -50.0]] * 6])
    moving = scores_table(spark, [[[50.0, -50.0], [-50.0, 50.0]] * 3])
    assert sc.forbidden_mass(still, forbidden, rows=2).first()["trans"] < 1e-9
    assert 0.99 < sc.forbidden_mass(moving, forbidden, rows=2).first()["trans"] <= 1
    rng = np.random.default_rng(1)
    z = rng.normal(size=(2, 32, 5))
    table = scores_table(spark, z)
    logp = z - np.log(np.exp(z).sum(-1, keepdims=True))
    assert abs(sc.cross_entropy(table).first()["ce"] + logp[..., 0].mean()) < 1e-9
    change = np.minimum(np.abs(np.diff(logp, axis=1)), 4.0) ** 2
    assert abs(sc.smoothness(table, rows=10).first()["tmse"] - change.mean()) < 1e-9
    allowed = np.eye(5, dtype=bool)
    allowed[0, 1] = allowed[1, 2] = True
    p = np.exp(logp)
    mass = np.einsum("btc,btd,cd->bt", p[:, :-1], p[:, 1:], (~allowed).astype(float)).mean()
    got = sc.forbidden_mass(table, (~allowed).astype(float).tolist(), rows=10).first()["trans"]
    assert abs(got - mass) < 1e-9
    masked = table.withColumn("mask", F.when(F.col("frame_index") < 20, 1).otherwise(0))
    assert abs(sc.smoothness(masked, mask="mask", rows=7).first()["tmse"] - change[:, :19].mean()) < 1e-9
    parts = sc.composite(table.withColumn("stage", F.lit(0)), (~allowed).astype(float).tolist()).first()
    assert abs(parts["loss"] - (parts["ce"] + 0.15 * parts["tmse"] + 0.15 * parts["trans"])) < 1e-9


def test_boundary_scores(spark):
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=40) * 3, rng.random(40)
    rows = [("d", 0, t, float(z[t]), float(y[t])) for t in range(40)]
    table = spark.createDataFrame(rows, "dataset string, episode_index bigint, frame_index bigint, logit double, soft double")
    sig = 1 / (1 + np.exp(-z))
    bce = -(10 * y * np.log(sig) + (1 - y) * np.log(1 - sig)).mean()
    assert abs(sc.boundary_cross_entropy(table, 10.0).first()["bce"] - bce) < 1e-9
    smooth = (np.minimum(np.abs(np.diff(sig)), 0.2) ** 2).mean()
    assert abs(sc.boundary_smoothness(table, 0.2, rows=6).first()["smooth"] - smooth) < 1e-9


def test_features(spark, frames):
    assert ft.fibonacci(0) == [] and ft.fibonacci(1) == [1]
    assert ft.fibonacci(10) == [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]
    assert ft.receptive_field(5) == 39 and ft.receptive_field(10) == 463
    x = np.random.default_rng(0).normal(size=(6, 4))
    rows = [(i, v.tolist(), v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "i bigint, rgb array<double>, flow array<double>")
    weights = np.random.default_rng(1).normal(size=(4, 8))
    fused = ft.blend(ft.gate(table, weights, np.zeros(4)))
    for r in fused.collect():
        assert np.allclose(r["fused"], x[r["i"]]) and all(0 <= a <= 1 for a in r["alpha"])
    context = ft.lag_context(frames({0: [float(i) for i in range(1, 13)]}, "v", "double"), "v", 4, rows=5)
    got = {r["frame_index"]: (r["before_5"], r["after_3"], r["mix_2"]) for r in context.collect()}
    v = list(range(1, 13))
    for t in range(12):
        at = lambda i: float(v[i]) if 0 <= i < 12 else 0.0
        assert got[t] == (at(t - 5), at(t + 3), at(t - 2) + at(t) + at(t + 2))


def test_primitives_against_numpy(spark):
    rng = np.random.default_rng(4)
    demos = {0: rng.normal(size=12).cumsum(), 1: rng.normal(size=20).cumsum()}
    dt = 1.0 / 11
    rows = [("d", e, t, float(v), len(y), dt, float(y[0]), float(y[-1])) for e, y in demos.items() for t, v in enumerate(y)]
    table = spark.createDataFrame(
        rows, "dataset string, episode_index bigint, frame_index bigint, y double, length bigint, dt double, y0 double, goal double"
    )
    got = {(e, b): w for e, b, w in rows_of(tj.forcing_weights(table, 6, rows=5), "episode_index", "basis", "weight")}
    centres = np.exp(-np.linspace(0, 1, 6))
    widths = 1 / (np.diff(centres) ** 2 + 1e-8)
    widths = np.append(widths, widths[-1])
    for e, y in demos.items():
        dy = np.gradient(y, dt)
        ddy = np.gradient(dy, dt)
        x = (1 - dt) ** np.arange(len(y))
        f = ddy - 25.0 * (6.25 * (y[-1] - y) - dy)
        psi = np.exp(-widths * (x[:, None] - centres) ** 2)
        s = x * (y[-1] - y[0])
        w = (s[:, None] * psi * f[:, None]).sum(0) / ((s[:, None] ** 2 * psi).sum(0) + 1e-10)
        assert np.allclose([got[e, b] for b in range(6)], w)


@pytest.mark.parametrize("delta", [0.0, 0.05, 0.3])
def test_early_stop(spark, delta):
    rng = np.random.default_rng(int(delta * 100))
    runs = {f"r{i}": [None if rng.random() < 0.2 else float(s) for s in rng.random(25).round(2)] for i in range(12)}
    rows = [(r, e, s) for r, xs in runs.items() for e, s in enumerate(xs)]
    table = spark.createDataFrame(rows, "run_id string, epoch bigint, score double")
    for mode in ("max", "min"):
        sign = 1 if mode == "max" else -1
        expected = {}
        for r, xs in runs.items():
            best, wait, stop = None, 0, None
            for e, s in enumerate(xs):
                if s is None or stop is not None:
                    continue
                if best is None or sign * s > sign * best + delta:
                    best, wait = s, 0
                else:
                    wait += 1
                    stop = e if wait >= 4 else None
            expected[r] = stop
        found = rl.early_stop(table, "score", 4, mode, delta, rows=6)
        assert {r["run_id"]: r["stop_epoch"] for r in found.collect()} == expected


def test_accepted_records_of_one_long_run(spark):
    """Steps of 1, margin 2.5: every third record is accepted, found by few doubling jumps in small buckets."""
    n = 3_000
    table = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("epoch"), F.col("id").cast("double").alias("_s"))
    found = rl._accepted(table, 2.5, "run_id", 100)
    assert sorted(r["epoch"] for r in found.collect()) == list(range(0, n, 3))
    ties = rl._accepted(table, 2.0, "run_id", 100)
    assert sorted(r["epoch"] for r in ties.collect()) == list(range(0, n, 3))


def test_selection(spark):
    assert sl.broadcast_cameras(["a"], 3) == ["a"] * 3 and sl.broadcast_cameras(["a", "b"], 2) == ["a", "b"]
    with pytest.raises(ValueError):
        sl.broadcast_cameras(["a", "b"], 3)
    videos = spark.createDataFrame([("v1",), ("v2",)], "video_id string")
    splits = spark.createDataFrame([("train", "v1"), ("test", "v2")], "split string, video_id string")
    assert rows_of(sl.split_members(videos, splits, "val"), "video_id") == [("v2",)]
    assert rows_of(sl.split_members(videos, splits, "train"), "video_id") == [("v1",)]
