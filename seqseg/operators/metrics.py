"""Corpus metrics of a predicted segmentation against the truth.

Input is a frame table with a predicted and a true label. Segments of both sides are
encoded in one pass; everything after that works on segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqseg.functions import vectors
from seqseg.operators.ordered import (
    BUCKET_ROWS,
    FRAME,
    KEYS,
    bucket_of,
    one_row,
)
from seqseg.operators.runs import runs
from seqseg.session import settle

# Width of the time cells in which overlapping segments are looked up.
CELL = 64
# Segments whose symbols are joined to one string before they are gathered.
STRING_PART = 4096


def paired_frames(
    pred: DataFrame, gt: DataFrame, keys: Sequence[str] = KEYS, order: str = FRAME
) -> DataFrame:
    """Predicted (``pred``) and true (``gt``) labels of the same frames.

    A frame that only one side has (sequences of different length) fails the job.
    """
    on = [*keys, order]
    left = pred.select(*on, "pred", F.lit(True).alias("_p"))
    right = gt.select(*on, "gt", F.lit(True).alias("_g"))
    both = left.join(right, on, "full")
    wrong = F.raise_error(F.concat_ws(" ", F.lit("prediction and truth differ in length:"), *[F.col(k).cast("string") for k in keys]))
    missing = F.col("_p").isNull() | F.col("_g").isNull()
    return both.withColumn("gt", F.when(missing, wrong).otherwise(F.col("gt"))).drop("_p", "_g")


def frame_counts(
    frames: DataFrame, pred: str = "pred", gt: str = "gt", ignore=-100, by: Sequence[str] = ()
) -> DataFrame:
    """Correct and valid frames, over everything or by key."""
    valid = F.col(gt).isNotNull() if ignore is None else ~F.col(gt).eqNullSafe(F.lit(ignore))
    hit = valid & F.col(pred).eqNullSafe(F.col(gt))
    counted = [
        F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(valid.cast("long")), F.lit(0)).alias("total"),
    ]
    return frames.groupBy(*by).agg(*counted) if by else frames.agg(*counted)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def frame_accuracy(
    frames: DataFrame, pred: str = "pred", gt: str = "gt", ignore=-100, by: Sequence[str] = ()
) -> DataFrame:
    """Share of correct frames; 0 where no frame is valid."""
    counts = frame_counts(frames, pred, gt, ignore, by)
    return counts.withColumn("acc", share(F.col("correct"), F.col("total")))


def paired_runs(
    frames: DataFrame,
    pred: str = "pred",
    gt: str = "gt",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Runs of both label columns, told apart by ``side``, from a single exchange."""
    sides = F.array(
        F.struct(F.lit("gt").alias("side"), F.col(gt).alias("label")),
        F.struct(F.lit("pred").alias("side"), F.col(pred).alias("label")),
    )
    stacked = frames.select(*keys, order, F.inline(sides))
    return runs(stacked, "label", [*keys, "side"], order, rows)


def _foreground(background: Sequence) -> Column:
    return ~F.col("label").isin(list(background)) if background else F.lit(True)


def edit_scores(
    segments: DataFrame, background: Sequence = (), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Edit score of each episode: 100 - 100 * distance / longer sequence.

    Every class of an episode becomes one character (null is a class too) and the built-in
    Levenshtein distance compares the strings. Strings are put together in two steps, so what is gathered per
    episode is one character per segment. The distance itself is quadratic in the
    number of segments of one episode, by definition.
    """
    labels = segments.select(*keys, F.col("label").alias("_label")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_label")) - 1
    symbols = labels.select(*[F.col(k).alias(f"_{k}") for k in keys], "_label", symbol(place).alias("_symbol"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("label").eqNullSafe(F.col("_label")))
    # Spark knows only the compressed size of segments in files: never broadcast them.
    marked = segments.join(symbols.hint("merge"), same).withColumn(
        "_symbol", F.when(_foreground(background), F.col("_symbol")).otherwise(F.lit(""))
    )
    pieces = marked.groupBy(
        *keys, "side", bucket_of(F.col("segment_index"), STRING_PART).alias("_part")
    ).agg(_joined("segment_index", "_symbol").alias("_text"))
    text = pieces.groupBy(*keys).agg(
        _joined("_part", "_text", F.col("side") == "pred").alias("pred_text"),
        _joined("_part", "_text", F.col("side") == "gt").alias("gt_text"),
    )
    longest = F.greatest(F.length("pred_text"), F.length("gt_text"))
    distance = F.when(F.col("pred_text") == F.col("gt_text"), F.lit(0)).otherwise(
        F.levenshtein("pred_text", "gt_text")
    )
    score = F.when(longest == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - distance / longest * F.lit(100.0)
    )
    return text.select(
        *keys,
        distance.cast("long").alias("distance"),
        F.length("pred_text").cast("long").alias("n_pred"),
        F.length("gt_text").cast("long").alias("n_gt"),
        score.alias("edit"),
    )


def symbol(index: Column) -> Column:
    """One character per class number: printable ASCII first, then the planes above the first."""
    far = F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000 - 94) + index), 8, "0")), "UTF-32")
    return F.when(index < 94, F.char(F.lit(33) + index)).otherwise(far)


def _joined(order: str, text: str, condition: Column | None = None) -> Column:
    item = F.struct(F.col(order), F.col(text).alias("_t"))
    if condition is not None:
        item = F.when(condition, item)
    ordered = F.array_sort(F.collect_list(item))
    return F.array_join(F.transform(ordered, lambda s: s["_t"]), "")


def _cell_of(position: Column, cell: int) -> Column:
    """Cell of a position on the level of the row."""
    return F.call_function("shiftright", F.floor(position / cell).cast("long"), F.col("_level"))


def _in_cells(segments: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """Segments once for every cell they touch, from their home level to the top of their episode."""

    def level_of(size: Column) -> Column:
        cells = F.floor((size - 1) / cell).cast("long")
        return F.when(cells < 1, 0).otherwise(F.length(F.bin(cells)))

    total = F.col("length") if "length" in segments.columns else F.max("end_frame").over(Window.partitionBy(*keys))
    placed = segments.select(
        *keys, "label", "side", "start_frame", "end_frame", total.alias("_total")
    )
    placed = placed.withColumn("_home", level_of(F.col("end_frame") - F.col("start_frame")))
    top = F.greatest("_home", level_of(F.greatest("_total", "end_frame")))
    spread = placed.withColumn("_level", F.explode(F.sequence("_home", top)))
    return spread.withColumn("_cell", F.explode(F.sequence(_cell_of(F.col("start_frame"), cell), _cell_of(F.col("end_frame") - 1, cell))))


def best_matches(
    segments: DataFrame, background: Sequence = (), keys: Sequence[str] = KEYS, cell: int = CELL
) -> DataFrame:
    """For every predicted segment its best overlapping true segment of the same label.

    Segments are looked up in cells of frames. The cells of a level are twice as long as
    those below, from ``cell`` frames up; a segment is at home on the first level whose
    cells are at least as long as it is, where it touches two at most, and two segments
    meet on the higher of their home levels, in the first cell they share. So a segment of
    any length is a few rows per level of its episode, and one huge episode with few labels
    stays a local join. IoU is intersection over the hull of both; of equals the earlier
    segment wins.
    """

    spread = _in_cells(segments.where(_foreground(background)), keys, cell)
    at_home = F.col("_level") == F.col("_home")

    def side(name: str, prefix: str, tags: Column) -> DataFrame:
        return spread.where(F.col("side") == name).select(
            *keys,
            "label",
            "_level",
            "_cell",
            F.explode(tags).alias("_tag"),
            F.col("start_frame").alias(f"{prefix}_start"),
            F.col("end_frame").alias(f"{prefix}_end"),
        )

    # Both at home (0), only the prediction (1), only the truth (2); never neither.
    tags = {
        "pred": F.when(at_home, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(2))),
        "gt": F.when(at_home, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1))),
    }
    # Both sides are spread from files, of which Spark knows the compressed size only: never broadcast them.
    on = [*keys, "label", "_level", "_cell", "_tag"]
    pairs = side("pred", "p", tags["pred"]).join(side("gt", "g", tags["gt"]).hint("merge"), on)
    begin = F.greatest("p_start", "g_start")
    shared = F.least("p_end", "g_end") - begin
    hull = F.greatest("p_end", "g_end") - F.least("p_start", "g_start")
    pairs = pairs.where((shared > 0) & (_cell_of(begin, cell) == F.col("_cell")))
    best = F.struct((shared / hull).alias("iou"), (-F.col("g_start")).alias("_g"))
    return (
        pairs.groupBy(*keys, "p_start")
        .agg(F.max(best).alias("_best"))
        .select(*keys, "p_start", F.col("_best.iou").alias("iou"), (-F.col("_best._g")).alias("g_start"))
    )


def f1_counts(
    segments: DataFrame,
    overlaps: Sequence[int] = (10, 25, 50),
    background: Sequence = (),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """True and false positives and misses of each episode at IoU thresholds in percent.

    Each prediction has exactly one candidate, so the number of hits is the number of
    distinct true segments reached; no matching loop is needed. Thresholds must be
    above zero.
    """
    if any(k <= 0 for k in overlaps):
        raise ValueError("overlap thresholds must be positive")
    thresholds = F.array(*[F.lit(int(k)) for k in overlaps])
    fore = _foreground(background)
    sizes = segments.groupBy(*keys).agg(
        F.sum((fore & (F.col("side") == "pred")).cast("long")).alias("n_pred"),
        F.sum((fore & (F.col("side") == "gt")).cast("long")).alias("n_gt"),
    )
    hits = (
        best_matches(segments, background, keys)
        .withColumn("overlap", F.explode(thresholds))
        .where(F.col("iou") >= F.col("overlap") / F.lit(100.0))
        .groupBy(*keys, "overlap")
        .agg(F.countDistinct("g_start").alias("tp"))
    )
    rows = sizes.withColumn("overlap", F.explode(thresholds)).join(hits, [*keys, "overlap"], "left")
    tp = F.coalesce("tp", F.lit(0).cast("long"))
    return rows.select(
        *keys,
        "overlap",
        tp.alias("tp"),
        (F.col("n_pred") - tp).alias("fp"),
        (F.col("n_gt") - tp).alias("fn"),
    )


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Percentages; zero wherever a denominator is zero."""
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    f1 = F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall))
    f1 = f1.otherwise(F.lit(0.0))
    return precision * 100.0, recall * 100.0, f1 * 100.0


def segmentation_report(
    frames: DataFrame,
    pred: str = "pred",
    gt: str = "gt",
    overlaps: Sequence[int] = (10, 25, 50),
    background: Sequence = (),
    ignore=-100,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row: ``acc``, ``edit``, ``f1_k``, ``precision_k``, ``recall_k``, ``num_videos``.

    Accuracy is over all frames, edit is the mean over episodes, F1 comes from the
    summed counts. Everything is zero for an empty input.
    """
    segments = settle(paired_runs(frames, pred, gt, keys, order, rows))
    acc = frame_counts(frames, pred, gt, ignore).select(
        (share(F.col("correct"), F.col("total")) * 100.0).alias("acc"),
    )
    edit = edit_scores(segments, background, keys).agg(
        F.coalesce(F.avg("edit"), F.lit(0.0)).alias("edit"),
        F.count(F.lit(1)).cast("double").alias("num_videos"),
    )
    counts = f1_counts(segments, overlaps, background, keys)
    sums = [
        F.coalesce(F.sum(F.when(F.col("overlap") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
        for k in overlaps
        for c in ("tp", "fp", "fn")
    ]
    totals = counts.agg(*sums)
    out = one_row([acc, edit, totals])
    columns = []
    for k in overlaps:
        parts = precision_recall_f1(*[F.col(f"{c}_{k}") for c in ("tp", "fp", "fn")])
        for name, value in zip(("precision", "recall", "f1"), parts):
            columns.append(value.alias(f"{name}_{k}"))
    return out.select("acc", "edit", *columns, "num_videos")


def argmax_labels(scores: DataFrame, logits: str = "logits", out: str = "pred") -> DataFrame:
    """Best class of each frame; the first one of equals."""
    return scores.withColumn(out, vectors.argmax(F.col(logits)))


def drop_padding(rows: DataFrame, mask: str = "mask") -> DataFrame:
    return rows.where(F.col(mask) == 1)
