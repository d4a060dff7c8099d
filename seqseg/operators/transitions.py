"""Transition labels: where the label changes, at frame and at step resolution."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqseg.operators.ordered import (
    BUCKET,
    BUCKET_ROWS,
    FRAME,
    KEYS,
    bucket_of,
    bucket_range,
    neighbours,
)


def frame_transitions(
    frames: DataFrame,
    label: str = "label",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``changed`` is 1 where a frame's label differs from the frame before."""
    found = neighbours(
        frames,
        {"_before": lambda w: F.lag(label).over(w)},
        before=1,
        keys=keys,
        order=order,
        rows=rows,
    )
    changed = (F.col(order) > 0) & ~F.col("_before").eqNullSafe(F.col(label))
    return found.withColumn("changed", changed.cast("int")).drop("_before")


def step_boundaries(
    frames: DataFrame,
    steps: DataFrame,
    stride: int = 8,
    mode: str = "code",
    label: str = "label",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Flag the steps that contain a label change.

    ``steps`` has one row per episode with ``t_feat``, the number of steps to return.
    ``code`` counts a change only when both frames lie in the step, so a change
    exactly at a multiple of ``stride`` is not seen; ``spec`` counts it too. The grid
    of steps and the flagged steps meet in one aggregation; there is no join.
    """
    if mode not in ("code", "spec"):
        raise ValueError(f"mode must be 'code' or 'spec', got {mode!r}")
    moved = frame_transitions(frames.select(*keys, order, label), label, keys, order, rows)
    moved = moved.where("changed = 1")
    if mode == "code":
        moved = moved.where(F.pmod(F.col(order), F.lit(stride)) != 0)
    step = F.floor(F.col(order) / F.lit(stride)).cast("long")
    hits = moved.select(
        *keys, step.alias("_lo"), (step + 1).alias("_hi"), F.lit(1).alias("boundary"), F.lit(0).alias("_grid")
    )
    grid = steps.select(
        *keys,
        F.lit(0).cast("long").alias("_lo"),
        F.col("t_feat").cast("long").alias("_hi"),
        F.lit(0).alias("boundary"),
        F.lit(1).alias("_grid"),
    )
    return _on_grid(grid.unionByName(hits), F.max("boundary").alias("boundary"), keys, rows, "step")


def _on_grid(ranges: DataFrame, value, keys, rows: int, out: str) -> DataFrame:
    """Expand ranges bucket by bucket and aggregate; keep positions on the grid."""
    ranges = ranges.where(F.col("_hi") > F.col("_lo"))
    spanned = F.sequence(bucket_of(F.col("_lo"), rows), bucket_of(F.col("_hi") - 1, rows))
    pieces = ranges.withColumn(BUCKET, F.explode(spanned)).repartition(*keys, BUCKET)
    inside = bucket_range(F.col(BUCKET), F.col("_lo"), F.col("_hi"), rows)
    return (
        pieces.withColumn(out, F.explode(inside))
        .groupBy(*keys, BUCKET, out)
        .agg(value, F.max("_grid").alias("_grid"))
        .where("_grid = 1")
        .drop(BUCKET, "_grid")
    )


def boundary_density(boundaries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positive steps and their share per episode."""
    return boundaries.groupBy(*keys).agg(
        F.sum("boundary").alias("n_pos"), F.avg("boundary").alias("share")
    )


def soft_boundaries(
    boundaries: DataFrame,
    sigma: float = 2.0,
    value: str = "boundary",
    keys: Sequence[str] = KEYS,
    order: str = "step",
) -> DataFrame:
    """Gaussian soft labels around spikes, clamped to 0..1.

    Every step emits itself with weight zero, every spike its kernel; one keyed sum
    with map-side combine puts them together. Linear in steps plus spikes.
    """
    own = F.col(value).cast("double")
    if sigma <= 0:
        clamped = F.least(F.greatest(own, F.lit(0.0)), F.lit(1.0))
        return boundaries.select(*keys, order, clamped.alias("soft"))
    half = max(1, math.ceil(3.0 * sigma))
    kernel = F.array(
        *[
            F.struct(
                F.lit(d).cast("long").alias("d"),
                F.lit(math.exp(-(d * d) / (2.0 * sigma * sigma))).alias("w"),
            )
            for d in range(-half, half + 1)
            if d != 0
        ]
    )
    centre = F.array(F.struct(F.lit(0).cast("long").alias("d"), F.lit(1.0).alias("w")))
    taps = F.when(own != 0, F.concat(centre, kernel)).otherwise(centre)
    spread = boundaries.select(*keys, order, own.alias("_b"), F.inline(taps))
    return (
        spread.select(
            *keys,
            (F.col(order) + F.col("d")).alias(order),
            (F.col("_b") * F.col("w")).alias("_x"),
            (F.col("d") == 0).alias("_on"),
        )
        .groupBy(*keys, order)
        .agg(F.sum("_x").alias("_sum"), F.max("_on").alias("_on"))
        .where("_on")
        .select(*keys, order, F.least(F.greatest("_sum", F.lit(0.0)), F.lit(1.0)).alias("soft"))
    )
