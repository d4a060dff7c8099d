"""Change of time resolution: resampling, strides and sliding windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqseg.functions import grid
from seqseg.operators.ordered import (
    BUCKET_ROWS,
    FRAME,
    KEYS,
    neighbours,
    spine,
    with_length,
)

RULES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "nearest": grid.nearest_index,
    "floor": grid.floor_index,
    "centre": grid.centre_index,
}


def resample(
    frames: DataFrame,
    values: Sequence[str],
    target: Column,
    rule: str = "nearest",
    source: Column | None = None,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Stretch or shrink every episode to ``target`` positions.

    ``target`` and ``source`` (the present number of positions) are per-episode
    expressions; ``source`` defaults to the measured length, which is then available
    to ``target`` as column ``length``. Each source row produces the outputs that map
    to it, so there is no join between the two resolutions. ``keep`` lists
    per-episode columns to pass on.
    """
    index = RULES[rule]
    if source is None:
        frames = with_length(frames, keys=keys, order=order, rows=rows)
        source = F.col("length")
    sized = frames.select(
        *keys,
        F.col(order).alias("_i"),
        *values,
        *[c for c in keep if c not in keys],
        source.cast("long").alias("_n"),
        target.cast("long").alias("_k"),
    ).where(F.col("_k") > 0)
    low, high = grid.index_span(F.col("_i"), F.col("_n"), F.col("_k"))
    spread = sized.withColumn("_low", low).withColumn("_high", high)
    spread = spread.where(F.col("_high") >= F.col("_low")).withColumn(
        order, F.explode(F.sequence("_low", "_high"))
    )
    exact = index(F.col(order), F.col("_n"), F.col("_k"))
    return spread.where(exact == F.col("_i")).drop("_i", "_n", "_k", "_low", "_high")


def fill_missing_episodes(
    resampled: DataFrame,
    episodes: DataFrame,
    target: str,
    defaults: dict[str, Column],
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
) -> DataFrame:
    """Add default rows for episodes that have a target length but no frames at all."""
    absent = episodes.join(resampled.select(*keys).distinct(), list(keys), "left_anti")
    empty = spine(absent.select(*keys, target), target, keys, out=order)
    empty = empty.select(*keys, order, *[c.alias(n) for n, c in defaults.items()])
    return resampled.select(*keys, order, *defaults).unionByName(empty)


def stride_sample(
    frames: DataFrame,
    stride: int,
    jitter: int = 0,
    seed: int = 0,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every ``stride``-th frame from a per-episode offset in ``[0, jitter]``.

    The offset is a hash of seed and episode, capped at the last frame, so a rerun of
    a task gives the same rows. Positions are renumbered from zero.
    """
    if stride < 1 or jitter < 0:
        raise ValueError("stride must be >= 1 and jitter >= 0")
    position = F.col(order)
    if jitter == 0:
        offset: Column = F.lit(0).cast("long")
    else:
        frames = with_length(frames, keys=keys, order=order, rows=rows)
        largest = F.least(F.lit(jitter).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)))
        offset = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), largest + 1)
    return (
        frames.withColumn("_off", offset)
        .where((position >= F.col("_off")) & (F.pmod(position - F.col("_off"), F.lit(stride)) == 0))
        .withColumn(order, ((position - F.col("_off")) / stride).cast("long"))
        .drop("_off", "length")
    )


def window_count(length: Column, window: int, stride: int, both_streams: bool = False) -> Column:
    """Complete windows of an episode; a difference stream is one frame shorter."""
    usable = length - 1 if both_streams else length
    count = F.floor((usable - window) / F.lit(stride)).cast("long") + 1
    return F.when(usable >= window, count).otherwise(F.lit(0).cast("long"))


def sliding_windows(
    frames: DataFrame,
    aggregates: dict[str, Callable[[Column], Column]],
    window: int = 16,
    stride: int = 8,
    both_streams: bool = False,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
) -> DataFrame:
    """Aggregate complete windows; the incomplete tail is dropped.

    ``aggregates`` maps a name to a function of the condition "row belongs to the
    window". A window is complete when it has all its rows (plus the one after it
    when ``both_streams``), which needs no episode length and no join. Aggregation is
    partial before the exchange and keyed by window.
    """
    reach = window + 1 if both_streams else window
    position = F.col(order)
    first = F.greatest(F.ceil((position - (reach - 1)) / F.lit(stride)).cast("long"), F.lit(0).cast("long"))
    last = F.floor(position / F.lit(stride)).cast("long")
    spread = frames.withColumn("_first", first).withColumn("_last", last)
    spread = spread.where(F.col("_last") >= F.col("_first")).withColumn(
        "window_index", F.explode(F.sequence("_first", "_last"))
    )
    inside = position < F.col("window_index") * stride + window
    built = [fn(inside).alias(name) for name, fn in aggregates.items()]
    grouped = spread.groupBy(*keys, "window_index").agg(
        F.count(F.lit(1)).alias("_rows"), *built
    )
    return grouped.where(F.col("_rows") == reach).drop("_rows")


def padded_windows(
    frames: DataFrame,
    aggregates: dict[str, Callable[[Column], Column]],
    window: int = 16,
    stride: int = 8,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Windows where tail and short episodes are filled by repeating the last frame.

    ``aggregates`` maps a name to a function of the row weight in the window: 1, or
    for the last frame the number of times it is repeated.
    """
    sized = with_length(frames, keys=keys, order=order, rows=rows)
    position, length = F.col(order), F.col("length")
    count = F.ceil(F.greatest(length - window, F.lit(0)) / F.lit(stride)).cast("long") + 1
    is_last = position == length - 1
    first = F.greatest(F.ceil((position - (window - 1)) / F.lit(stride)).cast("long"), F.lit(0).cast("long"))
    last = F.when(is_last, count - 1).otherwise(
        F.least(F.floor(position / F.lit(stride)).cast("long"), count - 1)
    )
    spread = sized.withColumn("_first", first).withColumn("_last", last)
    spread = spread.where(F.col("_last") >= F.col("_first")).withColumn(
        "window_index", F.explode(F.sequence("_first", "_last"))
    )
    start = F.col("window_index") * stride
    repeats = start + window - F.greatest(start, position)
    weight = F.when(is_last, repeats).otherwise(F.lit(1)).cast("long")
    spread = spread.withColumn("_w", weight)
    built = [fn(F.col("_w")).alias(name) for name, fn in aggregates.items()]
    return spread.groupBy(*keys, "window_index").agg(*built)


def mean_vectors(
    vectors: DataFrame, values: str, by: Sequence[str], out: str = "values"
) -> DataFrame:
    """Element-wise mean of all vectors of a group, through (group, element) rows."""
    elements = vectors.select(*by, F.posexplode(values).alias("_d", "_x"))
    means = elements.groupBy(*by, "_d").agg(F.avg("_x").alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_d", "_x")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda p: p["_x"]).alias(out))


def frame_delta(
    frames: DataFrame,
    values: str,
    bound: float,
    out: str = "delta",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Difference to the next frame, clipped to +-bound and scaled to -1..1.

    The last frame of an episode has no successor and is dropped.
    """
    limit = F.lit(float(bound))
    moved = neighbours(
        frames, {"_next": lambda w: F.lead(values).over(w)}, after=1, keys=keys, order=order, rows=rows
    ).where(F.col("_next").isNotNull())
    step = F.zip_with(
        F.col("_next"),
        F.col(values),
        lambda b, a: F.least(F.greatest(b - a, -limit), limit) / limit,
    )
    return moved.withColumn(out, step).drop("_next")
