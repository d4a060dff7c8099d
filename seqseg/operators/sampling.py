"""Frame sampling, padded batches, span masks and feature augmentation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqseg.operators.ordered import (
    BUCKET,
    BUCKET_ROWS,
    FRAME,
    KEYS,
    bucket_of,
    bucket_range,
    rank_all,
)


def _hash_unit(*parts: Column) -> Column:
    """Uniform value in (0, 1) from a hash: the same for every attempt of a task."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def binned_frames(
    segments: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``n`` frames per segment, one from each of ``n`` equal bins.

    Segments with at most ``n`` frames are sampled evenly with repeats, empty ones
    repeat their start. Adds ``slot``, the bin ``bin_start``/``bin_end`` and ``frame``.
    """
    start, end = F.col("start_frame").cast("long"), F.col("end_frame").cast("long")
    size, slot = end - start, F.col("slot")
    spaced = slot.cast("double") * ((size - 1).cast("double") / F.lit(float(max(n - 1, 1)))) + start
    even = F.when(slot == n - 1, end - 1).otherwise(F.bround(spaced).cast("long")) if n > 1 else start
    step = size.cast("double") / F.lit(float(n))

    def edge(i: Column) -> Column:
        return F.when(i == n, end).otherwise((i.cast("double") * step + start).cast("long"))

    low, high = edge(slot), edge(slot + 1)
    draw = F.pmod(
        F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], start, slot),
        F.greatest(high - low, F.lit(1)),
    )
    short = size <= n
    return (
        segments.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        .withColumn("bin_start", F.when(size <= 0, start).when(short, even).otherwise(low))
        .withColumn(
            "bin_end",
            F.when(size <= 0, start + 1).when(short, even + 1).otherwise(F.greatest(high, low + 1)),
        )
        .withColumn("frame", F.when(short, F.col("bin_start")).otherwise(low + draw))
    )


def centre_frames(segments: DataFrame, n: int) -> DataFrame:
    """``n`` frames per segment at the bin centres.

    The segment is clipped to the episode (column ``length``); an empty one becomes a
    single frame. Segments with fewer than ``n`` frames are sampled with repeats.
    """
    length = F.col("length").cast("long")
    lowest = F.greatest(F.col("start_frame"), F.lit(0)).cast("long")
    highest = F.least(F.col("end_frame"), length).cast("long")
    start = F.when(highest > lowest, lowest).otherwise(F.least(lowest, length - 1))
    end = F.when(highest > lowest, highest).otherwise(F.least(lowest, length - 1) + 1)
    sized = (
        segments.where(length > 0)
        .withColumn("_s", start)
        .withColumn("_e", end)
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    )
    span = (F.col("_e") - F.col("_s")).cast("double")
    slot = F.col("slot").cast("double")
    bin_width = span / F.lit(float(n))
    middle = F.floor(F.col("_s") + (slot * bin_width + bin_width / F.lit(2.0)))
    step = (span - 1) / F.lit(float(max(n - 1, 1)))
    even = F.when((F.col("slot") == n - 1) & F.lit(n > 1), span - 1 + F.col("_s")).otherwise(
        F.bround(slot * step + F.col("_s"))
    )
    frame = F.when(span >= n, middle).otherwise(even).cast("long")
    frame = F.least(F.greatest(frame, F.col("_s")), F.col("_e") - 1)
    return sized.withColumn("frame", frame).drop("_s", "_e")


def resolve_rows(
    samples: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS, order: str = FRAME
) -> DataFrame:
    """Sampled positions to frame rows; positions outside are clamped (column ``length``)."""
    clamped = F.greatest(F.least(F.col("frame"), F.col("length") - 1), F.lit(0)).cast("long")
    rows = frames.drop("length")
    return samples.withColumn(order, clamped).join(rows, [*keys, order])


def padded_batches(
    frames: DataFrame,
    episodes: DataFrame,
    batch_size: int,
    pads: dict[str, Column],
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Fixed-size batches of episodes, padded to the longest one of the batch.

    One row per batch slot and position: ``batch_id, slot, <keys>, <order>, values,
    mask, length``. ``pads`` gives the padding value of each value column. Frames and
    padding come as bucket pieces and meet in a union; a long episode is never one row.
    """
    ranked = rank_all(episodes.select(*keys, "length"), list(keys), "_rank")
    slots = ranked.select(
        *keys,
        "length",
        F.floor(F.col("_rank") / F.lit(batch_size)).cast("long").alias("batch_id"),
        F.pmod("_rank", F.lit(batch_size)).cast("long").alias("slot"),
    )
    longest = slots.groupBy("batch_id").agg(F.max("length").alias("_longest"))
    slots = slots.join(longest, "batch_id")
    spans = F.sequence(F.lit(0).cast("long"), bucket_of(F.col("_longest") - 1, rows))
    pieces = slots.where(F.col("_longest") > 0).withColumn(BUCKET, F.explode(spans))
    head = ["batch_id", "slot", *keys]
    real = (
        frames.withColumn(BUCKET, bucket_of(F.col(order), rows))
        .drop("length")
        .join(pieces.drop("_longest"), [*keys, BUCKET])
        .select(*head, order, *pads, F.lit(1).alias("mask"), "length")
    )
    tail = pieces.where(F.col("_longest") > F.greatest("length", F.col(BUCKET) * rows)).where(
        (F.col(BUCKET) + 1) * rows > F.col("length")
    )
    empty = tail.repartition(*keys, BUCKET).withColumn(
        order, F.explode(bucket_range(F.col(BUCKET), F.col("length"), F.col("_longest"), rows))
    )
    types = {f.name: f.dataType for f in frames.select(*pads).schema}
    fill = [value.cast(types[name]).alias(name) for name, value in pads.items()]
    return real.unionByName(empty.select(*head, order, *fill, F.lit(0).alias("mask"), "length"))


def supervised_spans(
    examples: DataFrame,
    batch_size: int,
    order: Sequence[str],
    ignore: int = -100,
    pad_token: int = 0,
    max_length: int | None = None,
) -> DataFrame:
    """Token arrays with the prompt masked out, padded to the batch maximum.

    Needs ``input_ids`` and ``prompt_len``. ``labels`` are ``ignore`` before the answer
    and on padding; ``prompt_len`` is capped at the sequence length.
    """
    if max_length:
        examples = examples.withColumn("input_ids", F.slice("input_ids", 1, max_length))
    sized = examples.withColumn("seq_len", F.size("input_ids")).withColumn(
        "prompt_len", F.least(F.col("prompt_len"), F.col("seq_len")).cast("int")
    )
    ranked = rank_all(sized, list(order), "_rank").withColumn(
        "batch_id", F.floor(F.col("_rank") / F.lit(batch_size)).cast("long")
    )
    longest = ranked.groupBy("batch_id").agg(F.max("seq_len").alias("_longest"))
    joined = ranked.drop("_rank").join(longest, "batch_id")
    token = joined.schema["input_ids"].dataType.elementType
    prompt = F.col("prompt_len")
    labels = F.transform(
        "input_ids", lambda x, i: F.when(i < prompt, F.lit(ignore).cast(token)).otherwise(x)
    )
    gap = F.col("_longest") - F.col("seq_len")

    def padded(values: Column, fill: Column) -> Column:
        return F.concat(values, F.array_repeat(fill, gap))

    return (
        joined.withColumn("labels", padded(labels, F.lit(ignore).cast(token)))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), F.col("seq_len")), F.array_repeat(F.lit(0), gap)),
        )
        .withColumn("input_ids", padded(F.col("input_ids"), F.lit(pad_token).cast(token)))
        .drop("_longest")
    )


def feature_dropout(
    frames: DataFrame,
    p_channel: float = 0.0,
    p_time: float = 0.0,
    seed: int = 0,
    streams: Sequence[str] = ("rgb", "flow"),
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
) -> DataFrame:
    """Zero whole channels of an episode (per stream) and whole frames (all streams)."""
    for p in (p_channel, p_time):
        if not 0.0 <= p < 1.0:
            raise ValueError(f"probabilities must be in [0, 1), got {p}")
    episode = [F.col(k) for k in keys]
    out = frames
    if p_time > 0:
        keep_frame = _hash_unit(F.lit(seed), F.lit("time"), *episode, F.col(order)) >= p_time
    for stream in streams:
        values = F.col(stream)
        if p_channel > 0:
            values = F.transform(values, _channel_mask(p_channel, seed, stream, episode))
        if p_time > 0:
            values = F.when(keep_frame, values).otherwise(F.transform(values, lambda x: x * 0))
        out = out.withColumn(stream, values)
    return out


def _channel_mask(p: float, seed: int, stream: str, episode: Sequence[Column]):
    def keep(x: Column, i: Column) -> Column:
        kept = _hash_unit(F.lit(seed), F.lit(stream), *episode, i) >= p
        return F.when(kept, x).otherwise(x * 0)

    return keep


def _add_normal(sigma: float, seed: int, stream: str, place: Sequence[Column]):
    def noisy(x: Column, i: Column) -> Column:
        u, v = (_hash_unit(F.lit(seed), F.lit(stream), F.lit(n), *place, i) for n in "uv")
        normal = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
        return x + F.lit(sigma) * normal

    return noisy


def gaussian_noise(
    frames: DataFrame,
    sigma: float = 0.01,
    seed: int = 0,
    streams: Sequence[str] = ("rgb", "flow"),
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
) -> DataFrame:
    """Add normal noise drawn from a hash of (seed, stream, episode, frame, element)."""
    if sigma < 0:
        raise ValueError(f"sigma must be non-negative, got {sigma}")
    if sigma == 0:
        return frames
    place = [F.col(k) for k in keys] + [F.col(order)]
    out = frames
    for stream in streams:
        out = out.withColumn(stream, F.transform(stream, _add_normal(sigma, seed, stream, place)))
    return out
