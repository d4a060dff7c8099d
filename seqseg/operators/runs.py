"""Runs and segments: frame labels to segments and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqseg.operators.ordered import (
    BUCKET,
    BUCKET_ROWS,
    FRAME,
    KEYS,
    bucket_of,
    bucket_range,
    bucket_window,
    halo,
    link,
    link_head,
    placed_rows,
)

def runs(
    frames: DataFrame,
    label: str = "label",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
    edges: bool = False,
) -> DataFrame:
    """Run-length encode frame labels into half-open segments.

    Returns ``keys, segment_index, start_frame, end_frame, <label>, length`` where
    ``length`` is the number of frames of the episode. With ``edges`` the labels of
    the frames just before and after the run are returned as ``previous_<label>``
    and ``next_<label>``.
    """
    window = bucket_window(keys, order)
    present = placed_rows(frames.select(*keys, order, label), keys, order)
    spread = halo(present, before=1, order=order, rows=rows)
    marked = spread.withColumn("_previous", F.lag(label).over(window)).where("_own")
    is_start = (F.col(order) == 0) | ~F.col("_previous").eqNullSafe(F.col(label))
    # Only episodes that fill a bucket need rows of other buckets; for all others the
    # window over the bucket has seen the whole episode.
    last = F.max(order).over(Window.partitionBy(*keys, BUCKET))
    marked = marked.withColumn("_reach", (last + 1).cast("long"))
    marked = marked.withColumn("_long", (F.col(BUCKET) > 0) | (F.col("_reach") == rows))
    head = F.when(is_start, link_head(order, [label]))
    per_bucket = marked.where("_long").groupBy(*keys, BUCKET).agg(
        F.max("_reach").alias("_length"),
        F.count(head).alias("_n"),
        F.min_by(head, F.when(is_start, F.col(order))).alias("_head"),
    )
    starts = marked.where(is_start).drop("_own")
    linked = link(starts, keys, order, payload=[label], rows=rows, per_bucket=per_bucket)
    length = F.coalesce("_length", "_reach")
    out = linked.select(
        *keys,
        F.col("_index").alias("segment_index"),
        F.col(order).alias("start_frame"),
        F.coalesce(F.col("_next"), length).cast("long").alias("end_frame"),
        F.col(label),
        length.alias("length"),
        F.col("_previous").alias(f"previous_{label}"),
        F.col(f"_next_{label}").alias(f"next_{label}"),
    )
    return out if edges else out.drop(f"previous_{label}", f"next_{label}")


def runs_without(
    frames: DataFrame,
    background: DataFrame | Sequence,
    label: str = "label",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Runs with background classes removed *after* encoding.

    A background gap therefore splits equal labels into two segments.
    """
    found = runs(frames, label, keys, order, rows)
    if isinstance(background, DataFrame):
        return found.join(background.select(label).distinct(), label, "left_anti").select(
            *found.columns
        )
    values = list(background)
    return found.where(~F.col(label).isin(values)) if values else found


def segment_texts(
    segments: DataFrame, vocab: DataFrame, id_column: str = "action_text_id"
) -> DataFrame:
    """Attach ``english_action_text``; ids without a name become ``class_<id>``."""
    names = vocab.select(F.col("action_text_id").alias(id_column), F.col("name").alias("_name"))
    text = F.coalesce("_name", F.concat(F.lit("class_"), F.col(id_column).cast("string")))
    return (
        segments.join(names, id_column, "left")
        .withColumn("english_action_text", text)
        .drop("_name")
    )


def nested_segments(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Segments as one ``action_config`` array per episode, the format of the metadata file.

    The table of segments is the product to work with; this is its export, and an
    episode is one record of it however many segments it has.
    """
    entry = F.struct(
        F.col("start_frame").cast("long").alias("start_frame"),
        F.col("end_frame").cast("long").alias("end_frame"),
        F.col("english_action_text"),
        F.col("action_text_id").cast("long").alias("action_text_id"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("segment_index"), entry.alias("entry"))))
    return segments.groupBy(*keys).agg(F.transform(ordered, lambda s: s["entry"]).alias("action_config"))


def flatten_action_config(episodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per entry of a non-empty ``action_config``, numbered in array order."""
    return (
        episodes.where(F.size("action_config") > 0)
        .select(*keys, F.posexplode("action_config").alias("segment_index", "_s"))
        .select(*keys, F.col("segment_index").cast("long").alias("segment_index"), "_s.*")
    )


def preferred_segments(
    given: DataFrame, derived: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Given segments where an episode has any, else the derived ones."""
    have = given.select(*keys).distinct()
    rest = derived.join(have, list(keys), "left_anti")
    common = [c for c in given.columns if c in rest.columns]
    return given.select(*common).unionByName(rest.select(*common))


def expand_segments(
    segments: DataFrame,
    episodes: DataFrame,
    value: str = "action_text_id",
    default: Column | None = None,
    keys: Sequence[str] = KEYS,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Segments to dense frame labels.

    Gaps get ``default`` (0), ends are clipped to the episode, and where segments
    overlap the later one wins. Segments and the empty frame grid are cut into
    bucket-sized pieces *before* they are expanded, so the only exchange moves
    pieces, and frames appear already spread over tasks.
    """
    default = F.lit(0) if default is None else default
    pieces = _pieces(
        episodes.select(
            *keys,
            F.lit(0).cast("long").alias("_lo"),
            F.col("length").cast("long").alias("_hi"),
            F.lit(-1).cast("long").alias("_rank"),
            default.cast(segments.schema[value].dataType).alias(value),
        ).unionByName(
            segments.where(F.col("end_frame") > 0).select(
                *keys,
                F.greatest("start_frame", F.lit(0)).cast("long").alias("_lo"),
                F.col("end_frame").cast("long").alias("_hi"),
                F.col("segment_index").cast("long").alias("_rank"),
                F.col(value),
            )
        ),
        keys,
        rows,
    )
    frame = bucket_range(F.col(BUCKET), F.col("_lo"), F.col("_hi"), rows)
    return (
        pieces.withColumn(FRAME, F.explode(frame))
        .groupBy(*keys, BUCKET, FRAME)
        .agg(F.max_by(value, "_rank").alias(value), F.min("_rank").alias("_rank"))
        .where(F.col("_rank") == -1)
        .drop(BUCKET, "_rank")
    )


def _pieces(ranges: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    ranges = ranges.where(F.col("_hi") > F.col("_lo"))
    spanned = F.sequence(bucket_of(F.col("_lo"), rows), bucket_of(F.col("_hi") - 1, rows))
    return ranges.withColumn(BUCKET, F.explode(spanned)).repartition(*keys, BUCKET)


def align_texts(
    segments: DataFrame, texts: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One text per segment: missing ones become empty, extra ones are dropped."""
    found = texts.select(*keys, "segment_index", F.col("text").alias("_text"))
    return (
        segments.join(found, [*keys, "segment_index"], "left")
        .withColumn("text", F.coalesce("_text", F.lit("")))
        .drop("_text")
    )


def cap_segments(
    segments: DataFrame, cap: int, keys: Sequence[str] = KEYS, order: str = "segment_index"
) -> DataFrame:
    """Keep the first ``cap`` segments of every episode.

    Spark limits each group to ``cap`` rows before the exchange (WindowGroupLimit).
    """
    window = Window.partitionBy(*keys).orderBy(order)
    return (
        segments.withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= cap)
        .drop("_rn")
    )


def usable_segments(
    segments: DataFrame, min_frames: int = 4, background: str = "background"
) -> DataFrame:
    """Segment filters of the example corpus, applied to trimmed text."""
    from seqseg.functions.text import strip

    text = F.coalesce(strip(F.col("english_action_text")), F.lit(""))
    return (
        segments.withColumn("subtask_text", text)
        .where(F.col("end_frame") - F.col("start_frame") >= min_frames)
        .where((F.col("subtask_text") != "") & (F.col("subtask_text") != background))
    )
