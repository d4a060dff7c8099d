"""Checks that return violations as rows instead of stopping at the first bad record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqseg.operators.ordered import FRAME, KEYS


def contiguity_violations(
    rows: DataFrame, index: str = "frame_idx", position: str = "position", keys: Sequence[str] = KEYS
) -> DataFrame:
    """First place per episode where the stored index is not the row position."""
    found, expected = F.col(index), F.col(position)
    kind = F.when(found < expected, "out_of_order_or_duplicate").otherwise("missing")
    # The lower index names the problem: the repeated one, or the one left out.
    offending = F.least(found, expected)
    return (
        rows.where(~found.eqNullSafe(expected))
        .groupBy(*keys)
        .agg(
            F.min_by(
                F.struct(expected.alias("position"), found.alias("found"), kind.alias("kind"), offending.alias("offending")),
                position,
            ).alias("_v")
        )
        .select(*keys, "_v.*")
    )


def shape_violations(
    features: DataFrame, width: int, keys: Sequence[str] = KEYS, order: str = FRAME
) -> DataFrame:
    """Feature rows with a wrong width, unequal streams or a missing label."""
    rgb, flow = F.size("rgb"), F.size("flow")
    reason = (
        F.when(rgb != width, "rgb_width").when(flow != rgb, "flow_shape").when(F.col("label").isNull(), "label")
    )
    return (
        features.select(*keys, order, rgb.alias("rgb_size"), flow.alias("flow_size"), reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def align_streams(streams: Sequence[DataFrame], keys: Sequence[str] = KEYS, order: str = FRAME) -> DataFrame:
    """Cut dense streams of an episode to their common length."""
    first, *rest = streams
    for stream in rest:
        first = first.join(stream, [*keys, order])
    return first


def align_arrays(columns: Sequence[str]) -> list[Column]:
    """The same for arrays in one row."""
    shortest = F.least(*[F.size(c) for c in columns])
    return [F.slice(F.col(c), 1, shortest).alias(c) for c in columns]


def example_violations(records: DataFrame, key: Sequence[str], record: str = "record") -> DataFrame:
    """Examples (JSON text) that lack a field, have no frames or non-string texts."""
    parsed = F.try_parse_json(record)

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))

    frames = kind("frames")
    reason = F.when(parsed.isNull(), F.lit("not json"))
    for field in ("frames", "task_text", "subtask_text"):
        reason = reason.when(kind(field).isNull(), F.lit(f"missing {field}"))
    reason = reason.when(frames.isin("ARRAY<VOID>", "VOID"), F.lit("empty frames"))
    for field in ("task_text", "subtask_text"):
        reason = reason.when(kind(field) != "STRING", F.lit(f"{field} is not a string"))
    return records.select(*key, reason.alias("reason")).where(F.col("reason").isNotNull())


def skip_reasons(episodes: DataFrame, min_frames: int = 17, keys: Sequence[str] = KEYS) -> DataFrame:
    """Why an episode is not processed; null for those that are.

    Expects ``has_media``, ``has_frames``, ``has_labels`` and ``length``; an optional
    ``failed`` marks errors of a previous attempt.
    """
    failed = F.col("failed") if "failed" in episodes.columns else F.lit(False)
    reason = (
        F.when(~F.col("has_media"), "missing_media")
        .when(~F.col("has_frames"), "missing_frames")
        .when(~F.col("has_labels"), "unlabeled")
        .when(F.col("length") < min_frames, "too_short")
        .when(failed, "failed")
    )
    return episodes.withColumn("reason", reason)
