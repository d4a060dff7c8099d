"""Segment corpus for supervised labelling: all datasets, filters, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqseg.functions.text import segment_id, strip
from seqseg.operators.ordered import KEYS
from seqseg.operators.runs import cap_segments, preferred_segments, usable_segments


def segment_corpus(
    given: DataFrame,
    derived: DataFrame,
    task_text: DataFrame,
    camera: str,
    cap: int | None = None,
    min_frames: int = 4,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per usable segment.

    Episodes without task text are dropped, then short segments, then empty and
    background labels; the optional cap keeps the first segments of each episode.
    """
    tasks = task_text.select(*keys, strip(F.col("task_text")).alias("task_text")).where(
        F.col("task_text") != ""
    )
    segments = usable_segments(preferred_segments(given, derived, keys), min_frames)
    if cap is not None:
        segments = cap_segments(segments, cap, keys)
    identity = segment_id(
        F.col("dataset"), F.col("episode_index"), F.lit(camera), F.col("start_frame"), F.col("end_frame")
    )
    return (
        segments.join(tasks, list(keys))
        .withColumn("camera", F.lit(camera))
        .withColumn("segment_id", identity)
        .withColumn("action_text_id", F.coalesce("action_text_id", F.lit(-1).cast("long")))
    )
