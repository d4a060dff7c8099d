"""Boundary training rows: pending episodes, step labels, soft labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqseg.operators.ordered import KEYS, lengths
from seqseg.operators.resample import window_count
from seqseg.operators.select import pending
from seqseg.operators.transitions import soft_boundaries, step_boundaries
from seqseg.session import settle


def boundary_rows(
    frames: DataFrame,
    manifest: DataFrame | None = None,
    window: int = 16,
    stride: int = 8,
    sigma: float = 2.0,
    mode: str = "code",
    label: str = "action_text_id",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Binary and soft step labels of all episodes that are not in the manifest.

    Frames without a label (``label`` null) are left out before any other work.
    """
    todo = frames.where(F.col(label).isNotNull())
    if manifest is not None:
        todo = pending(todo, manifest, keys)
    steps = lengths(todo, keys).select(
        *keys, window_count(F.col("length"), window, stride, True).alias("t_feat")
    )
    hard = settle(step_boundaries(todo, steps, stride, mode, label, keys))
    return hard.join(soft_boundaries(hard, sigma, keys=keys), [*keys, "step"])
