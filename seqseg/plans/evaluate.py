"""Evaluate class scores against labels over a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from seqseg.operators.metrics import argmax_labels, drop_padding, segmentation_report
from seqseg.operators.ordered import KEYS


def evaluate_scores(
    scores: DataFrame,
    overlaps: Sequence[int] = (10, 25, 50),
    background: Sequence[int] = (),
    members: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Report of ``logits`` against ``label``; padded rows (``mask`` 0) are left out.

    ``members`` restricts the evaluation to the episodes of a split.
    """
    if members is not None:
        scores = scores.join(members, list(keys), "left_semi")
    if "mask" in scores.columns:
        scores = drop_padding(scores)
    return segmentation_report(
        argmax_labels(scores), "pred", "label", overlaps, background, keys=keys
    )
