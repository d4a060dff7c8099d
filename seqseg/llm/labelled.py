"""Bounded samples of labelled documents for training, and folds by checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """Fold of a document: the checksum of its id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int, max_bytes: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[str, int]]:
    """At most ``limit`` (text, label) pairs of each class 0 and 1, among rows that ``allowed`` admits.

    The labels with the smallest id hash are drawn first, so the draw does not depend on row
    order; texts above ``max_bytes`` are passed over in training (they are scored like all
    others). Both bounds keep what reaches the driver small at any input size; the drawn
    labels (``2 * limit`` rows) are the broadcast side of the join.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        allowed & F.col("_y").isin(0, 1)
    )
    drawn = None
    for y in (0, 1):
        part = usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(limit)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .where(F.octet_length("_text") <= max_bytes)
        .join(F.broadcast(drawn), "_id")
        .select("_id", "_text", "_y")
        .collect()
    )
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2]))]
