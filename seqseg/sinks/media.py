"""Plan for media files of a written dataset.

Linking is an operation of the file system; the plan says what is to be done for
every camera of every processed episode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def link_plan(
    media: DataFrame, episodes: DataFrame, existing: DataFrame, same_file_system: bool = True
) -> DataFrame:
    """One row per file: ``hardlink``, ``symlink`` (other file system) or ``skipped`` (present)."""
    present = existing.select("path").distinct().withColumn("_there", F.lit(True))
    action = F.when(F.col("_there"), "skipped").otherwise("hardlink" if same_file_system else "symlink")
    return (
        media.join(episodes.select("dataset", "episode_index"), ["dataset", "episode_index"], "left_semi")
        .join(present, "path", "left")
        .withColumn("status", action)
        .drop("_there")
    )


def link_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
