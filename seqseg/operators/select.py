"""Choosing episodes: limits, splits, incremental work, several datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seqseg.operators.ordered import KEYS


def limit_per_dataset(
    episodes: DataFrame, n: int, dataset: str = "dataset", order: Sequence[str] = ("episode_index",)
) -> DataFrame:
    """First ``n`` episodes of each dataset; tasks keep at most ``n`` before the exchange."""
    window = Window.partitionBy(dataset).orderBy(*order)
    return (
        episodes.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
    )


def split_members(videos: DataFrame, splits: DataFrame, split: str, key: str = "video_id") -> DataFrame:
    """Videos listed in a split; ``val`` reads the ``test`` list."""
    wanted = "test" if split == "val" else split
    return videos.join(splits.where(F.col("split") == wanted).select(key), key, "left_semi")


def pending(episodes: DataFrame, manifest: DataFrame, keys: Sequence[str] = KEYS, overwrite: bool = False) -> DataFrame:
    """Episodes that are not in the manifest yet."""
    return episodes if overwrite else episodes.join(manifest, list(keys), "left_anti")


def extended_manifest(manifest: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Manifest after a run."""
    return manifest.select(*keys).unionByName(done.select(*keys)).distinct()


def broadcast_cameras(cameras: Sequence[str], n_inputs: int) -> list[str]:
    """One camera for all inputs, or one for each."""
    if len(cameras) == 1:
        return list(cameras) * n_inputs
    if len(cameras) != n_inputs:
        raise ValueError(f"need 1 or {n_inputs} cameras, got {len(cameras)}")
    return list(cameras)


def stack_datasets(datasets: Sequence[DataFrame], cameras: Sequence[str]) -> DataFrame:
    """Several datasets as one table with ``dataset_idx`` and ``camera``."""
    stacked = None
    for i, (df, camera) in enumerate(zip(datasets, broadcast_cameras(cameras, len(datasets)))):
        tagged = df.withColumn("dataset_idx", F.lit(i)).withColumn("camera", F.lit(camera))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("at least one dataset is required")
    return stacked
