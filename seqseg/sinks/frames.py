"""Relabelled frame tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqseg.operators.ordered import BUCKET_ROWS, FRAME, KEYS, bucket_of, with_length


def relabel(
    frames: DataFrame,
    predicted: DataFrame,
    column: str = "action_text_id",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Replace (or add) the label column; all other columns are kept.

    Short predictions are padded with their last value, or 0 if there is none; long
    ones are cut.
    """
    found = predicted.select(*keys, order, F.col(column).cast("long").alias("_new"))
    joined = frames.drop(column).join(found, [*keys, order], "left")
    newest = F.max(F.when(F.col("_new").isNotNull(), F.struct(F.col(order), F.col("_new"))))
    filled = with_length(joined.drop("length"), None, keys, order, rows, {"_last": newest})
    value = F.coalesce("_new", F.col("_last._new"), F.lit(0).cast("long"))
    return filled.withColumn(column, value).drop("_new", "_last", "length")


def write_frames(
    frames: DataFrame,
    path: str,
    chunk_size: int = 1000,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = 4_000_000,
    mode: str = "errorifexists",
) -> None:
    """Write frames as zstd Parquet below ``chunk=.../episode=...``.

    Rows are spread by episode and range of positions, so a huge episode becomes
    several files instead of one writer; each file is in frame order.
    """
    episode = F.col("episode_index")
    spread = (
        frames.withColumn("chunk", F.floor(episode / F.lit(chunk_size)).cast("long"))
        .withColumn("episode", episode)
        .withColumn("_range", bucket_of(F.col(order), rows))
        .repartition(*keys, "_range")
        .sortWithinPartitions(*keys, order)
        .drop("_range")
    )
    writer = spread.write.mode(mode).option("compression", "zstd")
    writer.partitionBy("chunk", "episode").parquet(path)
