"""Per-frame annotations, label dictionaries and split lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqseg.functions.text import strip
from seqseg.sources.lines import PLACE, file_stem, files, numbered, placed, read_lines


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """One label per line: ``video_id, frame_index, subtask``."""
    return numbered(read_lines(spark, path)).select(
        file_stem(F.col("_file")).alias("video_id"), "frame_index", F.col("line").alias("subtask")
    )


def empty_annotations(spark: SparkSession, path: str, labels: DataFrame, pattern: str = "*.txt") -> DataFrame:
    """Annotation files without a single label."""
    found = files(spark, path, pattern).select(file_stem(F.col("path")).alias("video_id"))
    return found.join(labels.select("video_id").distinct(), "video_id", "left_anti")


def read_label_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CSV with header ``frame_idx,subtask``: (annotations, violations).

    A file is usable when it has no violation; the first one per file is returned with
    its reason. Frame numbers must be 0, 1, 2, ... in file order.
    """
    lines = placed(spark.read.text(path)).where(strip(F.col("value")) != "")
    cells = F.from_csv("value", F.lit("idx STRING, label STRING"), {"mode": "PERMISSIVE"})
    one_cell = ~F.regexp_replace("value", r'"[^"]*"', "").contains(",")
    trimmed = lines.select(
        *PLACE,
        strip(F.coalesce(cells["idx"], F.lit(""))).alias("idx"),
        strip(F.coalesce(cells["label"], F.lit(""))).alias("label"),
        one_cell.alias("_short"),
    ).where((F.col("idx") != "") | (F.col("label") != ""))
    rows = numbered(trimmed, "_line").withColumn("video_id", file_stem(F.col("_file")))
    expected = F.col("_line") - 1
    number = F.col("idx").try_cast("bigint")
    is_header = F.col("_line") == 0
    good_header = (F.lower("idx") == "frame_idx") & (F.lower("label") == "subtask")
    reason = (
        F.when(is_header & ~good_header, "bad header")
        .when(is_header, F.lit(None))
        .when(F.col("_short"), "expected at least 2 columns")
        .when(number.isNull(), "frame_idx is not an integer")
        .when(number < expected, "out of order or duplicate frame_idx")
        .when(number > expected, "missing frame_idx")
        .when(F.col("label") == "", "empty label")
    )
    checked = rows.withColumn("reason", reason).withColumn("frame_index", expected)
    violations = (
        checked.where(F.col("reason").isNotNull())
        .groupBy("video_id")
        .agg(F.min_by(F.struct("frame_index", "idx", "reason"), "_line").alias("_v"))
        .select("video_id", "_v.*")
    )
    annotations = checked.where(~is_header & F.col("reason").isNull()).select(
        "video_id", "frame_index", F.col("label").alias("subtask")
    )
    return annotations.join(violations, "video_id", "left_anti"), violations


def read_mapping(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines ``<int> <name>``: (dictionary, malformed lines). The last entry of a name wins."""
    lines = read_lines(spark, path, comments=True)
    parsed = lines.select(
        *PLACE,
        "line",
        F.regexp_extract("line", r"^(\S+)\s+(.+)$", 1).try_cast("bigint").alias("action_text_id"),
        F.regexp_extract("line", r"^(\S+)\s+(.+)$", 2).alias("name"),
    )
    bad = parsed.where(F.col("action_text_id").isNull() | (F.col("name") == "")).select("line")
    good = parsed.where(F.col("action_text_id").isNotNull() & (F.col("name") != ""))
    vocab = good.groupBy("name").agg(F.max_by("action_text_id", F.struct(*PLACE)).alias("action_text_id"))
    return vocab, bad


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """File names of a split: ``split, file_name, video_id`` (extension removed)."""
    return read_lines(spark, path, comments=True).select(
        F.lit(split).alias("split"), F.col("line").alias("file_name"), file_stem(F.col("line")).alias("video_id")
    )


def missing_labels_as(features: DataFrame, labels: DataFrame, missing_label: int = 0) -> DataFrame:
    """Feature frames of videos without any annotation get ``missing_label``.

    Annotated videos are cut to the shorter of features and labels.
    """
    annotated = labels.select("video_id").distinct()
    with_labels = features.join(labels, ["video_id", "frame_index"])
    without = features.join(annotated, "video_id", "left_anti").withColumn(
        "label", F.lit(missing_label).cast(labels.schema["label"].dataType)
    )
    return with_labels.unionByName(without)
