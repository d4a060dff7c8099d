"""Text lines with their position in the file, for files of any size.

A file is read in splits by many tasks. Lines of one split come in order, and the
split's offset is known, so positions come from a ranking over the offset instead of
reading each file whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqseg.functions.text import strip
from seqseg.operators.ordered import rank_rows

PLACE = ("_file", "_offset", "_seq")


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.element_at(F.split(F.url_decode(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def placed(df: DataFrame) -> DataFrame:
    """Add the place of each record of a text-like scan (must be applied to the scan)."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def numbered(lines: DataFrame, out: str = "frame_index") -> DataFrame:
    """Zero-based position of each line inside its file."""
    return rank_rows(lines, ["_file"], ["_offset", "_seq"], [F.col("_offset")], out)


def read_lines(spark: SparkSession, path: str | list[str], comments: bool = False) -> DataFrame:
    """Non-blank, trimmed lines; with ``comments``, lines that start with # are dropped."""
    lines = placed(spark.read.text(path)).withColumn("line", strip(F.col("value"))).drop("value")
    lines = lines.where(F.col("line") != "")
    return lines.where(~F.col("line").startswith("#")) if comments else lines


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder (contents are not read unless ``content`` is selected)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
