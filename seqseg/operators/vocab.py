"""Label dictionaries: building, merging and applying them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqseg.functions.text import BACKGROUND, strip
from seqseg.operators.ordered import KEYS, rank_all

def union_vocab(names: DataFrame, column: str = "name") -> DataFrame:
    """One dictionary over all datasets: background is 0, the rest alphabetical from 1."""
    distinct = (
        names.select(F.col(column).alias("name"))
        .where(F.col(column).isNotNull() & (F.col(column) != BACKGROUND))
        .distinct()
    )
    ranked = rank_all(distinct, ["name"], "_position").select(
        "name", (F.col("_position") + 1).alias("action_text_id")
    )
    first = names.sparkSession.range(1).select(
        F.lit(BACKGROUND).alias("name"), F.lit(0).cast("long").alias("action_text_id")
    )
    return first.unionByName(ranked)


def union_of(datasets: Sequence[DataFrame]) -> DataFrame:
    """Stack dictionaries that may differ in optional columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), datasets)


def to_union_ids(
    frames: DataFrame, local: DataFrame, union: DataFrame, id_column: str = "action_text_id"
) -> DataFrame:
    """Local ids to union ids through the name; unknown ids or names become 0."""
    mapping = local.select(
        *[c for c in ("dataset",) if c in local.columns],
        F.col("action_text_id").alias(id_column),
        "name",
    ).join(union.select("name", F.col("action_text_id").alias("_union")), "name", "left")
    on = [c for c in ("dataset", id_column) if c in mapping.columns]
    return (
        frames.join(mapping.drop("name"), on, "left")
        .withColumn("union_id", F.coalesce("_union", F.lit(0).cast("long")))
        .drop("_union")
    )


def strict_ids(frames: DataFrame, vocab: DataFrame, label: str = "label") -> DataFrame:
    """Label names to ids. A name that the dictionary lacks fails the job."""
    named = vocab.select(F.col("name").alias(label), "action_text_id")
    checked = F.when(
        F.col("action_text_id").isNull(),
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))),
    ).otherwise(F.col("action_text_id"))
    return frames.join(named, label, "left").withColumn("action_text_id", checked)


def unknown_labels(frames: DataFrame, vocab: DataFrame, label: str = "label") -> DataFrame:
    """Labels that the dictionary lacks, with their frame counts."""
    return (
        frames.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .join(vocab.select(F.col("name").alias(label)), label, "left_anti")
    )


def first_seen(
    segments: DataFrame, text: str = "text", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Open dictionary of phrases in the order they first occur.

    The key is trimmed, lower-cased text; the display form is the first spelling.
    Empty text and ``background`` are id 0; segments without frames register nothing.
    Returns ``key, name, action_text_id``.
    """
    phrase = strip(F.coalesce(F.col(text), F.lit("")))
    seen = segments.where(F.col("end_frame") > F.col("start_frame")).select(
        F.lower(phrase).alias("key"),
        F.struct(*keys, "segment_index", phrase.alias("name")).alias("_first"),
    )
    firsts = (
        seen.where((F.col("key") != "") & (F.col("key") != BACKGROUND))
        .groupBy("key")
        .agg(F.min("_first").alias("_first"))
        .select("key", "_first.*")
    )
    ranked = rank_all(firsts, [*keys, "segment_index"], "_position")
    ranked = ranked.select("key", "name", (F.col("_position") + 1).alias("action_text_id"))
    first = segments.sparkSession.range(1).select(
        F.lit(BACKGROUND).alias("key"),
        F.lit(BACKGROUND).alias("name"),
        F.lit(0).cast("long").alias("action_text_id"),
    )
    return first.unionByName(ranked)


def apply_first_seen(
    segments: DataFrame, vocab: DataFrame, text: str = "text"
) -> DataFrame:
    """Attach open-dictionary ids to segments; unregistered text is background."""
    phrase = F.lower(strip(F.coalesce(F.col(text), F.lit(""))))
    ids = vocab.select(F.col("key").alias("_key"), "action_text_id")
    return (
        segments.withColumn("_key", phrase)
        .join(ids, "_key", "left")
        .withColumn("action_text_id", F.coalesce("action_text_id", F.lit(0).cast("long")))
        .drop("_key")
    )


def background_ids(vocab: DataFrame, name: str = BACKGROUND) -> DataFrame:
    """Ids of the background class: one row or none."""
    return vocab.where(F.col("name") == name).select("action_text_id")


def class_names(vocab: DataFrame, num_classes: Column | int) -> DataFrame:
    """Names ordered by id; a missing id is named by its number."""
    size = F.lit(num_classes) if isinstance(num_classes, int) else num_classes
    ids = (
        vocab.agg(F.max("action_text_id").alias("_top"))
        .select(F.explode(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1)).alias("action_text_id"))
    )
    names = vocab.select("action_text_id", F.col("name").alias("_name"))
    return ids.join(names, "action_text_id", "left").select(
        "action_text_id",
        F.coalesce("_name", F.col("action_text_id").cast("string")).alias("name"),
    )
