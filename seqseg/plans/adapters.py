"""Views that bring the driver tables into the episode model.

Positions are made by ``rank_rows``: a coarse, monotone time value spreads one huge
user or order over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqseg.functions import vectors
from seqseg.operators.ordered import FRAME, KEYS, rank_rows, time_hours

EPISODE = ("episode_index",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in time order."""
    events = table(spark, sf_dir, "events").select(
        F.lit("events").alias("dataset"),
        F.col("user_id").alias("episode_index"),
        "event_id",
        "ts",
        F.col("event_type").alias("label"),
        "value",
    )
    return rank_rows(
        events, KEYS, ["ts", "event_id"], [time_hours(events, "ts")], total="length"
    )


def ev_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of frames per user; needs no positions."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.lit("events").alias("dataset"), F.col("user_id").alias("episode_index"))
        .agg(F.count(F.lit(1)).alias("length"))
    )


def ev_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev_rows(spark, sf_dir).drop("event_id", "ts")


def ev_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probability per frame."""
    p = F.col("value") / (F.col("value") + F.lit(100.0))
    return ev_frames(spark, sf_dir).select(*KEYS, FRAME, p.alias("p"), "length")


def li_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order; label is the return flag.

    Line numbers repeat, so all columns take part in the order; rows that tie are equal.
    """
    items = table(spark, sf_dir, "lineitem")
    order = [
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ]
    ranked = rank_rows(items, ["l_orderkey"], order, [F.col("l_shipdate")])
    return ranked.select(
        F.lit("lineitem").alias("dataset"),
        F.col("l_orderkey").alias("episode_index"),
        FRAME,
        F.col("l_returnflag").alias("label"),
    )


def em_features(spark: SparkSession, sf_dir: str, stream_width: int = 32) -> DataFrame:
    """Vectors as two feature streams; 50 consecutive vectors form an episode."""
    values = vectors.as_doubles(F.col("embedding"))
    rgb, flow = vectors.split_halves(values, stream_width)
    return table(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("dataset"),
        F.floor(F.col("vec_id") / F.lit(50)).cast("long").alias("episode_index"),
        F.pmod("vec_id", F.lit(50)).cast("long").alias(FRAME),
        rgb.alias("rgb"),
        flow.alias("flow"),
        values.alias("embedding"),
        F.col("label").cast("long").alias("label"),
    )


def em_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score stages: the two halves of each vector."""
    base = em_features(spark, sf_dir)
    stages = F.array(
        *[
            F.struct(
                F.lit(s).alias("stage"),
                F.slice("embedding", 32 * s + 1, 32).alias("logits"),
            )
            for s in range(2)
        ]
    )
    return base.select(*KEYS, FRAME, "label", F.inline(stages))


def cv_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("dataset"),
        F.col("conv_id").alias("episode_index"),
        F.col("turn").cast("long").alias(FRAME),
        "role",
        "text",
    )
