"""Task grammars: which label may follow which.

A grammar is a table ``(task, pos, name)``. Class tables are dimensions; the tables of all
and of forbidden pairs have classes x classes rows by definition, nothing else makes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seqseg.functions.text import BACKGROUND
from seqseg.operators.ordered import KEYS, neighbours


def edges(grammar: DataFrame) -> DataFrame:
    """Consecutive names of each task's sequence."""
    window = Window.partitionBy("task").orderBy("pos")
    return (
        grammar.select(F.col("name").alias("src"), F.lead("name").over(window).alias("dst"))
        .where(F.col("dst").isNotNull())
        .distinct()
    )


def missing_names(grammar: DataFrame, vocab: DataFrame, background: str = BACKGROUND) -> DataFrame:
    """Names of the grammar, and the background, that the dictionary lacks."""
    needed = grammar.select("name").union(
        grammar.select(F.lit(background).alias("name")).limit(1)
    )
    return needed.distinct().join(vocab.select("name"), "name", "left_anti").orderBy("name")


def all_pairs(vocab: DataFrame) -> DataFrame:
    """Every ordered pair of classes (also what holds when there is no grammar)."""
    whole = vocab.agg(F.array_sort(F.collect_set("name")).alias("_names"))
    return whole.select(F.explode("_names").alias("src"), "_names").select(
        "src", F.explode("_names").alias("dst")
    )


def allowed_pairs(grammar: DataFrame, vocab: DataFrame, background: str = BACKGROUND) -> DataFrame:
    """Self pairs of every class, grammar edges, and background to and from used classes."""
    used = grammar.select("name").distinct()
    itself = vocab.select(F.col("name").alias("src"), F.col("name").alias("dst"))
    leave = used.select(F.lit(background).alias("src"), F.col("name").alias("dst"))
    enter = used.select(F.col("name").alias("src"), F.lit(background).alias("dst"))
    return itself.unionByName(edges(grammar)).unionByName(leave).unionByName(enter).distinct()


def forbidden_pairs(allowed: DataFrame, vocab: DataFrame) -> DataFrame:
    return all_pairs(vocab).join(allowed, ["src", "dst"], "left_anti")


def pair_summary(allowed: DataFrame, vocab: DataFrame) -> DataFrame:
    """Number of classes, allowed and forbidden pairs, and the allowed share.

    Only allowed pairs are looked at: the others are all pairs less these.
    """
    names = vocab.select("name").distinct()
    known = allowed.select("src", "dst").distinct()
    for end in ("src", "dst"):
        known = known.join(names.withColumnRenamed("name", end), end, "left_semi")
    counts = names.select(F.lit(1).alias("_class"), F.lit(0).alias("_pair")).unionByName(
        known.select(F.lit(0).alias("_class"), F.lit(1).alias("_pair"))
    )
    n, good = F.coalesce(F.sum("_class"), F.lit(0).cast("long")), F.coalesce(F.sum("_pair"), F.lit(0).cast("long"))
    return counts.agg(
        n.alias("num_classes"),
        good.alias("n_allowed"),
        (n * n - good).alias("n_forbidden"),
        F.when(n > 0, good / (n * n)).alias("density"),
    )


def audit_transitions(
    segments: DataFrame, allowed: DataFrame, label: str = "label", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Observed label changes with their counts and whether the grammar allows them.

    ``segments`` are runs numbered by ``segment_index``.
    """
    followed = neighbours(
        segments.select(*keys, "segment_index", F.col(label).alias("src")),
        {"dst": lambda w: F.lead("src").over(w)},
        after=1,
        keys=keys,
        order="segment_index",
    ).where(F.col("dst").isNotNull())
    counts = followed.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(allowed.withColumn("_ok", F.lit(True)), ["src", "dst"], "left")
        .withColumn("allowed", F.coalesce("_ok", F.lit(False)))
        .drop("_ok")
    )
