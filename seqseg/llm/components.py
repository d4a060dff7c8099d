"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqseg.session import settle


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Alternating star contraction: every node hangs its larger neighbours on its smallest
    neighbour, then its smaller ones, until only stars are left. The smallest neighbour is
    found by an aggregation with partial results, so a node with very many links needs no
    task of its own; the number of rounds grows with the logarithm of the graph's size.
    """
    edges = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        # Every edge now points from a smaller node (a) to a larger one (b).
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        nxt = settle(small.where("a <> b").distinct())
        # Stars: no node is both a centre and a leaf, and every leaf has one centre.
        inner = nxt.select("b").join(nxt.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not inner and not nxt.groupBy("b").count().where("count > 1").limit(1).count():
            edges = nxt
            break
        edges = nxt
    else:
        raise RuntimeError("components did not settle")
    centres = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(centres)
