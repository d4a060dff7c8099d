"""Training-run logs: epoch means, best epochs, early stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqseg.operators.ordered import carry, rank_all
from seqseg.session import settle


def epoch_metrics(
    log: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run_id", "epoch")
) -> DataFrame:
    """Mean of each metric and the number of batches per epoch.

    ``metrics`` are named up front, so the pivot needs no extra job and aggregates
    before the exchange.
    """
    means = [F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return log.groupBy(*by).agg(*means, F.countDistinct("step").cast("double").alias("num_batches"))


def pick_metric(name: str, sources: Sequence[str] = ("val_metrics", "train_metrics", "metrics")) -> Column:
    """Value of a metric: validation first, then training, general, top level.

    Each source is a map column; the top level is a column of that name.
    """
    return F.coalesce(*[F.col(s)[name] for s in sources], F.col(name))


def _sign(mode: str) -> int:
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', got {mode!r}")
    return 1 if mode == "max" else -1


def top_epochs(
    epochs: DataFrame, score: str, k: int = 3, mode: str = "max", run: str = "run_id"
) -> DataFrame:
    """The ``k`` best scored epochs of each run; of equal scores the later one stays."""
    signed = F.col(score) * _sign(mode)
    window = Window.partitionBy(run).orderBy(signed.desc(), F.desc("epoch"))
    ranked = epochs.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= k)


def best_so_far(
    epochs: DataFrame, score: str, mode: str = "max", run: str = "run_id", rows: int = 65_536
) -> DataFrame:
    """Running best score and whether the epoch improved on all before it."""
    sign = _sign(mode)
    signed = F.col(score) * sign
    scored = carry(epochs, {"_best": ("max", signed)}, [run], "epoch", rows)
    improved = F.col(score).isNotNull() & (F.col("_best").isNull() | (signed > F.col("_best")))
    return (
        scored.withColumn("improved", improved)
        .withColumn("best", F.greatest("_best", signed) * sign)
        .drop("_best")
    )


def early_stop(
    epochs: DataFrame,
    score: str,
    patience: int = 5,
    mode: str = "max",
    min_delta: float = 0.0,
    run: str = "run_id",
    rows: int = 65_536,
) -> DataFrame:
    """Epoch at which each run stops, null if it never does.

    A run stops after ``patience`` scored epochs in a row without an improvement by
    more than ``min_delta``; epochs without a score do not count. With a positive
    ``min_delta`` an epoch can only improve if it beats *all* earlier ones, so the
    order-dependent step sees the record epochs alone. A run of any length is spread over
    tasks by position.
    """
    scored = best_so_far(epochs.where(F.col(score).isNotNull()), score, mode, run, rows)
    if min_delta > 0:
        scored = _accepted_only(settle(scored), score, min_delta, mode, run, rows)
    numbered = carry(scored, {"_seen": ("sum", F.lit(1).cast("long"))}, [run], "epoch", rows)
    last = F.when(F.col("improved"), F.col("_seen"))
    numbered = carry(numbered, {"_good": ("last", last)}, [run], "epoch", rows)
    waited = F.when(F.col("improved"), F.lit(0)).otherwise(F.col("_seen") - F.col("_good"))
    return numbered.groupBy(run).agg(F.min(F.when(waited >= patience, F.col("epoch"))).alias("stop_epoch"))


def _accepted_only(
    scored: DataFrame, score: str, min_delta: float, mode: str, run: str, rows: int
) -> DataFrame:
    """Narrow ``improved`` to epochs that beat the last accepted score by more than the margin."""
    records = scored.where("improved").select(run, "epoch", (F.col(score) * _sign(mode)).cast("double").alias("_s"))
    accepted = _accepted(settle(records), min_delta, run, rows).withColumn("_ok", F.lit(True))
    return scored.join(accepted, [run, "epoch"], "left").withColumn(
        "improved", F.coalesce("_ok", F.lit(False))
    ).drop("_ok")


def _accepted(records: DataFrame, min_delta: float, run: str, rows: int) -> DataFrame:
    """Epochs of the chain that starts at the first record and goes on to the next one above the margin.

    Records rise with their epoch, so the next epoch above ``score + min_delta`` is the
    nearest record above that value: both kinds of value are put in one falling order (a record
    equal to the value comes after it, as it does not beat the margin). The chain is
    followed by jumps that double in length, so a run with n accepted epochs takes log n joins.
    """
    wanted = records.select(run, "epoch", (F.col("_s") + F.lit(float(min_delta))).alias("_v"), F.lit(1).alias("_query"))
    points = records.select(run, "epoch", F.col("_s").alias("_v"), F.lit(0).alias("_query")).unionByName(wanted)
    placed = rank_all(points, [run, F.desc("_v"), F.desc("_query")], "_at")
    above = F.when(F.col("_query") == 0, F.col("epoch"))
    jumps = carry(placed, {"_next": ("last", above)}, [run], "_at", rows)
    jumps = settle(jumps.where("_query = 1 AND _next IS NOT NULL").select(run, "epoch", "_next"))
    reached = records.groupBy(run).agg(F.min("epoch").alias("epoch"))
    while not jumps.isEmpty():
        further = reached.join(jumps, [run, "epoch"]).select(run, F.col("_next").alias("epoch"))
        reached = settle(reached.unionByName(further))
        onward = jumps.select(run, F.col("epoch").alias("_next"), F.col("_next").alias("_far"))
        jumps = settle(jumps.join(onward, [run, "_next"]).select(run, "epoch", F.col("_far").alias("_next")))
    return reached
