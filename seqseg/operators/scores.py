"""Loss formulas as statistics of score tables (no gradients).

``by`` chooses the averaging scope: nothing for one value over all rows, the stage,
or the episode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqseg.functions import vectors
from seqseg.operators.ordered import BUCKET_ROWS, FRAME, KEYS, neighbours


def _aggregate(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def _mean(total: Column, count: Column) -> Column:
    return F.coalesce(total, F.lit(0.0)) / F.greatest(count, F.lit(1))


def cross_entropy(
    scores: DataFrame, by: Sequence[str] = (), logits: str = "logits", label: str = "label", ignore: int = -100
) -> DataFrame:
    """Mean negative log-probability of the label; ignored labels do not count."""
    valid = scores.where(F.col(label) != ignore)
    picked = F.element_at(vectors.log_softmax(F.col(logits)), (F.col(label) + 1).cast("int"))
    return _aggregate(valid, by, F.avg(-picked).alias("ce"))


def _valid_pair(mask: str | None) -> Column:
    return F.lit(True) if mask is None else (F.col(mask) == 1) & (F.col("_m") == 1)


def _pairs(
    scores: DataFrame, value: Column, mask: str | None, keys, order: str, rows: int
) -> DataFrame:
    """Each frame with the value (and mask) of the frame before; first frames drop out."""
    columns = {"_before": lambda w: F.lag("_value").over(w)}
    if mask is not None:
        columns["_m"] = lambda w: F.lag(mask).over(w)
    paired = neighbours(
        scores.withColumn("_value", value), columns, before=1, keys=keys, order=order, rows=rows
    )
    return paired.where(F.col("_before").isNotNull()).where(_valid_pair(mask))


def smoothness(
    scores: DataFrame,
    tau: float = 4.0,
    by: Sequence[str] = (),
    logits: str = "logits",
    mask: str | None = None,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Truncated squared change of log-probabilities between consecutive frames."""
    paired = _pairs(scores, vectors.log_softmax(F.col(logits)), mask, keys, order, rows)
    squares = F.zip_with(
        "_value", "_before", lambda a, b: F.pow(F.least(F.abs(a - b), F.lit(tau)), F.lit(2.0))
    )
    return _aggregate(
        paired,
        by,
        _mean(F.sum(vectors.total(squares)), F.sum(F.size("_value"))).alias("tmse"),
    )


def _indices(pairs: Sequence[tuple[int, int]], place: int) -> Column:
    """One end of every pair, as one literal; places that a vector lacks fail the job."""
    text = ",".join(str(pair[place]) for pair in pairs)
    return F.split(F.lit(text), ",").cast("array<int>") if pairs else F.array().cast("array<int>")


def _mass(before: Column, after: Column, pairs: Sequence[tuple[int, int]], complement: bool) -> Column:
    """Joint probability of the pairs, or of all other pairs."""
    ends = F.arrays_zip(_indices(pairs, 0).alias("i"), _indices(pairs, 1).alias("j"))
    given = F.aggregate(
        ends,
        F.lit(0.0),
        lambda total, e: total + F.element_at(before, e["i"] + 1) * F.element_at(after, e["j"] + 1),
    )
    if not complement:
        return given
    return F.greatest(vectors.total(before) * vectors.total(after) - given, F.lit(0.0))


def _sparse(
    forbidden: Sequence[Sequence[float]] | None, allowed: Sequence[tuple[int, int]] | None
) -> tuple[list[tuple[int, int]], bool]:
    """The shorter list of pairs, and whether it is the allowed ones."""
    if allowed is not None:
        return sorted({(int(i), int(j)) for i, j in allowed}), True
    if forbidden is None:
        raise ValueError("give the forbidden matrix or the allowed pairs")
    bad = [(i, j) for i, row in enumerate(forbidden) for j, f in enumerate(row) if f]
    good = [(i, j) for i, row in enumerate(forbidden) for j, f in enumerate(row) if not f]
    return (bad, False) if len(bad) <= len(good) else (good, True)


def forbidden_mass(
    scores: DataFrame,
    forbidden: Sequence[Sequence[float]] | None = None,
    by: Sequence[str] = (),
    logits: str = "logits",
    mask: str | None = None,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
    allowed: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Joint probability that consecutive frames make a forbidden transition.

    Given is the classes x classes 0/1 matrix ``forbidden`` or, for many classes, the list
    of ``allowed`` (from, to) pairs. The plan holds the shorter of both lists; the mass of
    the forbidden ones is all mass less the allowed.
    """
    paired = _pairs(scores, vectors.softmax(F.col(logits)), mask, keys, order, rows)
    reached = _mass(F.col("_before"), F.col("_value"), *_sparse(forbidden, allowed))
    return _aggregate(paired, by, _mean(F.sum(reached), F.count(F.lit(1))).alias("trans"))


def boundary_cross_entropy(
    scores: DataFrame,
    pos_weight: float | None = None,
    by: Sequence[str] = (),
    logit: str = "logit",
    target: str = "soft",
    mask: str | None = None,
) -> DataFrame:
    """Weighted binary cross-entropy on logits with soft targets, in the stable form."""
    z, y = F.col(logit), F.col(target)
    weight = F.lit(1.0 if pos_weight is None else float(pos_weight))
    log_part = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    loss = (F.lit(1.0) - y) * z + (F.lit(1.0) + (weight - 1) * y) * log_part
    rows = scores if mask is None else scores.where(F.col(mask) == 1)
    return _aggregate(rows, by, _mean(F.sum(loss), F.count(F.lit(1))).alias("bce"))


def boundary_smoothness(
    scores: DataFrame,
    tau: float = 4.0,
    by: Sequence[str] = (),
    logit: str = "logit",
    mask: str | None = None,
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Truncated squared change of the boundary probability.

    Pairs with a missing logit count too; only first frames have no pair. Probabilities
    differ by 1 at most, so a larger ``tau`` cuts nothing, and a change of NaN or null stays one.
    """
    value = F.struct(vectors.sigmoid(F.col(logit)).alias("p"))
    paired = _pairs(scores, value, mask, keys, order, rows)
    change = F.abs(F.col("_value.p") - F.col("_before.p"))
    if tau < 1:
        change = F.least(change, F.lit(tau))
    return _aggregate(paired, by, _mean(F.sum(F.pow(change, F.lit(2.0))), F.count(F.lit(1))).alias("smooth"))


def _summed(parts: Sequence[DataFrame], weights: dict[str, float], stage: str) -> DataFrame:
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, stage)
    loss = sum((F.lit(w) * F.col(name) for name, w in weights.items()), F.lit(0.0))
    return joined.agg(
        F.sum(loss).alias("loss"), *[F.sum(name).alias(name) for name in weights]
    )


def composite(
    scores: DataFrame,
    forbidden: Sequence[Sequence[float]],
    lam: float = 0.15,
    gam: float = 0.15,
    tau: float = 4.0,
    stage: str = "stage",
    mask: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Classification loss and its parts, summed over stages, in one pass over the scores."""
    staged = [*keys, stage]
    value = F.struct(vectors.log_softmax(F.col("logits")).alias("log"), vectors.softmax(F.col("logits")).alias("p"))
    columns = {"_before": lambda w: F.lag("_value").over(w)}
    if mask is not None:
        columns["_m"] = lambda w: F.lag(mask).over(w)
    rows = neighbours(scores.withColumn("_value", value), columns, before=1, keys=staged)
    picked = F.element_at("_value.log", (F.col("label") + 1).cast("int"))
    linked = F.col("_before").isNotNull() & _valid_pair(mask)
    squares = F.zip_with(
        "_value.log", "_before.log", lambda a, b: F.pow(F.least(F.abs(a - b), F.lit(tau)), F.lit(2.0))
    )
    reached = _mass(F.col("_before.p"), F.col("_value.p"), *_sparse(forbidden, None))
    parts = rows.groupBy(stage).agg(
        F.avg(F.when(F.col("label") != -100, -picked)).alias("ce"),
        _mean(F.sum(F.when(linked, vectors.total(squares))), F.sum(F.when(linked, F.size("_value.log")))).alias("tmse"),
        _mean(F.sum(F.when(linked, reached)), F.count(F.when(linked, 1))).alias("trans"),
    )
    return _summed([parts], {"ce": 1.0, "tmse": lam, "trans": gam}, stage)


def composite_boundary(
    scores: DataFrame,
    pos_weight: float = 10.0,
    lam_smooth: float = 0.15,
    tau: float = 4.0,
    stage: str = "stage",
    mask: str | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Boundary loss and its parts, summed over stages."""
    parts = [
        boundary_cross_entropy(scores, pos_weight, [stage], mask=mask),
        boundary_smoothness(scores, tau, [stage], mask=mask, keys=[*keys, stage]),
    ]
    return _summed(parts, {"bce": 1.0, "smooth": lam_smooth}, stage)


def gate_statistics(gates: DataFrame, alpha: str = "alpha", by: Sequence[str] = ()) -> DataFrame:
    """Mean, spread and number of fusion weights."""
    values = gates.select(*by, F.explode(alpha).alias("_a"))
    return _aggregate(
        values,
        by,
        F.avg("_a").alias("mean"),
        F.stddev_samp("_a").alias("std"),
        F.count(F.lit(1)).alias("n"),
    )


def gate_histogram(gates: DataFrame, bins: int = 10, alpha: str = "alpha") -> DataFrame:
    """Counts of fusion weights in equal bins of 0..1; 1 belongs to the last bin."""
    values = gates.select(F.explode(alpha).alias("_a"))
    place = F.least(F.width_bucket("_a", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)) - 1
    return values.groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
