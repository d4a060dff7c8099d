"""Movement primitives from demonstrations: derivatives and per-basis regression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqseg.operators.ordered import BUCKET_ROWS, FRAME, KEYS, neighbours


def _gradient(value: str, window, order: str, length: Column, dt: Column) -> Column:
    """Central differences with one-sided ends."""
    before, after = F.lag(value).over(window), F.lead(value).over(window)
    here = F.col(value)
    return (
        F.when(F.col(order) == 0, (after - here) / dt)
        .when(F.col(order) == length - 1, (here - before) / dt)
        .otherwise((after - before) / (dt * 2))
    )


def derivatives(
    demos: DataFrame,
    value: str = "y",
    dt: str = "dt",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """First and second differences (``dy``, ``ddy``); needs ``length`` and ``dt``."""
    size, step = F.col("length"), F.col(dt)
    return neighbours(
        demos,
        {
            "dy": lambda w: _gradient(value, w, order, size, step),
            "ddy": lambda w: _gradient("dy", w, order, size, step),
        },
        before=2,
        after=2,
        keys=keys,
        order=order,
        rows=rows,
    )


def basis_functions(n_basis: int, alpha_x: float = 1.0) -> list[tuple[float, float]]:
    """Centre and width of each basis function in phase space."""
    spaced = [i / (n_basis - 1) if n_basis > 1 else 0.0 for i in range(n_basis)]
    centres = [math.exp(-alpha_x * t) for t in spaced]
    widths = [1.0 / ((b - a) ** 2 + 1e-8) for a, b in zip(centres, centres[1:])]
    return list(zip(centres, widths + widths[-1:]))


def forcing_weights(
    demos: DataFrame,
    n_basis: int = 10,
    alpha_z: float = 25.0,
    beta_z: float = 6.25,
    alpha_x: float = 1.0,
    value: str = "y",
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Locally weighted regression of the forcing term, one weight per basis function.

    ``demos`` has ``y, length, dt, y0, goal`` on each row. The phase has a closed form,
    so all sums of an episode come from one aggregation with map-side combine. A
    demonstration of fewer than three frames fails the job.
    """
    short = F.raise_error(F.lit("a demonstration needs at least 3 frames"))
    checked = demos.withColumn(value, F.when(F.col("length") >= 3, F.col(value)).otherwise(short))
    moved = derivatives(checked, value, "dt", keys, order, rows)
    phase = F.pow(F.greatest(F.lit(1.0) - F.lit(alpha_x) * F.col("dt"), F.lit(0.0)), F.col(order))
    target = F.col("ddy") - F.lit(alpha_z) * (
        F.lit(beta_z) * (F.col("goal") - F.col(value)) - F.col("dy")
    )
    ready = moved.select(
        *keys,
        "y0",
        "goal",
        phase.alias("_x"),
        (phase * (F.col("goal") - F.col("y0"))).alias("_s"),
        target.alias("_f"),
    )
    sums = []
    for i, (centre, width) in enumerate(basis_functions(n_basis, alpha_x)):
        psi = F.exp(F.lit(-width) * F.pow(F.col("_x") - F.lit(centre), F.lit(2.0)))
        sums.append(F.sum(F.col("_s") * psi * F.col("_f")).alias(f"_num{i}"))
        sums.append(F.sum(F.col("_s") * F.col("_s") * psi).alias(f"_den{i}"))
    fitted = ready.groupBy(*keys).agg(F.max("y0").alias("y0"), F.max("goal").alias("goal"), *sums)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("basis"),
                (F.col(f"_num{i}") / (F.col(f"_den{i}") + F.lit(1e-10))).alias("weight"),
            )
            for i in range(n_basis)
        ]
    )
    return fitted.select(*keys, "y0", "goal", F.inline(entries))


def first_demo_steps(demos: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Time step of each sub-task, from its first demonstration: 1 / (frames - 1)."""
    first = demos.groupBy(*by).agg(F.min_by("length", order).alias("_n"))
    return first.select(*by, (F.lit(1.0) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("dt"))


def primitive_library(weights: DataFrame, by: Sequence[str], demo: str) -> DataFrame:
    """Mean weights, start and goal, and the number of demonstrations per sub-task."""
    return weights.groupBy(*by, "basis").agg(
        F.avg("weight").alias("weight"),
        F.avg("y0").alias("y0"),
        F.avg("goal").alias("goal"),
        F.countDistinct(demo).alias("n_demos"),
    )
