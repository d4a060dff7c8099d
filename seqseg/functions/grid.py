"""Index maps between two time resolutions.

``j`` is the output position, ``k`` the number of outputs and ``n`` the number of
source frames. All maps are evaluated in DOUBLE with a fixed operation order, so
they give the same integers as evenly spaced sampling in NumPy.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _spaced(j: Column, n: Column, k: Column) -> Column:
    """Evenly spaced position of output ``j``; the last one is pinned to ``n - 1``."""
    step = (n - 1).cast("double") / F.greatest(k - 1, F.lit(1)).cast("double")
    return (
        F.when(k == 1, F.lit(0.0))
        .when(j == k - 1, (n - 1).cast("double"))
        .otherwise(j.cast("double") * step)
    )


def _clip(index: Column, n: Column) -> Column:
    return F.least(F.greatest(index, F.lit(0).cast("long")), (n - 1).cast("long"))


def nearest_index(j: Column, n: Column, k: Column) -> Column:
    """Evenly spaced, rounded half to even."""
    return _clip(F.bround(_spaced(j, n, k)).cast("long"), n)


def floor_index(j: Column, n: Column, k: Column) -> Column:
    """Evenly spaced, rounded down."""
    return _clip(F.floor(_spaced(j, n, k)).cast("long"), n)


def centre_index(j: Column, n: Column, k: Column) -> Column:
    """Source cell that holds the centre of output cell ``j``."""
    centre = (j.cast("double") + F.lit(0.5)) * (n.cast("double") / k.cast("double"))
    return _clip(F.floor(centre).cast("long"), n)


def index_span(i: Column, n: Column, k: Column) -> tuple[Column, Column]:
    """Outputs that *may* map to source frame ``i`` under any of the maps above.

    A superset, one or two positions too wide on each side; callers keep the
    positions whose exact map equals ``i``.
    """
    last = (k - 1).cast("long")
    step = (n - 1).cast("double") / F.greatest(k - 1, F.lit(1)).cast("double")
    step = F.least(step, n.cast("double") / k.cast("double"))
    low = F.when(step > 0, F.floor((i - 1).cast("double") / step).cast("long") - 1)
    wide = F.when(
        step > 0,
        F.ceil((i + 1).cast("double") / F.lit(1.0) / step).cast("long") + 1,
    )
    return (
        F.greatest(F.coalesce(low, F.lit(0)), F.lit(0).cast("long")),
        F.least(F.coalesce(wide, last), last),
    )
