"""Feature tables: gated blend of two streams, multi-lag context."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqseg.functions import vectors
from seqseg.operators.ordered import BUCKET_ROWS, FRAME, KEYS, neighbours


def fibonacci(n: int) -> list[int]:
    """1, 2, 3, 5, 8, ...: the lags of ``n`` layers."""
    lags: list[int] = []
    a, b = 1, 2
    while len(lags) < n:
        lags.append(a)
        a, b = b, a + b
    return lags


def receptive_field(layers: int, kernel: int = 3) -> int:
    """Frames that reach one output; the overlap to keep when long episodes are cut."""
    return 1 + (kernel - 1) * sum(fibonacci(layers))


def gate(frames: DataFrame, weights, bias, a: str = "rgb", b: str = "flow", out: str = "alpha") -> DataFrame:
    """Gate values ``sigmoid(W [a; b] + c)`` with given weights.

    A matrix product per row is the one step here that Spark has no expression for;
    it runs on Arrow batches.
    """
    matrix = np.asarray(weights, dtype=np.float64)
    offset = np.asarray(bias, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=object)
        both = np.hstack([np.stack(left.to_numpy()), np.stack(right.to_numpy())])
        z = both @ matrix.T + offset
        return pd.Series(list(1.0 / (1.0 + np.exp(-z))))

    return frames.withColumn(out, score(F.col(a), F.col(b)))


def blend(frames: DataFrame, a: str = "rgb", b: str = "flow", alpha: str = "alpha", out: str = "fused") -> DataFrame:
    """``alpha * a + (1 - alpha) * b``."""
    return frames.withColumn(out, vectors.blend(F.col(a), F.col(b), F.col(alpha)))


def lag_context(
    frames: DataFrame,
    value: str,
    layers: int,
    taps: Sequence[float] = (1.0, 1.0, 1.0),
    keys: Sequence[str] = KEYS,
    order: str = FRAME,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Values at +-F for each Fibonacci lag (zero outside) and their three-tap sums.

    Adds ``before_F``, ``after_F`` and ``mix_F``; all lags share one exchange.
    """
    lags = fibonacci(layers)
    columns = {}
    for lag in lags:
        columns[f"before_{lag}"] = lambda w, n=lag: F.lag(value, n, 0.0).over(w)
        columns[f"after_{lag}"] = lambda w, n=lag: F.lead(value, n, 0.0).over(w)
    reach = max(lags, default=0)
    out = neighbours(frames, columns, reach, reach, keys, order, rows)
    left, centre, right = (F.lit(float(t)) for t in taps)
    for lag in lags:
        mixed = left * F.col(f"before_{lag}") + centre * F.col(value) + right * F.col(f"after_{lag}")
        out = out.withColumn(f"mix_{lag}", mixed)
    return out
