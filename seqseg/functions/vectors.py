"""Expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not for every element of a lambda inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax(logits: Column) -> Column:
    """Log-probabilities, shifted by the maximum so that exp() cannot overflow."""

    def shifted(top: Column) -> Column:
        mass = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return _once(F.log(mass), lambda log_sum: F.transform(logits, lambda x: x - top - log_sum))

    return _once(F.array_max(logits), shifted)


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def log(value: Column) -> Column:
    """Natural logarithm of a double by IEEE rules, as in NumPy: -inf of zero, NaN below zero (Spark's own is null there)."""
    outside = F.when(value == 0, F.lit(float("-inf"))).when(value < 0, F.lit(float("nan")))
    return outside.otherwise(F.log(value))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def standardise(values: Column, mean: float, std: float) -> Column:
    return F.transform(values, lambda x: (x - F.lit(mean)) / F.lit(std))


def to_unit_range(values: Column) -> Column:
    """Byte range 0..255 to -1..1."""
    return F.transform(values, lambda x: x / F.lit(255.0) * F.lit(2.0) - F.lit(1.0))


def clip_scale(values: Column, bound: float) -> Column:
    """Clip to +-bound, then divide by bound."""
    return F.transform(
        values,
        lambda x: F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)) / F.lit(bound),
    )


def split_halves(values: Column, width: int) -> tuple[Column, Column]:
    """Two streams of ``width`` values stored one after the other."""
    return F.slice(values, 1, width), F.slice(values, width + 1, width)


def blend(a: Column, b: Column, alpha: Column) -> Column:
    """``alpha * a + (1 - alpha) * b``, element by element."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"), alpha.alias("w"))
    return F.transform(
        pairs, lambda p: p["w"] * p["a"] + (F.lit(1.0) - p["w"]) * p["b"]
    )


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))
