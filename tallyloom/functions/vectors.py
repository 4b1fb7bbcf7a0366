"""Expressions over answer vectors: arrays of doubles in the order of the options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(v: Column) -> Column:
    """Place of the largest entry, the first one on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def total(v: Column) -> Column:
    """Sum of the entries."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def brier(pred: Column, target: Column) -> Column:
    """Sum of squared differences over the target's options; a missing prediction is 0."""
    return total(F.transform(target, lambda t, i: (F.coalesce(F.try_element_at(pred, (i + 1).cast("int")), F.lit(0.0)) - t) * (F.coalesce(F.try_element_at(pred, (i + 1).cast("int")), F.lit(0.0)) - t)))


def nll(pred: Column, target: Column) -> Column:
    """Cross entropy; predictions are held above 1e-12."""
    return -total(F.zip_with(pred, target, lambda p, t: F.when(t > 0, t * F.ln(F.greatest(p, F.lit(1e-12)))).otherwise(0.0)))


def confidence(pred: Column, qtype: Column) -> Column:
    """The larger probability for yes/no; the largest scaled from chance to 1 otherwise."""
    k, top = F.size(pred), F.array_max(pred)
    scaled = F.when(k == 1, 1.0).otherwise((top - 1.0 / k) / (1.0 - 1.0 / F.nullif(k, F.lit(1))))
    return F.when(qtype == "noul", top).otherwise(scaled)


def max_gap(a: Column, b: Column) -> Column:
    """Largest absolute difference of two vectors."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def expectation(v: Column) -> Column:
    """Mean place under the distribution."""
    return total(F.transform(v, lambda p, i: p * i))


def softmax(v: Column) -> Column:
    """Exponentials scaled to sum 1; the largest is subtracted first."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / total(e))


def kl(p: Column, q: Column) -> Column:
    """Divergence of q from p."""
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / F.greatest(b, F.lit(1e-12)))).otherwise(0.0)))


def reverse_levels(v: Column) -> Column:
    """Scores asked in reversed order, mapped back."""
    return F.reverse(v)
