"""Numeric column expressions: probabilities from logits, fixed-decimal formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Softmax of an array column, with the maximum subtracted for stability."""
    m = F.array_max(logits)
    ex = F.transform(logits, lambda z: F.exp(z - m))
    total = F.aggregate(ex, F.lit(0.0), lambda a, z: a + z)
    return F.transform(ex, lambda z: z / total)


def positive_proba(logits: Column) -> Column:
    """Probability of class 1 from a logit array: the sigmoid of a single logit, else the
    softmax share of the second class; NULL for an empty array."""
    one = sigmoid(F.try_element_at(logits, F.lit(1)))
    many = F.try_element_at(softmax(logits), F.lit(2))
    return F.when(F.size(logits) == 1, one).when(F.size(logits) > 1, many)


def fixed_decimals(x: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals (no thousands separators)."""
    return F.format_string(f"%.{digits}f", x)
