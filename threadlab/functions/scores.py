"""Row-local score arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, and 0 where the denominator is 0."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def harmonic(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def softmax(scores: Column) -> Column:
    """Soft-max over an array, shifted by its maximum so that exp() cannot overflow."""
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(shifted, lambda e: e / total)


def first_argmax(scores: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(scores, F.array_max(scores))


def pick_label(labels: list[str] | Column, scores: Column) -> Column:
    """Label at the first maximum of an aligned score array."""
    names = labels if isinstance(labels, Column) else F.array(*[F.lit(name) for name in labels])
    return F.element_at(names, first_argmax(scores).cast("int"))
