"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_id(text: Column) -> Column:
    return F.upper(F.trim(text))


def lenient_long(text: Column) -> Column:
    """Text to bigint, rounding fractions; null where the text is not a number."""
    # Whole numbers are read as such: a double holds 53 bits only.
    return F.coalesce(text.try_cast("bigint"), F.round(text.try_cast("double")).try_cast("bigint"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null instead of failing on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def percent_change(current: Column, previous: Column) -> Column:
    return ratio(F.lit(100.0) * (current - previous), previous)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Bound a value; a null stays null although least and greatest skip nulls."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def loss_magnitude(value: Column) -> Column:
    """Signed return to non-negative loss."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), -value))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality."""
    return ~left.eqNullSafe(right)


def band_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open band ``(edge[i-1], edge[i]]`` that holds ``value``."""
    if len(labels) != len(edges) + 1:
        raise ValueError("One more label than edges is needed.")
    chain = F.when(value <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1], strict=True):
        chain = chain.when(value <= edge, label)
    return F.when(value.isNotNull(), chain.otherwise(labels[-1]))


def label_with_number(prefix: str, number: Column, suffix: str) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"), F.lit(suffix))
