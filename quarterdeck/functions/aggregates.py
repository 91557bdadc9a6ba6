"""Aggregate expressions with the conventions of the panel analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def distinct_where(condition: Column, *values: Column) -> Column:
    """Distinct values (or tuples) among the rows that meet the condition."""
    target = values[0] if len(values) == 1 else F.struct(*values)
    return F.count_distinct(F.when(condition, target))


def share_where(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def largest_row(attributes: Sequence[str], by: Column, tie: Column) -> list[Column]:
    """Attributes of the row with the largest ``by``, skipping rows where they are null.

    Equal values of ``by`` are settled by the smallest ``tie``.
    """
    return [
        F.min(F.when(F.col(name).isNotNull(), F.struct((-by).alias("o"), tie.alias("t"), F.col(name).alias("v"))))["v"].alias(name)
        for name in attributes
    ]


def compounded(returns: Column) -> Column:
    return F.product(F.lit(1.0) + returns) - 1.0


def downside_volatility(returns: Column, condition: Column | None = None) -> Column:
    """Annualised root mean square of the negative part; a null return counts as zero."""
    squared = F.pow(F.least(returns, F.lit(0.0)), F.lit(2.0))
    if condition is not None:
        squared = F.when(condition, squared)
    return F.sqrt(F.lit(float(TRADING_DAYS)) * F.avg(squared))


def annualized_deviation(returns: Column) -> Column:
    return F.stddev_samp(returns) * F.sqrt(F.lit(float(TRADING_DAYS)))


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; null below three values or without variation."""
    n = F.count(value).cast("double")
    flat = F.stddev_pop(value) == 0
    return F.when((n > 2) & ~flat, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def guarded_corr(first: Column, second: Column) -> Column:
    """Pearson correlation over complete pairs, null when either side is constant."""
    complete = first.isNotNull() & second.isNotNull()
    a = F.when(complete, first.cast("double"))
    b = F.when(complete, second.cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    # The paired columns are blanked for constant groups by the outer test; nullif keeps the
    # correlation itself from dividing by zero under ANSI rules.
    n = F.count(a).cast("double")
    covariance = F.covar_pop(a, b)
    deviation = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(varies & (n > 1), covariance / F.nullif(deviation, F.lit(0.0)))


def herfindahl(shares: Column) -> Column:
    return F.sum(F.pow(shares, F.lit(2.0)))
