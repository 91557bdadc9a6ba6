"""Wealth paths, drawdowns and rolling products as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_date_rows(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def wealth(returns: Column, window: WindowSpec) -> Column:
    """Growth of one unit invested before the first row."""
    return F.product(F.lit(1.0) + returns).over(to_date_rows(window))


def drawdown(wealth_path: Column, window: WindowSpec) -> Column:
    """Loss against the running peak, the peak being at least the starting unit."""
    peak = F.greatest(F.lit(1.0), F.max(wealth_path).over(to_date_rows(window)))
    return wealth_path / peak - 1.0


def rolling_return(returns: Column, window: WindowSpec, rows: int) -> Column:
    return F.product(F.lit(1.0) + returns).over(window.rowsBetween(-(rows - 1), 0)) - 1.0


def lagged_rolling_deviation(value: Column, window: WindowSpec, rows: int) -> Column:
    """Sample deviation of exactly ``rows`` earlier rows, excluding the current one."""
    span = window.rowsBetween(-rows, -1)
    return F.when(F.count(value).over(span) == rows, F.stddev_samp(value).over(span))
