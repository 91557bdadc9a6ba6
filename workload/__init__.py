"""Queries over the driver's tables, one or more per operator of the inventory."""

from workload import basics, composites, portfolios, records, statistics  # noqa: F401 - registers their queries
from workload.registry import CASES

__all__ = ["CASES"]
