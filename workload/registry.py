"""Registry that keeps each query next to its independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.recipes import compose_sql

ROUND_DIGITS = 6


@dataclass(frozen=True)
class Case:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(
    name: str, sql: str | None = None, *, uses: str = "", doubles: str = "", digits: int = ROUND_DIGITS
):
    """Register a query. ``uses`` names shared CTEs, ``doubles`` the columns rounded on both sides."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in CASES:
            raise ValueError(f"Duplicate query name: {name}")
        rounded = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frame = build(spark, sf_dir)
            if not rounded:
                return frame
            # Adding zero turns a negative zero into zero on both engines.
            return frame.withColumns(
                {c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in rounded}
            )

        run.__name__ = name
        run.__doc__ = build.__doc__
        text = None
        if sql is not None:
            text = sql.strip()
            if rounded:
                replaced = ", ".join(
                    f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0.0 AS DOUBLE) AS {c}"
                    for c in rounded
                )
                text = f"SELECT * REPLACE ({replaced}) FROM (\n{text}\n)"
            text = compose_sql(text, uses.split())
        CASES[name] = Case(name, run, text)
        return build

    return register
