"""Seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stratified_sample(frame: DataFrame, keys: Sequence[str], row_id: Sequence[str], rows: int, seed: int) -> DataFrame:
    """The same ``rows`` rows per group for the same seed: those with the smallest seeded hash.

    The rank filter is applied on the map side first, so a large group sends only candidates.
    """
    draw = Window.partitionBy(*keys).orderBy(F.xxhash64(*row_id, F.lit(seed)), *row_id)
    return frame.withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") <= rows).drop("_draw")
