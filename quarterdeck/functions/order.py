"""Exact ranks and quantiles whose work is split below the group.

A plain ``rank() OVER (PARTITION BY group)`` sorts each group in one task, and the exact
percentile aggregate keeps every distinct value of a group in one buffer. Quarters are few and
may be very uneven, so both would stop scaling. Here a group is cut into value bands of 1/256
octave; bands are counted with map-side combine, a running total over bands gives each band's
offset, and only the values inside one band are sorted together. Equal values are counted
before the sort, so a value shared by most rows is a single row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.session import cut_lineage, stored, stored_columns

_BANDS_PER_OCTAVE = 256
_OCTAVE_SHIFT = 1100  # below the exponent of the smallest positive double


def value_band(value: Column) -> Column:
    """Order-preserving integer band of a number (the logarithm is monotone)."""
    number = value.cast("double")
    size = F.floor((F.log2(F.abs(number)) + _OCTAVE_SHIFT) * _BANDS_PER_OCTAVE)
    return F.when(number == 0, F.lit(0)).when(number > 0, size).otherwise(-size).cast("int")


def ranked_values(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values per group with their counts and the rows before them.

    Columns: ``keys``, ``value``, ``ties`` (rows with the value), ``before`` (rows with a
    smaller value), ``total`` (rows with any value).
    """
    keys = list(keys)
    counted = (
        frame.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("ties"))
        .withColumn("band", value_band(F.col(value)))
    )
    # Read for the bands and for the ranks, but computed once.
    counted = cut_lineage(counted)
    bands = _with_offsets(counted.groupBy(*keys, "band").agg(F.sum("ties").alias("band_rows")), keys).drop("band_rows")
    return _ranked_inside(counted.join(bands, [*keys, "band"]), keys, value)


def _with_offsets(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Bands with the rows before them and those of their group."""
    # One row per band of a group: small by construction, whatever the group's size.
    per_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return bands.withColumn(
        "band_offset",
        F.sum("band_rows").over(per_group.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("band_rows"),
    ).withColumn("total", F.sum("band_rows").over(per_group))


def _ranked_inside(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values with their ties, sorted inside their band only."""
    inside = Window.partitionBy(*keys, "band").orderBy(value)
    return counted.withColumn(
        "before",
        F.col("band_offset")
        + F.sum("ties").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("ties"),
    ).select(*keys, value, "ties", "before", "total")


def with_percentile_rank(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    output: str = "percentile_rank",
    rank_output: str | None = None,
) -> DataFrame:
    """Add the average-tie percentile rank in [0, 1]; a lone value gets 0.5, nulls stay null."""
    return _percentile_rank(stored(frame), keys, value, output, rank_output)


def _percentile_rank(
    frame: DataFrame, keys: Sequence[str], value: str, output: str, rank_output: str | None
) -> DataFrame:
    ranks = ranked_values(frame, keys, value)
    average = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    fraction = F.when(F.col("total") == 1, F.lit(0.5)).otherwise(
        (average - 1.0) / F.nullif(F.col("total") - 1, F.lit(0))
    )
    added = [fraction.alias(output)]
    if rank_output:
        added.append(average.alias(rank_output))
    ranks = ranks.select(*keys, value, *added)
    return frame.join(ranks, [*keys, value], "left").select(
        *frame.columns, output, *([rank_output] if rank_output else [])
    )


def with_percentile_ranks(
    frame: DataFrame,
    keys: Sequence[str],
    row_id: Sequence[str],
    values: Sequence[str],
    suffix: str = "_rank",
    averages: bool = False,
) -> DataFrame:
    """Percentile (or average) ranks of several columns at once, one row per ``row_id``.

    ``row_id`` must contain the keys. All columns are ranked in long form, so the number of
    shuffles does not grow with the number of columns.
    """
    row_id = list(row_id)
    frame = stored(frame)
    long = frame.select(
        *row_id, *[F.col(name).cast("double").alias(name) for name in values]
    ).unpivot(row_id, list(values), "measure", "measured")
    ranked = _percentile_rank(
        long.where(F.col("measured").isNotNull()),
        [*keys, "measure"],
        "measured",
        "fraction",
        "average",
    )
    picked = "average" if averages else "fraction"
    # Dealt before they are grouped: a row has one entry a column, so combining them after the join
    # would fill a task's memory with groups and save nothing.
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranked.select(*row_id, "measure", picked).repartition(partitions, *row_id)
    wide = dealt.groupBy(*row_id).agg(
        *[
            F.max(F.when(F.col("measure") == name, F.col(picked))).alias(f"{name}{suffix}")
            for name in values
        ]
    )
    return frame.join(wide, row_id, "left")


def with_first_rank(
    frame: DataFrame, keys: Sequence[str], value: str, tie: str, output: str = "first_rank"
) -> DataFrame:
    """Add a unique rank 1..n by value, equal values ordered by ``tie``, and ``group_rows``."""
    keys = list(keys)
    frame = stored(frame)
    by_value = ranked_values(frame, keys, value).select(
        *keys, value, F.col("before").alias("_smaller"), F.col("total").alias("group_rows")
    )
    by_tie = ranked_values(frame.where(F.col(value).isNotNull()), [*keys, value], tie).select(
        *keys, value, tie, F.col("before").alias("_earlier")
    )
    joined = frame.join(by_value, [*keys, value], "left").join(by_tie, [*keys, value, tie], "left")
    return joined.withColumn(output, F.col("_smaller") + F.col("_earlier") + 1).select(
        *frame.columns, output, "group_rows"
    )


def with_dense_index(
    frame: DataFrame, keys: Sequence[str], entity: str, output: str = "node_index"
) -> DataFrame:
    """Zero-based index of each entity inside its group, in entity order."""
    frame = stored(frame)
    distinct = frame.select(*keys, entity).distinct()
    index = ranked_values(distinct, keys, entity).select(
        *keys, entity, F.col("before").cast("int").alias(output)
    )
    return frame.join(index, [*keys, entity], "left").select(*frame.columns, output)


def exact_quantiles(
    frame: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``probabilities``.

    Bands are counted where the rows are; only rows of a band that holds a quantile are moved.
    """
    keys = list(keys)
    rows = stored_columns(frame, *keys, value).where(F.col(value).isNotNull()).withColumn("band", value_band(F.col(value)))
    bands = _with_offsets(rows.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("band_rows")), keys)
    last = (F.col("total") - 1).cast("double")
    holds = F.lit(False)
    for probability in probabilities.values():
        for edge in (F.floor(last * F.lit(float(probability))), F.ceil(last * F.lit(float(probability)))):
            holds |= (F.col("band_offset") <= edge) & (edge < F.col("band_offset") + F.col("band_rows"))
    wanted = cut_lineage(bands.where(holds).drop("band_rows"))
    counted = rows.join(wanted, [*keys, "band"]).groupBy(*keys, "band", "band_offset", "total", value).agg(
        F.count(F.lit(1)).alias("ties")
    )
    ranks = _ranked_inside(counted, keys, value)
    number = F.col(value).cast("double")

    def at(position: Column) -> Column:
        held = (F.col("before") <= position) & (position < F.col("before") + F.col("ties"))
        return F.max(F.when(held, number))

    columns = []
    for name, probability in probabilities.items():
        position = last * F.lit(float(probability))
        low, high = at(F.floor(position)), at(F.ceil(position))
        weight = F.max(position - F.floor(position))
        columns.append((low + (high - low) * weight).alias(name))
    if not keys:
        return ranks.agg(*columns)
    return ranks.groupBy(*keys).agg(*columns)


def exact_quantiles_long(
    frame: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probabilities: Mapping[str, float],
    measure: str = "measure",
) -> DataFrame:
    """Quantiles of several columns, one row per group and column name."""
    long = frame.select(
        *keys, *[F.col(name).cast("double").alias(name) for name in values]
    ).unpivot(list(keys), list(values), measure, "measured")
    return exact_quantiles(long, [*keys, measure], "measured", probabilities)


def score(fraction: Column) -> Column:
    """Percentile rank to a 0-100 score."""
    return fraction * 100.0


def score_decile(score_column: Column, bins: int = 10) -> Column:
    """Decile of a 0-100 score: equal score widths, the top score in the last bin."""
    width = 100.0 / bins
    return F.greatest(
        F.lit(1), F.least(F.floor(score_column / width) + 1, F.lit(bins))
    ).cast("int")


def equal_count_bin(rank: Column, rows: Column, bins: int) -> Column:
    """Bin 1..bins from a unique rank so that bins hold equally many rows."""
    edge = F.ceil(rank.cast("double") / rows * bins)
    return F.greatest(F.lit(1), F.least(edge, F.lit(bins))).cast("int")
