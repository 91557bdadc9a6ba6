"""Grouped operators: totals, shares, labels, profiles, reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions import order
from quarterdeck.functions.aggregates import sample_skewness
from quarterdeck.session import cut_lineage, stored


def with_share_of_total(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    share: str = "share",
    total: str | None = None,
) -> DataFrame:
    """Add each row's share of its group's total.

    The total is a grouped sum joined back, not a window: the sum combines on the map side and
    the join's large side can be split, so a group holding most rows never sits in one task.
    """
    total_name = total or "_group_total"
    frame = stored(frame)
    # Stored, so that the planner sees its size and leaves the rows where they are if it is small.
    totals = cut_lineage(frame.groupBy(*keys).agg(F.sum(value).alias(total_name)))
    joined = frame.join(totals, list(keys)).withColumn(
        share, F.col(value).cast("double") / F.nullif(F.col(total_name), F.lit(0))
    )
    return joined if total else joined.drop(total_name)


def concentration(
    frame: DataFrame, keys: Sequence[str], share: str, prefix: str = ""
) -> DataFrame:
    """Herfindahl index and largest share per group."""
    return frame.groupBy(*keys).agg(
        F.sum(F.pow(F.col(share), F.lit(2.0))).alias(f"{prefix}hhi"),
        F.max(share).alias(f"{prefix}largest_share"),
    )


def top_share(
    frame: DataFrame, keys: Sequence[str], share: str, tie: str, count: int = 5, output: str = "top_share"
) -> DataFrame:
    """Sum of the ``count`` largest shares per group.

    The rank filter lets Spark keep only ``count`` rows per group on the map side.
    """
    ranked = Window.partitionBy(*keys).orderBy(F.col(share).desc(), F.col(tie))
    return (
        frame.select(*keys, share, tie)
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= count)
        .groupBy(*keys)
        .agg(F.sum(share).alias(output))
    )


def modal_labels(frame: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Most frequent label combination per key; ties by label text, nulls last."""
    counted = frame.groupBy(key, *labels).agg(F.count(F.lit(1)).alias("_rows"))
    order_key = [-F.col("_rows")]
    for label in labels:
        order_key += [F.col(label).isNull().alias(f"_{label}_missing"), F.col(label)]
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_key)]))
    picked = counted.groupBy(key).agg(best.alias("_best"))
    return picked.select(
        key, *[F.col(f"_best.o{2 + 2 * i}").alias(name) for i, name in enumerate(labels)]
    )


def staged_counts(
    frame: DataFrame,
    keys: Sequence[str],
    stages: Mapping[str, str],
    entity: str,
    value: str,
) -> DataFrame:
    """Rows, distinct entities and value passing each flag column, in one pass, in long form.

    ``stages`` maps a stage label to its boolean column, in order; the first stage is the base
    of the retention percentages. Counts are taken per (group, entity) first, so that the
    distinct count needs no expansion of the input.
    """
    flags = list(stages.values())
    per_entity = frame.groupBy(*keys, entity).agg(
        *[F.count(F.when(F.col(f), F.lit(1))).alias(f"{f}_rows") for f in flags],
        *[F.sum(F.when(F.col(f), F.col(value))).alias(f"{f}_value") for f in flags],
    )
    wide = per_entity.groupBy(*keys).agg(
        *[F.sum(f"{f}_rows").alias(f"{f}_rows") for f in flags],
        *[
            F.count(F.when((F.col(f"{f}_rows") > 0) & F.col(entity).isNotNull(), F.lit(1)))
            .alias(f"{f}_entities")
            for f in flags
        ],
        *[F.sum(f"{f}_value").alias(f"{f}_value") for f in flags],
    )
    records = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_order"),
                F.lit(label).alias("stage"),
                F.col(f"{flag}_rows").alias("rows"),
                F.col(f"{flag}_entities").alias("entities"),
                F.col(f"{flag}_value").alias("value"),
                F.col(f"{flags[0]}_rows").alias("base_rows"),
                F.col(f"{flags[0]}_entities").alias("base_entities"),
            )
            for i, (label, flag) in enumerate(stages.items(), start=1)
        ]
    )

    def percent(part: str, base: str) -> Column:
        return F.round(F.col(part) / F.nullif(F.col(base), F.lit(0)) * 100, 3)

    return wide.select(*keys, F.inline(records)).select(
        *keys,
        "stage_order",
        "stage",
        "rows",
        "entities",
        "value",
        percent("rows", "base_rows").alias("row_retention_percent"),
        percent("entities", "base_entities").alias("entity_retention_percent"),
    )


def with_stage_baselines(
    frame: DataFrame, keys: Sequence[str], stage_order: str, measures: Sequence[str]
) -> DataFrame:
    """Retention of each measure against the first stage of its group (few rows per group)."""
    group = Window.partitionBy(*keys)
    return frame.withColumns(
        {
            f"{m}_retention_percent": F.lit(100.0)
            * F.col(m)
            / F.nullif(F.max(F.when(F.col(stage_order) == 1, F.col(m))).over(group), F.lit(0))
            for m in measures
        }
    )


def numeric_profile(
    frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Count, missing share, distinct values, moments and percentiles per column and group."""
    keys = list(keys)
    long = frame.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, list(columns), "feature", "measured"
    )
    group = [*keys, "feature"]
    moments = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("measured").alias("observations"),
        F.avg(F.col("measured").isNull().cast("double")).alias("missing_share"),
        F.avg("measured").alias("mean"),
        F.stddev_samp("measured").alias("deviation"),
        F.min("measured").alias("minimum"),
        F.max("measured").alias("maximum"),
        sample_skewness(F.col("measured")).alias("skewness"),
    )
    # Distinct counts come from the value counts the quantiles need anyway.
    quantiles = order.exact_quantiles(
        long, group, "measured", {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}
    )
    distinct = (
        long.where(F.col("measured").isNotNull())
        .groupBy(*group, "measured")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("distinct_values"))
    )
    return moments.join(quantiles, group, "left").join(distinct, group, "left")


def missing_share_pivot(
    frame: DataFrame, columns: Sequence[str], by: str, values: Sequence[str]
) -> DataFrame:
    """Missing share of each column (rows) by category (columns) and overall."""
    categories = [(str(v), F.col(by) == v) for v in values]
    shares = []
    for name in columns:
        missing = F.col(name).isNull().cast("double")
        shares.append(
            F.struct(
                F.lit(name).alias("feature"),
                *[F.avg(F.when(test, missing)).alias(label) for label, test in categories],
                F.avg(missing).alias("all_rows"),
            )
        )
    return frame.agg(F.array(*shares).alias("records")).select(F.inline("records"))


def histogram(
    frame: DataFrame, value: str, bins: int, low: float, high: float, geometric: bool = False
) -> DataFrame:
    """Counts and weights per bin of equal (or equal-ratio) width; empty bins have zero rows."""
    x = F.col(value).cast("double")
    if geometric:
        if low <= 0:
            raise ValueError("Geometric bins need a positive lower edge.")
        position = (F.ln(x) - F.ln(F.lit(low))) / ((F.ln(F.lit(high)) - F.ln(F.lit(low))) / bins)
    else:
        position = (x - low) / ((high - low) / bins)
    inside = frame.where(x.between(low, high))
    binned = inside.select(
        F.least(F.floor(position), F.lit(bins - 1)).cast("int").alias("bin")
    )
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    every = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    everything = Window.partitionBy(F.lit(1))  # ``bins`` rows
    return every.join(counts, "bin", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long"))).withColumn(
        "weight", F.col("rows") / F.nullif(F.sum("rows").over(everything), F.lit(0))
    )


def mean_of_group_means(
    frame: DataFrame, outer: Sequence[str], inner: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Average within (outer, inner), then across inner groups."""
    first = frame.groupBy(*outer, *inner).agg(*[F.avg(v).alias(v) for v in values])
    return first.groupBy(*outer).agg(
        F.count(F.lit(1)).alias("groups"), *[F.avg(v).alias(f"mean_{v}") for v in values]
    )


def member_concentration(frame: DataFrame, key: str, member: str) -> DataFrame:
    """How many keys have one member, and the median and maximum number of members."""
    sizes = frame.groupBy(key, member).agg(F.lit(1).alias("_one")).groupBy(key).agg(
        F.count(F.lit(1)).alias("members")
    )
    medians = order.exact_quantiles(sizes, [], "members", {"median_members": 0.5})
    totals = sizes.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count(F.when(F.col("members") == 1, F.lit(1))).alias("single_member_keys"),
        F.max("members").alias("maximum_members"),
    )
    return totals.select("*", medians.scalar().alias("median_members"))


def weekly_returns(frame: DataFrame, keys: Sequence[str], day: str, returns: str) -> DataFrame:
    """Daily returns compounded into weeks that end on Friday."""
    from quarterdeck.functions.dates import week_ending_friday

    return frame.groupBy(*keys, week_ending_friday(F.col(day)).alias("week_end")).agg(
        (F.product(F.lit(1.0) + F.col(returns)) - 1.0).alias("week_return")
    )
