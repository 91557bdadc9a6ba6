"""Evaluation of predictions: errors, rank agreement, deciles, calibration, stability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions import order
from quarterdeck.functions.aggregates import guarded_corr
from quarterdeck.functions.dates import quarters_between
from quarterdeck.functions.scalars import is_finite, loss_magnitude
from quarterdeck.session import stored

PERIOD = "report_period"


def with_scores(
    frame: DataFrame, prediction: str = "prediction", keys: Sequence[str] = (PERIOD,)
) -> DataFrame:
    """Add the 0-100 score of a prediction within its period and the score's decile."""
    ranked = order.with_percentile_rank(frame, keys, prediction, "_fraction")
    return (
        ranked.withColumn("score", order.score(F.col("_fraction")))
        .withColumn("decile", order.score_decile(F.col("score")))
        .drop("_fraction")
    )


def grouped_spearman(
    frame: DataFrame, keys: Sequence[str], first: str, second: str, output: str = "spearman"
) -> DataFrame:
    """Rank correlation per group, null when either side is constant."""
    complete = frame.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    ranked = order.with_percentile_rank(complete.select(*keys, first, second), keys, first, "_ra")
    ranked = order.with_percentile_rank(ranked, keys, second, "_rb")
    corr = guarded_corr(F.col("_ra"), F.col("_rb")).alias(output)
    return ranked.groupBy(*keys).agg(corr) if keys else ranked.agg(corr)


def mean_spearman(
    frame: DataFrame, outer: Sequence[str], period: str, first: str, second: str,
    output: str = "mean_quarterly_spearman",
) -> DataFrame:
    """Average over periods of the period's rank correlation; constant periods are skipped."""
    per_period = grouped_spearman(frame, [*outer, period], first, second)
    average = F.avg("spearman").alias(output)
    return per_period.groupBy(*outer).agg(average) if outer else per_period.agg(average)


def error_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE and R2 as aggregates of one pass; R2 uses the identity for the total sum."""
    residual = actual - predicted
    squared = F.sum(residual * residual)
    total = F.count(actual) * F.var_pop(actual)
    return {
        "mae": F.avg(F.abs(residual)),
        "rmse": F.sqrt(F.avg(residual * residual)),
        "r2": F.lit(1.0) - squared / F.nullif(total, F.lit(0.0)),
    }


def performance(
    frame: DataFrame,
    actual: str = "target",
    prediction: str = "prediction",
    period: str = PERIOD,
    by: Sequence[str] = (),
) -> DataFrame:
    """Observations, quarters, errors and mean quarterly rank correlation, per ``by`` group."""
    by = list(by)
    frame = stored(frame)
    metrics = [c.alias(n) for n, c in error_metrics(F.col(actual), F.col(prediction)).items()]
    base_columns = [F.count(F.lit(1)).alias("observations"), F.count_distinct(period).alias("quarters"), *metrics]
    correlations = mean_spearman(frame, by, period, actual, prediction)
    if by:
        return frame.groupBy(*by).agg(*base_columns).join(correlations, by, "left")
    return frame.agg(*base_columns).select(
        "*", correlations.scalar().alias("mean_quarterly_spearman")
    )


def candidate_performance(
    scored: DataFrame, actual: str, prediction: str, actual_rank: str, candidate: str = "candidate", period: str = PERIOD
) -> DataFrame:
    """``performance`` per candidate, for candidates that predict the same rows, all of them known.

    ``actual_rank`` is the outcome's percentile rank within its period, taken once for all candidates.
    Both ranks average one half, so a period's rank correlation is a sum over different predictions:
    rows are combined by prediction where they are and never joined with their ranks.
    """
    scored = stored(scored)
    keys = [candidate, period]
    metrics = [c.alias(n) for n, c in error_metrics(F.col(actual), F.col(prediction)).items()]
    errors = scored.groupBy(candidate).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(period).alias("quarters"), *metrics)
    centred = F.col(actual_rank) - 0.5
    sums = scored.groupBy(*keys, prediction).agg(F.sum(centred).alias("_a"), F.sum(centred * centred).alias("_aa"))
    ranks = order.ranked_values(scored, keys, prediction)
    average = F.col("before") + (F.col("ties") - 1) / F.lit(2.0)
    other = F.when(F.col("total") == 1, F.lit(0.5)).otherwise(average / F.nullif(F.col("total") - 1, F.lit(0))) - 0.5
    joined = sums.join(ranks, [*keys, prediction]).withColumn("_b", other)
    spread = F.sqrt(F.sum("_aa") * F.sum(F.col("ties") * F.col("_b") * F.col("_b")))
    quarterly = joined.groupBy(*keys).agg((F.sum(F.col("_a") * F.col("_b")) / F.nullif(spread, F.lit(0.0))).alias("spearman"))
    means = quarterly.groupBy(candidate).agg(F.avg("spearman").alias("mean_quarterly_spearman"))
    return errors.join(means, candidate, "left")


def mean_forecast(fitting: DataFrame, frame: DataFrame, target: str = "target", output: str = "prediction") -> DataFrame:
    """Every row predicted by the fitting sample's mean (a one-value subquery)."""
    return frame.withColumn(output, fitting.agg(F.avg(target).alias("m")).scalar())


def decile_outcomes(
    frame: DataFrame,
    outcomes: Sequence[str],
    median_of: str | None = None,
    keys: Sequence[str] = (PERIOD,),
    bins: str = "decile",
) -> DataFrame:
    """Rows and mean outcomes per period and bin, with the median of one outcome."""
    group = [*keys, bins]
    frame = stored(frame) if median_of is not None else frame
    means = frame.groupBy(*group).agg(
        F.count(F.lit(1)).alias("stocks"), *[F.avg(o).alias(f"mean_{o}") for o in outcomes]
    )
    if median_of is None:
        return means
    medians = order.exact_quantiles(frame, group, median_of, {f"median_{median_of}": 0.5})
    return means.join(medians, group, "left")


def rank_summary(
    scored: DataFrame, actual: str = "target", score: str = "score", bins: str = "decile",
    keys: Sequence[str] = (PERIOD,),
) -> DataFrame:
    """Per period: stock-level and decile-level rank correlation, top minus bottom outcome."""
    keys = list(keys)
    scored = stored(scored)
    deciles = stored(scored.groupBy(*keys, bins).agg(F.count(F.lit(1)).alias("_n"), F.avg(actual).alias("_mean")))
    by_stock = grouped_spearman(scored, keys, score, actual, "stock_spearman")
    by_decile = grouped_spearman(deciles, keys, bins, "_mean", "decile_spearman")
    spread = deciles.groupBy(*keys).agg(
        F.sum("_n").alias("stocks"),
        (
            F.max(F.when(F.col(bins) == 10, F.col("_mean"))) - F.max(F.when(F.col(bins) == 1, F.col("_mean")))
        ).alias("top_minus_bottom"),
    )
    return spread.join(by_stock, keys, "left").join(by_decile, keys, "left")


def alternative_samples(
    sample: DataFrame, alternative: DataFrame, split_order: Sequence[str] = ("train", "validation", "test")
) -> DataFrame:
    """Samples for every alternative target, purged at the split boundaries.

    Two targets come from the sample's own window, the others from alternative horizons. A
    training or validation row whose window reaches the next split's first information date is
    dropped. The starts are one value per split, read by scalar subqueries.
    """
    sample = stored(sample)
    keys = ["report_period", "information_date", "permno"]
    own = sample.select(*keys, "sample_split", "target_window_end", F.inline(
        F.array(
            F.struct(F.lit("future_downside_volatility").alias("target"), F.col("future_downside_volatility").alias("target_value")),
            F.struct(
                F.lit("future_worst_five_day_loss").alias("target"),
                loss_magnitude(F.col("future_worst_rolling_return")).alias("target_value"),
            ),
        )
    )).withColumnRenamed("target_window_end", "robustness_window_end")
    other = (
        alternative.where("target_usable")
        .select(
            *keys,
            F.concat(F.lit("future_max_drawdown_"), F.col("horizon_market_days").cast("string"), F.lit("d")).alias("target"),
            F.col("future_max_drawdown").alias("target_value"),
            F.col("target_window_end").alias("robustness_window_end"),
        )
        .join(sample.select(*keys, "sample_split"), keys)
    )
    combined = own.unionByName(other)
    crossing = F.lit(False)
    for current, following in zip(split_order, split_order[1:], strict=False):
        start = (
            sample.where(F.col("sample_split") == following).agg(F.min("information_date").alias("d")).scalar()
        )
        crossing = crossing | ((F.col("sample_split") == current) & (F.col("robustness_window_end") >= start))
    return combined.where(~F.coalesce(crossing, F.lit(False)) & is_finite(F.col("target_value")))


def robustness_report(predicted: DataFrame, target: str = "target_name", actual: str = "target_value", prediction: str = "prediction") -> DataFrame:
    """Per target: errors, rank agreement at stock and decile level, mean spread."""
    keys = [target, PERIOD]
    predicted = stored(predicted)
    scored = with_scores(predicted, prediction, keys)
    quarterly = rank_summary(scored, actual, "score", "decile", keys)
    summary = quarterly.groupBy(target).agg(
        F.avg("stock_spearman").alias("mean_quarterly_spearman"),
        F.avg("decile_spearman").alias("mean_decile_spearman"),
        F.avg("top_minus_bottom").alias("mean_top_bottom_spread"),
    )
    errors = predicted.groupBy(target).agg(
        F.count(F.lit(1)).alias("test_observations"),
        F.count_distinct(PERIOD).alias("test_quarters"),
        *[c.alias(n) for n, c in error_metrics(F.col(actual), F.col(prediction)).items()],
    )
    return errors.join(summary, target)


def paired_comparison(frame: DataFrame, first: str, second: str, actual: str = "target") -> DataFrame:
    """Per period: error and rank-correlation differences of two predictions, their agreement."""
    ranked = frame
    for column in (first, second, actual):
        ranked = order.with_percentile_rank(ranked, [PERIOD], column, f"_rank_{column}")

    def corr(a: str, b: str) -> Column:
        return guarded_corr(F.col(f"_rank_{a}"), F.col(f"_rank_{b}"))

    return ranked.groupBy(PERIOD).agg(
        (F.avg(F.abs(F.col(actual) - F.col(second))) - F.avg(F.abs(F.col(actual) - F.col(first)))).alias("mae_difference"),
        (corr(second, actual) - corr(first, actual)).alias("spearman_difference"),
        corr(first, second).alias("prediction_agreement"),
    )


def increasing_decile_steps(deciles: DataFrame, value: str, keys: Sequence[str] = (PERIOD,), bins: str = "decile") -> DataFrame:
    """Number of steps from one decile to the next in which the outcome rises (ten rows a group)."""
    path = Window.partitionBy(*keys).orderBy(bins)
    steps = deciles.select(*keys, (F.col(value) > F.lag(value).over(path)).alias("_up"))
    return steps.groupBy(*keys).agg(F.count(F.when(F.col("_up"), F.lit(1))).alias("increasing_steps"))


def residual_diagnostics(scored: DataFrame, actual: str = "target", prediction: str = "prediction", realised_bin: str = "realised_decile") -> DataFrame:
    """Bias, errors in the extreme deciles, and lag-one residual correlation of stocks that
    were present in the previous quarter."""
    residual = F.col(prediction) - F.col(actual)
    history = Window.partitionBy("permno").orderBy(PERIOD)  # one row per period
    lagged = (
        scored.withColumn("_res", residual)
        .withColumns(
            {
                "_gap": quarters_between(F.lag(PERIOD).over(history), F.col(PERIOD)),
                "_last": F.lag("_res").over(history),
            }
        )
        .withColumn("_previous", F.when(F.col("_gap") == 1, F.col("_last")))
    )
    return lagged.agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("_res").alias("bias"),
        F.avg(F.when(F.col("decile") == 10, F.abs("_res"))).alias("mae_top_predicted_decile"),
        F.avg(F.when(F.col(realised_bin) == 10, F.abs("_res"))).alias("mae_top_realised_decile"),
        F.count("_previous").alias("consecutive_pairs"),
        guarded_corr(F.col("_res"), F.col("_previous")).alias("lag_one_correlation"),
    )


def with_equal_bins(frame: DataFrame, value: str, bins: int, output: str, keys: Sequence[str] = (PERIOD,), tie: str = "permno") -> DataFrame:
    """Add equal-count bins of a column within each group, ties settled by ``tie``."""
    ranked = order.with_first_rank(frame, keys, value, tie, "_first")
    return ranked.withColumn(
        output, order.equal_count_bin(F.col("_first"), F.col("group_rows"), bins)
    ).drop("_first", "group_rows")


def with_quantile_bins(frame: DataFrame, value: str, bins: int, output: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add bins bounded by interpolated quantiles; repeated edges collapse into one."""
    names = {f"_q{i}": i / bins for i in range(1, bins)}
    edges = order.exact_quantiles(frame, keys, value, names)
    inner = F.array_sort(F.array_distinct(F.array(*names)))
    if keys:
        joined = frame.join(edges.select(*keys, inner.alias("_edges")), list(keys))
    else:
        joined = frame.withColumn("_edges", edges.select(inner.alias("e")).scalar())
    lower = F.size(F.filter("_edges", lambda edge: F.col(value) > edge))
    return joined.withColumn(output, F.when(F.col(value).isNotNull(), lower + 1)).drop("_edges")


def calibration(frame: DataFrame, bin_column: str, actual: str = "target", prediction: str = "prediction") -> DataFrame:
    """Mean prediction, mean outcome, bias and MAE per bin."""
    return frame.groupBy(bin_column).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg(prediction).alias("mean_prediction"),
        F.avg(actual).alias("mean_actual"),
        F.avg(F.col(prediction) - F.col(actual)).alias("bias"),
        F.avg(F.abs(F.col(prediction) - F.col(actual))).alias("mae"),
    )


def binned_relationship(frame: DataFrame, feature: str, target: str = "target", bins: int = 10) -> DataFrame:
    """Mean target per within-quarter feature bin, averaged over quarters, with the spread."""
    known = frame.where(F.col(feature).isNotNull())
    binned = with_equal_bins(known, feature, bins, "bin")
    quarterly = binned.groupBy(PERIOD, "bin").agg(F.avg(target).alias("_m"))
    means = quarterly.groupBy("bin").agg(F.count(F.lit(1)).alias("quarters"), F.avg("_m").alias("mean_target"))
    everything = Window.partitionBy(F.lit(1))  # one row per bin
    high = F.max(F.when(F.col("bin") == bins, F.col("mean_target"))).over(everything)
    low = F.max(F.when(F.col("bin") == 1, F.col("mean_target"))).over(everything)
    return means.withColumn("top_minus_bottom", high - low)


def rank_correlations(frame: DataFrame, features: Sequence[str], row_id: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of every feature pair per group, in long form.

    Features are ranked together; all pairs are then aggregates of a single pass, so no row is
    ever joined with another. Pairs use the rows where both features are known; ranks are
    taken over each feature's known rows.
    """
    ranked = order.with_percentile_ranks(frame.select(*row_id, *features), list(keys), row_id, features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    structs = [
        F.struct(
            F.lit(a).alias("first_feature"), F.lit(b).alias("second_feature"),
            guarded_corr(F.col(f"{a}_rank"), F.col(f"{b}_rank")).alias("correlation"),
        )
        for a, b in pairs
    ]
    grouped = ranked.groupBy(*keys).agg(F.array(*structs).alias("_p")) if keys else ranked.agg(F.array(*structs).alias("_p"))
    return grouped.select(*keys, F.inline("_p"))


def temporal_stability(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Quarterly medians per feature summarised by minimum, maximum, first and last quarter."""
    medians = order.exact_quantiles_long(frame, [PERIOD], features, {"median": 0.5}, "feature")
    return medians.groupBy("feature").agg(
        F.count(F.lit(1)).alias("quarters"),
        F.min("median").alias("lowest_median"),
        F.max("median").alias("highest_median"),
        F.min_by("median", PERIOD).alias("first_median"),
        F.max_by("median", PERIOD).alias("last_median"),
    )


def graph_size_correlation(frame: DataFrame, sizes: DataFrame, features: Sequence[str], size: str = "size") -> DataFrame:
    """Rank correlation over quarters of each feature's median with the size of the quarter's graph.

    ``sizes`` has a row per period. Medians and sizes are one row per quarter and feature.
    """
    medians = order.exact_quantiles_long(frame, [PERIOD], features, {"median": 0.5}, "feature")
    joined = stored(medians.join(sizes.select(PERIOD, F.col(size).cast("double").alias("_size")), PERIOD))
    return grouped_spearman(joined, ["feature"], "median", "_size", "size_spearman")


def quarterly_bias(scored: DataFrame, actual: str = "target", prediction: str = "prediction") -> DataFrame:
    """Mean prediction, mean outcome, bias and MAE of every quarter."""
    residual = F.col(prediction) - F.col(actual)
    return scored.groupBy(PERIOD).agg(
        F.count(residual).alias("observations"), F.avg(prediction).alias("mean_prediction"), F.avg(actual).alias("mean_actual"),
        F.avg(residual).alias("bias"), F.avg(F.abs(residual)).alias("mae"),
    )


def share_rank_stability(shares: DataFrame) -> DataFrame:
    """Mean and smallest rank correlation of importance shares between all pairs of quarters.

    ``shares`` is the report-size result of ``quarterly_attribution_shares``.
    """
    shares = stored(shares)
    later = shares.select(F.col(PERIOD).alias("_later"), "feature", F.col("share_rank").alias("_rank"))
    pairs = shares.join(later, "feature").where(F.col(PERIOD) < F.col("_later")).groupBy(PERIOD, "_later").agg(
        guarded_corr(F.col("share_rank").cast("double"), F.col("_rank").cast("double")).alias("_c")
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("quarter_pairs"), F.avg("_c").alias("mean_rank_correlation"), F.min("_c").alias("lowest_rank_correlation")
    )


def quarterly_relative_error(frame: DataFrame, naive: Column | float, actual: str = "target", prediction: str = "prediction") -> DataFrame:
    """Quarterly MAE of a prediction against that of a constant forecast."""
    constant = naive if isinstance(naive, Column) else F.lit(naive)
    mae = F.avg(F.abs(F.col(actual) - F.col(prediction)))
    base = F.avg(F.abs(F.col(actual) - constant))
    return frame.groupBy(PERIOD).agg(
        mae.alias("mae"), base.alias("naive_mae"), (mae / F.nullif(base, F.lit(0.0))).alias("relative_mae")
    )


def generalization_gap(frame: DataFrame, actual: str = "target", prediction: str = "prediction") -> DataFrame:
    """MAE per model and split, side by side, with the validation-minus-train gap."""
    error = F.abs(F.col(actual) - F.col(prediction))
    splits = ("train", "validation", "test")
    return frame.groupBy("model").agg(
        *[F.avg(F.when(F.col("sample_split") == s, error)).alias(f"{s}_mae") for s in splits]
    ).withColumn("generalization_gap", F.col("validation_mae") - F.col("train_mae"))


def attribution_summary(contributions: DataFrame, values: Mapping[str, str], row_id: Sequence[str]) -> DataFrame:
    """Mean absolute contribution, its share, and direction, per feature.

    ``values`` maps a contribution column to its feature column; direction is the rank
    correlation between the two.
    """
    stats = contributions.agg(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), F.avg(F.abs(F.col(c))).alias("mean_absolute"))
                for c, f in values.items()
            ]
        ).alias("_s")
    ).select(F.inline("_s"))
    everything = Window.partitionBy(F.lit(1))  # one row per feature
    shares = stats.withColumn("share", F.col("mean_absolute") / F.sum("mean_absolute").over(everything))
    columns = [*values.keys(), *values.values()]
    ranked = order.with_percentile_ranks(contributions.select(*row_id, *columns), [], row_id, columns)
    direction = ranked.agg(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), guarded_corr(F.col(f"{c}_rank"), F.col(f"{f}_rank")).alias("direction"))
                for c, f in values.items()
            ]
        ).alias("_s")
    ).select(F.inline("_s"))
    return shares.join(direction, "feature")


def quarterly_attribution_shares(contributions: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Share of each feature in a quarter's mean absolute contributions, and its rank."""
    structs = [
        F.struct(F.lit(f).alias("feature"), F.avg(F.abs(F.col(c))).alias("mean_absolute")) for c, f in values.items()
    ]
    long = contributions.groupBy(PERIOD).agg(F.array(*structs).alias("_s")).select(PERIOD, F.inline("_s"))
    quarter = Window.partitionBy(PERIOD)  # one row per feature
    return long.select(
        PERIOD, "feature",
        (F.col("mean_absolute") / F.sum("mean_absolute").over(quarter)).alias("share"),
        F.row_number().over(quarter.orderBy(F.col("mean_absolute").desc(), "feature")).alias("share_rank"),
    )
