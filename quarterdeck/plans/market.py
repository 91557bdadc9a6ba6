"""Point-in-time market features and forward downside targets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions import order, paths
from quarterdeck.functions.aggregates import (
    annualized_deviation,
    compounded,
    count_where,
    downside_volatility,
)
from quarterdeck.operators.joins import calendar_windows, interval_join, market_calendar
from quarterdeck.session import stored

KEYS = ["report_period", "information_date", "permno"]


@dataclass(frozen=True)
class FeatureRules:
    """Window length and the observation counts a usable row needs."""

    window: int = 252
    minimum_quarter: int = 50
    minimum_year: int = 202


def prediction_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(*KEYS).distinct()


def feature_windows(predictions: DataFrame, market: DataFrame, window: int = 252) -> DataFrame:
    """Trailing window of market days that ends strictly before the information date."""
    return calendar_windows(
        predictions, market_calendar(market), "information_date", "backward", window,
        "feature_window_start", "feature_window_end", number="feature_window_end_index",
    )


def market_features(
    predictions: DataFrame,
    daily: DataFrame,
    market: DataFrame,
    rules: FeatureRules = FeatureRules(),
    trading: Column | None = None,
) -> DataFrame:
    """Trailing return, risk, liquidity and size measures per security and period.

    The daily rows of a window are paired by (security, month); running products, drawdowns and
    every trailing statistic then share one shuffle on (period, security), whose groups hold at
    most one window of days.
    """
    market = stored(market)
    calendar = market_calendar(market)
    windows = stored(feature_windows(stored(predictions), market, rules.window))
    tradable = daily.where(trading) if trading is not None else daily
    dated = (
        tradable.select("permno", "day", "price", "cap", "ret", "volume")
        .join(calendar, "day")
        .join(market.select("day", "market_return"), "day")
    )
    spans = windows.select(*KEYS, "feature_window_start", "feature_window_end", "feature_window_end_index")
    rows = interval_join(spans, dated, ["permno"], "feature_window_start", "feature_window_end", "day")

    window = Window.partitionBy(*KEYS).orderBy("day")
    rows = rows.withColumn("wealth", paths.wealth(F.col("ret"), window)).withColumn(
        "drawdown", paths.drawdown(F.col("wealth"), window)
    )
    ret = F.col("ret")

    def tail(days: int) -> Column:
        return F.col("market_day") > F.col("feature_window_end_index") - days

    def during(days: int, value: Column) -> Column:
        return F.when(tail(days), value)

    complete = ret.isNotNull() & F.col("market_return").isNotNull()
    features = rows.groupBy(*KEYS).agg(
        F.count(during(21, ret)).alias("return_observations_21d"),
        F.count(during(63, ret)).alias("return_observations_63d"),
        F.count(during(126, ret)).alias("return_observations_126d"),
        F.count(ret).alias("return_observations_252d"),
        count_where(complete).alias("beta_return_observations_252d"),
        F.max_by(F.col("price"), F.when(F.col("price").isNotNull(), F.col("day"))).alias("market_price"),
        F.max_by(F.col("cap"), F.when(F.col("cap").isNotNull(), F.col("day"))).alias("market_cap"),
        F.avg(during(63, F.abs("price") * F.col("volume"))).alias("average_daily_dollar_volume_63d"),
        compounded(during(21, ret)).alias("return_21d"),
        compounded(during(63, ret)).alias("return_63d"),
        compounded(during(126, ret)).alias("return_126d"),
        compounded(ret).alias("return_252d"),
        compounded(F.when(~tail(21), ret)).alias("momentum_252_21d"),
        annualized_deviation(during(63, ret)).alias("volatility_63d"),
        annualized_deviation(ret).alias("volatility_252d"),
        downside_volatility(ret, tail(63)).alias("downside_volatility_63d"),
        downside_volatility(ret).alias("downside_volatility_252d"),
        F.regr_slope("ret", "market_return").alias("market_beta_252d"),
        F.avg(during(63, (ret < 0).cast("double"))).alias("negative_return_share_63d"),
        (-F.min("drawdown")).alias("maximum_drawdown_252d"),
    )
    counts = [c for c in features.columns if "observations" in c]
    joined = windows.drop("feature_window_end_index").join(features, KEYS, "left")
    usable = (
        F.col("feature_window_start").isNotNull()
        & (F.col("return_observations_63d") >= rules.minimum_quarter)
        & (F.col("return_observations_252d") >= rules.minimum_year)
        & (F.col("beta_return_observations_252d") >= rules.minimum_year)
        & F.col("market_beta_252d").isNotNull()
        & (F.col("market_price") > 0)
        & (F.col("market_cap") > 0)
    )
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn(
        "market_feature_usable", F.coalesce(usable, F.lit(False))
    )


def market_feature_audit(features: DataFrame) -> DataFrame:
    """Coverage and missing values of the features per period."""
    keys = ["report_period", "information_date"]
    features = stored(features)
    counts = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("security_periods"),
        count_where(F.col("market_feature_usable")).alias("usable_security_periods"),
        F.avg(F.col("market_feature_usable").cast("double")).alias("usable_share"),
        count_where(F.col("market_cap").isNull()).alias("missing_market_cap"),
        count_where(F.col("market_beta_252d").isNull()).alias("missing_market_beta"),
        count_where(
            F.col("return_252d").isNull() | F.col("volatility_252d").isNull()
            | F.col("market_beta_252d").isNull() | F.col("maximum_drawdown_252d").isNull()
        ).alias("missing_primary_features"),
    )
    medians = order.exact_quantiles(
        features, keys, "return_observations_252d", {"median_return_observations_252d": 0.5}
    )
    return counts.join(medians, keys, "left")


def target_windows(
    predictions: DataFrame, calendar_source: DataFrame, horizons: Sequence[tuple[int, int]]
) -> DataFrame:
    """Forward windows that start strictly after the information date, one row per horizon."""
    specs = F.array(
        *[
            F.struct(F.lit(h).alias("horizon_market_days"), F.lit(m).alias("minimum_observations"))
            for h, m in horizons
        ]
    )
    asked = predictions.select(*KEYS, F.inline(specs))
    return calendar_windows(
        asked, market_calendar(calendar_source), "information_date", "forward",
        F.col("horizon_market_days"), "target_window_start", "target_window_end",
    ).drop("window_market_day")


def forward_targets(
    predictions: DataFrame,
    daily: DataFrame,
    horizons: Sequence[tuple[int, int]] = ((63, 50),),
    rolling: int = 5,
) -> DataFrame:
    """Realised downside over forward windows of market days, with the delisting rules.

    ``horizons`` holds (market days, minimum observations). A window is usable when it is
    complete, has a drawdown, and either enough returns or an observed delisting return; a
    delisting without a return makes it unusable. All horizons run in one pass.
    """
    keys = [*KEYS, "horizon_market_days"]
    daily = stored(daily)
    windows = stored(target_windows(stored(predictions), daily, horizons))
    returns = daily.select("permno", "day", "ret", "delisting_flag")
    rows = interval_join(
        windows.select(*keys, "target_window_start", "target_window_end"), returns, ["permno"],
        "target_window_start", "target_window_end", "day",
    )
    # Days without a return sit in their own window partition, so paths see returns only,
    # while delisting flags are still read from every row in the same grouping.
    present = F.col("ret").isNotNull()
    path = Window.partitionBy(*keys, "_present").orderBy("day")
    rows = (
        rows.withColumn("_present", present)
        .withColumn("wealth", paths.wealth(F.col("ret"), path))
        .withColumn("security_day", F.row_number().over(path))
        .withColumn("rolling_return", paths.rolling_return(F.col("ret"), path, rolling))
        .withColumn("drawdown", paths.drawdown(F.col("wealth"), path))
    )
    delisted = F.col("delisting_flag") == "Y"
    metrics = rows.groupBy(*keys).agg(
        F.count("ret").alias("return_observations"),
        F.bool_or(delisted).alias("delisted_in_window"),
        F.bool_or(delisted & present).alias("delisting_return_observed"),
        (-F.min(F.when(present, F.col("drawdown")))).alias("future_max_drawdown"),
        compounded(F.col("ret")).alias("future_cumulative_return"),
        F.sqrt(F.lit(252.0) * F.avg(F.when(present, F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0)))))
        .alias("future_downside_volatility"),
        F.min(F.when(present & (F.col("security_day") >= rolling), F.col("rolling_return")))
        .alias("future_worst_rolling_return"),
        F.min("ret").alias("future_worst_daily_return"),
    )
    no = F.lit(False)
    joined = windows.join(metrics, keys, "left").withColumns(
        {
            "return_observations": F.coalesce("return_observations", F.lit(0)),
            "delisted_in_window": F.coalesce("delisted_in_window", no),
            "delisting_return_observed": F.coalesce("delisting_return_observed", no),
            "target_window_complete": F.col("target_window_end").isNotNull(),
        }
    )
    observed = F.col("delisting_return_observed")
    usable = (
        F.col("target_window_complete")
        & (~F.col("delisted_in_window") | observed)
        & ((F.col("return_observations") >= F.col("minimum_observations")) | observed)
        & F.col("future_max_drawdown").isNotNull()
    )
    return joined.withColumn("target_usable", usable).drop("minimum_observations")


def target_audit(targets: DataFrame) -> DataFrame:
    """Completeness, usability, delistings and median drawdown per period."""
    keys = ["report_period", "information_date"]
    targets = stored(targets)
    counts = targets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("security_periods"),
        count_where(F.col("target_window_complete")).alias("complete_horizon_security_periods"),
        count_where(F.col("target_usable")).alias("usable_security_periods"),
        F.avg(F.col("target_usable").cast("double")).alias("usable_share"),
        count_where(F.col("delisted_in_window")).alias("delisting_events"),
        count_where(F.col("delisted_in_window") & ~F.col("delisting_return_observed"))
        .alias("missing_delisting_returns"),
    )
    observations = order.exact_quantiles(
        targets, keys, "return_observations", {"median_return_observations": 0.5}
    )
    drawdowns = order.exact_quantiles(
        targets.where("target_usable"), keys, "future_max_drawdown", {"median_future_max_drawdown": 0.5}
    )
    return counts.join(observations, keys, "left").join(drawdowns, keys, "left")


def target_availability(targets: DataFrame, splits: DataFrame) -> DataFrame:
    """Complete and usable shares by horizon and split."""
    joined = targets.join(splits.select("report_period", "permno", "sample_split"), ["report_period", "permno"])
    return joined.groupBy("horizon_market_days", "sample_split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("target_window_complete").cast("double")).alias("complete_share"),
        F.avg(F.col("target_usable").cast("double")).alias("usable_share"),
    )
