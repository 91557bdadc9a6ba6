"""Score portfolios: membership, paths, turnover, exposure, costs, performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions import paths
from quarterdeck.functions.aggregates import TRADING_DAYS
from quarterdeck.functions.paths import to_date_rows
from quarterdeck.operators.joins import asof_calendar, market_calendar

PERIOD = "report_period"

# Portfolio names with their decile ranges and weighting.
EVENT_PORTFOLIOS = (
    ("all_stocks", 1, 10),
    ("exclude_most_fragile_decile", 1, 9),
    ("least_fragile_decile", 1, 1),
    ("most_fragile_decile", 10, 10),
)
COST_BPS = (10, 25, 50)


def portfolio_definitions(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Definitions (strategy, minimum decile, maximum decile) as a table."""
    return spark.createDataFrame(list(rows), "strategy string, minimum_decile int, maximum_decile int")


def portfolio_members(signals: DataFrame, definitions: Sequence[tuple]) -> DataFrame:
    """One row per portfolio a stock belongs to; portfolios may overlap.

    The definitions are literals, so a row fans out to its own portfolios without a join.
    """
    named = F.array(
        *[
            F.struct(F.lit(n).alias("strategy"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for n, lo, hi in definitions
        ]
    )
    mine = F.filter(named, lambda p: F.col("decile").between(p["lo"], p["hi"]))
    return signals.withColumn("_p", F.explode(mine)).withColumn("strategy", F.col("_p.strategy")).drop("_p")


def formation_weights(members: DataFrame, weighting: str = "equal", cap: str = "market_cap") -> DataFrame:
    """Weights that sum to one per (strategy, period): equal or by market value."""
    size = F.lit(1.0) if weighting == "equal" else F.col(cap).cast("double")
    sized = members.withColumn("_size", size)
    totals = sized.groupBy("strategy", PERIOD).agg(F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("stocks"))
    return sized.join(totals, ["strategy", PERIOD]).withColumn(
        "weight", F.col("_size") / F.nullif(F.col("_total"), F.lit(0.0))
    ).drop("_size", "_total")


def dense_returns(members: DataFrame, calendar: DataFrame, daily: DataFrame) -> DataFrame:
    """A return for every member on every day of its period, zero where none was observed.

    ``calendar`` lists (date, period); it is matched on the period, then on (security, day).
    """
    distinct = members.select(PERIOD, "permno").distinct()
    grid = distinct.join(calendar.select(PERIOD, "day"), PERIOD)
    return grid.join(daily.select("permno", "day", "ret"), ["permno", "day"], "left").withColumn(
        "ret", F.coalesce("ret", F.lit(0.0))
    )


def security_paths(returns: DataFrame) -> DataFrame:
    """Growth of one unit per security within its period (one row per day of the period)."""
    window = Window.partitionBy(PERIOD, "permno").orderBy("day")
    return returns.withColumn("growth", paths.wealth(F.col("ret"), window))


def portfolio_paths(weights: DataFrame, grown: DataFrame) -> DataFrame:
    """Buy-and-hold wealth and daily return per (strategy, period, day).

    Members are summed per day with map-side combine; only the resulting daily series, whose
    length is the calendar's, is ordered.
    """
    wealth = (
        weights.select("strategy", PERIOD, "permno", "weight").join(grown, [PERIOD, "permno"])
        .groupBy("strategy", PERIOD, "day").agg(F.sum(F.col("weight") * F.col("growth")).alias("wealth"))
    )
    path = Window.partitionBy("strategy", PERIOD).orderBy("day")
    previous = F.coalesce(F.lag("wealth").over(path), F.lit(1.0))
    return wealth.withColumn("portfolio_return", F.col("wealth") / previous - 1.0)


def ending_weights(weights: DataFrame, grown: DataFrame) -> DataFrame:
    """Drifted weights of each portfolio on the last day of its period."""
    last = grown.groupBy(PERIOD, "permno").agg(F.max_by("growth", "day").alias("growth"))
    drifted = weights.join(last, [PERIOD, "permno"]).withColumn("_value", F.col("weight") * F.col("growth"))
    totals = drifted.groupBy("strategy", PERIOD).agg(F.sum("_value").alias("_total"))
    return drifted.join(totals, ["strategy", PERIOD]).select(
        "strategy", PERIOD, "permno", (F.col("_value") / F.col("_total")).alias("ending_weight")
    )


def one_way_turnover(weights: DataFrame, ending: DataFrame, periods: DataFrame) -> DataFrame:
    """Half the absolute change from drifted to new weights at each formation; the first is one.

    Both weight sets are stacked and summed per security with opposite signs, which is a full
    outer join done by one grouped sum.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(PERIOD)  # distinct periods only
    sequence = periods.select(PERIOD).distinct().withColumn("_next", F.lead(PERIOD).over(order))
    first = sequence.agg(F.min(PERIOD).alias("p")).scalar()
    old = ending.join(sequence, PERIOD).where(F.col("_next").isNotNull()).select(
        "strategy", F.col("_next").alias(PERIOD), "permno", (-F.col("ending_weight")).alias("w"), F.lit(0).alias("new")
    )
    new = weights.select("strategy", PERIOD, "permno", F.col("weight").alias("w"), F.lit(1).alias("new"))
    moved = new.unionByName(old).groupBy("strategy", PERIOD, "permno").agg(
        F.sum("w").alias("change"), F.sum("new").alias("held")
    )
    turnover = moved.groupBy("strategy", PERIOD).agg(
        F.sum("held").alias("stocks"), (F.sum(F.abs("change")) * 0.5).alias("_t")
    )
    return turnover.select(
        "strategy", PERIOD, "stocks",
        F.when(F.col(PERIOD) == first, F.lit(1.0)).otherwise(F.col("_t")).alias("one_way_turnover"),
    )


def event_metrics(path: DataFrame, rolling: int = 5) -> DataFrame:
    """Drawdown, downside volatility, worst rolling loss and cumulative return per event window."""
    window = Window.partitionBy("strategy", PERIOD).orderBy("day")
    rows = path.withColumns(
        {
            "_dd": paths.drawdown(F.col("wealth"), window),
            "_n": F.row_number().over(window),
            "_roll": paths.rolling_return(F.col("portfolio_return"), window, rolling),
        }
    )
    return rows.groupBy("strategy", PERIOD).agg(
        F.count(F.lit(1)).alias("days"),
        (-F.min("_dd")).alias("maximum_drawdown"),
        F.sqrt(F.lit(float(TRADING_DAYS)) * F.avg(F.pow(F.least("portfolio_return", F.lit(0.0)), F.lit(2.0))))
        .alias("downside_volatility"),
        F.greatest(F.lit(0.0), -F.min(F.when(F.col("_n") >= rolling, F.col("_roll")))).alias("worst_rolling_loss"),
        (F.max_by("wealth", "day") - 1.0).alias("cumulative_return"),
    )


def with_series_paths(series: DataFrame, returns: str, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Cumulative wealth and drawdown of whole daily series (one row per day and series)."""
    window = Window.partitionBy(*by).orderBy("day")
    return series.withColumn("wealth", paths.wealth(F.col(returns), window)).withColumn(
        "drawdown", paths.drawdown(F.col("wealth"), window)
    )


def performance_rows(
    series: DataFrame, returns: str, risk_free: Column | float = 0.0, by: Sequence[str] = ("strategy",)
) -> DataFrame:
    """Cumulative and annualised return, volatility, Sharpe, drawdown, downside volatility."""
    rate = risk_free if isinstance(risk_free, Column) else F.lit(float(risk_free))
    rows = with_series_paths(series.withColumn("_rf", rate), returns, by)
    r = F.col(returns)
    growth = F.product(F.lit(1.0) + r)
    year = float(TRADING_DAYS)
    deviation = F.stddev_samp(r)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trading_days"),
        (growth - 1.0).alias("cumulative_return"),
        (F.pow(growth, F.lit(year) / F.count(F.lit(1))) - 1.0).alias("annualized_return"),
        (deviation * F.sqrt(F.lit(year))).alias("annualized_volatility"),
        (F.sqrt(F.lit(year)) * F.avg(r - F.col("_rf")) / F.nullif(deviation, F.lit(0.0))).alias("sharpe_ratio"),
        (-F.min("drawdown")).alias("maximum_drawdown"),
        F.sqrt(F.lit(year) * F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))).alias("downside_volatility"),
    )


def rebalance_schedule(signals: DataFrame, market: DataFrame, final_end: str = "target_window_end") -> DataFrame:
    """Continuous holding periods: each starts after its information date and ends on the
    market day before the next start; the last ends with its target window."""
    calendar = market_calendar(market)
    formations = signals.groupBy(PERIOD, "information_date").agg(F.max(final_end).alias("_final"))
    starts = asof_calendar(formations, calendar, "information_date", "forward").select(
        "information_date", F.col("day").alias("start_day"), F.col("market_day").alias("_start")
    )
    order = Window.partitionBy(F.lit(1)).orderBy(PERIOD)  # one row per period
    planned = formations.join(starts, "information_date").withColumn("_next", F.lead("_start").over(order))
    ends = calendar.select((F.col("market_day") + 1).alias("_next"), F.col("day").alias("_before"))
    return planned.join(ends, "_next", "left").select(
        PERIOD, "information_date", "start_day", F.coalesce("_before", "_final").alias("end_day")
    )


def schedule_calendar(schedule: DataFrame, market: DataFrame) -> DataFrame:
    """Every market day with the period it is held under."""
    days = schedule.select(PERIOD, F.explode(F.sequence("start_day", "end_day")).alias("day"))
    return days.join(market.select("day").distinct(), "day", "left_semi")


def schedule_gaps(calendar: DataFrame, market: DataFrame) -> DataFrame:
    """Days held twice and market days missed between the first and last held day."""
    held = calendar.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    span = held.agg(F.struct(F.min("day").alias("a"), F.max("day").alias("b")).alias("s")).scalar()
    days = market.select("day").distinct().where(F.col("day").between(span["a"], span["b"]))
    return days.join(held, "day", "left").agg(
        F.count(F.lit(1)).alias("market_days"),
        F.count(F.when(F.col("_n").isNull(), F.lit(1))).alias("missed_days"),
        F.count(F.when(F.col("_n") > 1, F.lit(1))).alias("overlapping_days"),
    )


def long_short(path: DataFrame, legs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Long leg minus short leg per day; ``legs`` holds (factor, long strategy, short strategy)."""
    named = F.array(
        *[
            F.struct(F.lit(f).alias("factor"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for f, lo, hi in legs
        ]
    )
    sided = path.withColumn("_f", F.explode(named)).where(
        (F.col("strategy") == F.col("_f.lo")) | (F.col("strategy") == F.col("_f.hi"))
    )
    is_long = F.col("strategy") == F.col("_f.lo")
    return sided.groupBy(F.col("_f.factor").alias("factor"), PERIOD, "day").agg(
        F.max(F.when(is_long, F.col("portfolio_return"))).alias("long_return"),
        F.max(F.when(~is_long, F.col("portfolio_return"))).alias("short_return"),
    ).withColumn("factor_return", F.col("long_return") - F.col("short_return"))


def two_leg_turnover(turnover: DataFrame, factors: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Turnover of long-short factors: the sum of both legs' one-way turnover at each formation.

    ``factors`` holds (factor, long strategy, short strategy), as in ``long_short``. A leg that two
    factors share counts for both.
    """
    legs = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(leg).alias("leg")) for f, *pair in factors for leg in pair])
    sided = turnover.withColumn("_l", F.explode(legs)).where(F.col("strategy") == F.col("_l.leg"))
    return sided.groupBy(F.col("_l.factor").alias("factor"), PERIOD).agg(
        F.sum("stocks").alias("stocks"), F.sum("one_way_turnover").alias("one_way_turnover")
    )


def managed_quarterly_turnover(managed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Turnover of a managed series per period: formation at the exposure held plus changes of exposure."""
    return managed.groupBy(*by, PERIOD).agg(F.sum("managed_turnover").alias("one_way_turnover"))


def managed_net_returns(managed: DataFrame, cost_bps: Sequence[int] = COST_BPS) -> DataFrame:
    """Managed returns after costs, which fall on every day on which the exposure changes."""
    costed = managed.withColumn("cost_bps", F.explode(F.array(*[F.lit(int(b)) for b in cost_bps])))
    cost = F.col("cost_bps") / 10000.0 * F.col("managed_turnover")
    return costed.withColumn("daily_cost", cost).withColumn("net_return", F.col("managed_return") - cost)


def managed_exposure(
    series: DataFrame,
    turnover: DataFrame,
    returns: str = "factor_return",
    target: float = 0.15,
    window_days: int = 63,
    fixed: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Fixed and volatility-managed exposure of daily series, with exposure turnover.

    ``by`` names the columns that tell the series of a frame apart.

    Exposure is the target over the trailing deviation of earlier days, at most one, and one
    while the trailing window is incomplete.
    """
    by = list(by)
    time = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("day")  # one daily series
    deviation = paths.lagged_rolling_deviation(F.col(returns), time, window_days) * F.sqrt(F.lit(float(TRADING_DAYS)))
    exposure = F.coalesce(F.least(F.lit(1.0), F.lit(target) / F.nullif(deviation, F.lit(0.0))), F.lit(1.0))
    in_period = Window.partitionBy(*by, PERIOD).orderBy("day")
    return (
        series.withColumn("exposure", exposure)
        .join(turnover.select(*by, PERIOD, "one_way_turnover"), [*by, PERIOD], "left")
        .withColumns(
            {
                "half_exposure_return": F.lit(fixed) * F.col(returns),
                "managed_return": F.col("exposure") * F.col(returns),
                "_formation": F.when(F.row_number().over(in_period) == 1, F.col("one_way_turnover")).otherwise(0.0),
                "_change": F.coalesce(F.abs(F.col("exposure") - F.lag("exposure").over(time)), F.lit(0.0)),
            }
        )
        .withColumn("managed_turnover", F.col("exposure") * F.col("_formation") + 2 * F.col("_change"))
        .drop("_formation", "_change", "one_way_turnover")
    )


def net_of_costs(
    series: DataFrame,
    turnover: DataFrame,
    returns: str,
    by: str = "strategy",
    cost_bps: Sequence[int] = COST_BPS,
    multiplicative: bool = True,
) -> DataFrame:
    """Daily returns after formation costs, for every cost level.

    Costs fall on the first day of a period: they scale the wealth of a long portfolio and are
    subtracted from a long-short return.
    """
    costed = series.join(turnover.select(by, PERIOD, "one_way_turnover"), [by, PERIOD], "left").withColumn(
        "cost_bps", F.explode(F.array(*[F.lit(int(b)) for b in cost_bps]))
    )
    first = F.row_number().over(Window.partitionBy(by, PERIOD, "cost_bps").orderBy("day")) == 1
    cost = F.when(first, F.col("cost_bps") / 10000.0 * F.col("one_way_turnover")).otherwise(0.0)
    net = (
        (F.lit(1.0) + F.col(returns)) * (F.lit(1.0) - F.col("_cost")) - 1.0
        if multiplicative
        else F.col(returns) - F.col("_cost")
    )
    return costed.withColumn("_cost", cost).withColumn("net_return", net).drop("_cost", "one_way_turnover")


def later_turnover(turnover: DataFrame, by: str = "strategy") -> DataFrame:
    """Mean turnover after each strategy's first formation."""
    order = Window.partitionBy(by).orderBy(PERIOD)
    return (
        turnover.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > 1)
        .groupBy(by).agg(F.count(F.lit(1)).alias("formations"), F.avg("one_way_turnover").alias("mean_turnover"))
    )


def tracking(series: DataFrame, active: str = "active_return") -> DataFrame:
    """Tracking error and information ratio of an active return, annualised."""
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    deviation = F.stddev_samp(active)
    return series.agg(
        F.count(F.lit(1)).alias("trading_days"),
        (deviation * year).alias("tracking_error"),
        (F.avg(active) / F.nullif(deviation, F.lit(0.0)) * year).alias("information_ratio"),
    )


def quarterly_compounded(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """Daily factor returns compounded per period."""
    return series.groupBy(PERIOD).agg(*[(F.product(F.lit(1.0) + F.col(n)) - 1.0).alias(n) for n in names])


def relative_wealth(series: DataFrame, first: str, second: str) -> DataFrame:
    """Wealth of one series relative to another on each day."""
    time = to_date_rows(Window.partitionBy(F.lit(1)).orderBy("day"))
    return series.withColumn(
        "relative_wealth",
        F.product(F.lit(1.0) + F.col(first)).over(time) / F.product(F.lit(1.0) + F.col(second)).over(time),
    )
