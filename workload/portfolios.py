"""Portfolio and factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions import paths
from quarterdeck.operators.aggregates import weekly_returns
from quarterdeck.operators.joins import with_filing_deadline
from quarterdeck.operators.regression import alpha_tests
from quarterdeck.plans import portfolio as pf
from quarterdeck.session import cut_lineage
from workload import recipes as R
from workload.registry import case

# Signals per security and quarter: decile from the security number and quarter, size from value.
R.cte(
    "signals",
    """SELECT report_period, information_date, permno, CAST((permno // 10 * 3 + permno + year(report_period) * 4 + quarter(report_period)) % 10 + 1 AS INTEGER) AS decile,
        CAST(sum(position_value) AS DOUBLE) AS market_cap, CAST(information_date + 91 AS DATE) AS target_window_end
    FROM holdings GROUP BY report_period, information_date, permno""",
    "holdings",
)


def signals(spark, sf):
    """Totals of securities come straight from the lines, as they need no positions."""
    rows = R.lines(spark, sf).groupBy("report_period", "permno").agg(F.sum("cents").cast("double").alias("market_cap"))
    return with_filing_deadline(rows).select(
        "report_period", "information_date", "permno",
        ((F.floor(F.col("permno") / 10) * 3 + F.col("permno") + F.year("report_period") * 4 + F.quarter("report_period")) % 10 + 1).cast("int").alias("decile"),
        "market_cap", F.date_add("information_date", 91).alias("target_window_end"),
    )


R.cte(
    "schedule",
    """SELECT report_period, information_date, start_day, coalesce((SELECT max(day) FROM market m WHERE m.day < nx), target_window_end) AS end_day
    FROM (SELECT *, lead(start_day) OVER (ORDER BY report_period) AS nx FROM (
        SELECT report_period, information_date, max(target_window_end) AS target_window_end,
            (SELECT min(day) FROM market m WHERE m.day > s.information_date) AS start_day FROM signals s GROUP BY report_period, information_date))""",
    "signals market",
)
R.cte("held", "SELECT s.report_period, m.day FROM schedule s JOIN market m ON m.day BETWEEN s.start_day AND s.end_day", "schedule market")
R.cte(
    "grown",
    """SELECT report_period, permno, day, ret, product(1.0 + ret) OVER (PARTITION BY report_period, permno ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth
    FROM (SELECT s.report_period, s.permno, h.day, coalesce(d.ret, 0.0) AS ret FROM signals s JOIN held h USING (report_period)
          LEFT JOIN daily d ON d.permno = s.permno AND d.day = h.day)""",
    "signals held daily",
)
DEFINITIONS_SQL = "(VALUES ('all_stocks', 1, 10), ('exclude_most_fragile_decile', 1, 9), ('least_fragile_decile', 1, 1), ('most_fragile_decile', 10, 10)) d(strategy, lo, hi)"
R.cte("members", f"SELECT s.*, d.strategy FROM signals s JOIN {DEFINITIONS_SQL} ON s.decile BETWEEN lo AND hi", "signals")
R.cte(
    "weights",
    """SELECT report_period, permno, strategy, 1.0 / count(*) OVER (PARTITION BY strategy, report_period) AS weight,
        market_cap / sum(market_cap) OVER (PARTITION BY strategy, report_period) AS cap_weight FROM members""",
    "members",
)
R.cte(
    "ppath",
    """SELECT *, wealth / coalesce(lag(wealth) OVER (PARTITION BY strategy, report_period ORDER BY day), 1.0) - 1.0 AS portfolio_return
    FROM (SELECT w.strategy, w.report_period, g.day, sum(w.weight * g.growth) AS wealth FROM weights w JOIN grown g USING (report_period, permno) GROUP BY ALL)""",
    "weights grown",
)


def base(spark, sf):
    """Signals, schedule calendar and grown member paths, the first and last stored."""
    s = cut_lineage(signals(spark, sf))
    market = R.market(spark, sf)
    calendar = pf.schedule_calendar(pf.rebalance_schedule(s, market), market)
    grown = cut_lineage(pf.security_paths(pf.dense_returns(s, calendar, R.daily(spark, sf))))
    return s, calendar, grown


def path(spark, sf):
    s, _, grown = base(spark, sf)
    weights = pf.formation_weights(pf.portfolio_members(s, pf.EVENT_PORTFOLIOS))
    return s, weights, grown, cut_lineage(pf.portfolio_paths(weights, grown))


@case("i6_rebalance_schedule", "SELECT * FROM schedule", uses="schedule")
def _(spark, sf):
    return pf.rebalance_schedule(signals(spark, sf), R.market(spark, sf))


@case(
    "i6_schedule_gaps",
    """SELECT count(*) AS market_days, 0::BIGINT AS missed_days, 0::BIGINT AS overlapping_days FROM market
    WHERE day BETWEEN (SELECT min(start_day) FROM schedule) AND (SELECT max(end_day) FROM schedule)""",
    uses="market schedule",
)
def _(spark, sf):
    market = cut_lineage(R.market(spark, sf))
    calendar = cut_lineage(pf.schedule_calendar(pf.rebalance_schedule(cut_lineage(signals(spark, sf)), market), market))
    return pf.schedule_gaps(calendar, market)


@case("i1_dense_returns", "SELECT report_period, permno, day, ret FROM grown", uses="grown", doubles="ret")
def _(spark, sf):
    return base(spark, sf)[2].select("report_period", "permno", "day", "ret")


@case("i2_portfolio_membership", "SELECT report_period, permno, strategy FROM members", uses="members")
def _(spark, sf):
    return pf.portfolio_members(signals(spark, sf), pf.EVENT_PORTFOLIOS).select("report_period", "permno", "strategy")


@case("i3_buy_and_hold_path", "SELECT * FROM ppath", uses="ppath", doubles="wealth portfolio_return")
def _(spark, sf):
    return path(spark, sf)[3]


@case(
    "i8_formation_weights", "SELECT report_period, permno, strategy, weight, cap_weight FROM weights",
    uses="weights", doubles="weight cap_weight",
)
def _(spark, sf):
    members = pf.portfolio_members(cut_lineage(signals(spark, sf)), pf.EVENT_PORTFOLIOS)
    by_cap = pf.formation_weights(members, "value").select("report_period", "permno", "strategy", F.col("weight").alias("cap_weight"))
    return pf.formation_weights(members).select("report_period", "permno", "strategy", "weight").join(
        by_cap, ["report_period", "permno", "strategy"]
    )


METRICS = "maximum_drawdown downside_volatility worst_rolling_loss cumulative_return"


@case(
    "i4_event_window_metrics",
    """SELECT strategy, report_period, count(*) AS days, -min(dd) AS maximum_drawdown, sqrt(252.0 * avg(pow(least(portfolio_return, 0.0), 2))) AS downside_volatility,
        greatest(0.0, -min(r5) FILTER (WHERE n >= 5)) AS worst_rolling_loss, arg_max(wealth, day) - 1.0 AS cumulative_return
    FROM (SELECT *, row_number() OVER w AS n, product(1.0 + portfolio_return) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1.0 AS r5,
            wealth / greatest(1.0, max(wealth) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1.0 AS dd
          FROM ppath WINDOW w AS (PARTITION BY strategy, report_period ORDER BY day)) GROUP BY strategy, report_period""",
    uses="ppath", doubles=METRICS,
)
def _(spark, sf):
    return pf.event_metrics(path(spark, sf)[3])


R.cte(
    "series",
    """SELECT p.strategy, p.report_period, p.day, p.portfolio_return, f.risk_free_rate, product(1.0 + portfolio_return) OVER w AS wealth,
        product(1.0 + portfolio_return) OVER w / greatest(1.0, 1.0) AS w2
    FROM ppath p JOIN factors f USING (day) WINDOW w AS (PARTITION BY strategy ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "ppath factors",
)
R.cte(
    "dds",
    "SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY strategy ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1.0 AS dd FROM series",
    "series",
)
PERF = "cumulative_return annualized_return annualized_volatility sharpe_ratio maximum_drawdown downside_volatility"
PERF_SQL = """count(*) AS trading_days, product(1.0 + {r}) - 1.0 AS cumulative_return, pow(product(1.0 + {r}), 252.0 / count(*)) - 1.0 AS annualized_return,
        stddev_samp({r}) * sqrt(252.0) AS annualized_volatility, sqrt(252.0) * avg({r} - {f}) / stddev_samp({r}) AS sharpe_ratio,
        -min(dd) AS maximum_drawdown, sqrt(252.0 * avg(pow(least({r}, 0.0), 2))) AS downside_volatility"""


@case(
    "i13_performance_rows",
    f"SELECT strategy, {PERF_SQL.format(r='portfolio_return', f='risk_free_rate')} FROM dds GROUP BY strategy",
    uses="dds", doubles=PERF,
)
def _(spark, sf):
    rates = R.factors(spark, sf).select("day", "risk_free_rate")
    return pf.performance_rows(path(spark, sf)[3].join(rates, "day"), "portfolio_return", F.col("risk_free_rate"))


@case(
    "i5_drawdown_and_downside",
    """SELECT permno, -min(dd) AS maximum_drawdown, sqrt(252.0 * avg(pow(least(ret, 0.0), 2))) AS downside_volatility FROM (
        SELECT *, w / greatest(1.0, max(w) OVER (PARTITION BY permno ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1.0 AS dd FROM (
            SELECT *, product(1.0 + ret) OVER (PARTITION BY permno ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM daily WHERE ret IS NOT NULL)) GROUP BY permno""",
    uses="daily", doubles="maximum_drawdown downside_volatility",
)
def _(spark, sf):
    rows = R.daily(spark, sf).where(F.col("ret").isNotNull())
    return pf.performance_rows(rows, "ret", by=("permno",)).select("permno", "maximum_drawdown", "downside_volatility")


R.cte(
    "active",
    """SELECT day, report_period, a.portfolio_return AS all_return, s.portfolio_return AS screened_return, s.portfolio_return - a.portfolio_return AS active_return, m.market_return, f.* EXCLUDE (day)
    FROM (SELECT * FROM ppath WHERE strategy = 'all_stocks') a JOIN (SELECT * FROM ppath WHERE strategy = 'exclude_most_fragile_decile') s USING (day, report_period)
    JOIN market m USING (day) JOIN factors f USING (day)""",
    "ppath market factors",
)


def active(spark, sf):
    p = path(spark, sf)[3]
    wide = p.groupBy("report_period", "day").agg(
        F.max(F.when(F.col("strategy") == "all_stocks", F.col("portfolio_return"))).alias("all_return"),
        F.max(F.when(F.col("strategy") == "exclude_most_fragile_decile", F.col("portfolio_return"))).alias("screened_return"),
    )
    return (
        wide.withColumn("active_return", F.col("screened_return") - F.col("all_return"))
        .join(R.market(spark, sf), "day").join(R.factors(spark, sf), "day")
    )


ACTIVE = "all_return screened_return active_return market_return risk_free_rate " + " ".join(R.FACTOR_RULES)


@case("i7_active_and_factor_returns", "SELECT * FROM active", uses="active", doubles=ACTIVE)
def _(spark, sf):
    return active(spark, sf)


@case(
    "i16_tracking_error",
    """SELECT count(*) AS trading_days, stddev_samp(active_return) * sqrt(252.0) AS tracking_error, avg(active_return) / stddev_samp(active_return) * sqrt(252.0) AS information_ratio FROM active""",
    uses="active", doubles="tracking_error information_ratio",
)
def _(spark, sf):
    return pf.tracking(active(spark, sf))


@case(
    "i16_schedule_summary",
    """SELECT report_period, min(day) AS first_day, max(day) AS last_day, count(*) AS trading_days FROM held GROUP BY report_period""",
    uses="held",
)
def _(spark, sf):
    market = R.market(spark, sf)
    calendar = pf.schedule_calendar(pf.rebalance_schedule(signals(spark, sf), market), market)
    return calendar.groupBy("report_period").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("trading_days")
    )


TURNOVER_SQL = """WITH e AS (SELECT strategy, report_period, permno, weight * g / sum(weight * g) OVER (PARTITION BY strategy, report_period) AS ew FROM {w}
            JOIN (SELECT report_period, permno, arg_max(growth, day) AS g FROM grown GROUP BY ALL) USING (report_period, permno)),
    nx AS (SELECT report_period, lead(report_period) OVER (ORDER BY report_period) AS np FROM (SELECT DISTINCT report_period FROM signals)),
    o AS (SELECT strategy, np AS report_period, permno, ew FROM e JOIN nx USING (report_period) WHERE np IS NOT NULL)
    SELECT strategy, report_period, CAST(count(weight) AS BIGINT) AS stocks,
        CASE WHEN report_period = (SELECT min(report_period) FROM signals) THEN 1.0 ELSE 0.5 * sum(abs(coalesce(weight, 0) - coalesce(ew, 0))) END AS one_way_turnover
    FROM {w} FULL JOIN o USING (strategy, report_period, permno) GROUP BY strategy, report_period"""
R.cte("turnover", TURNOVER_SQL.format(w="weights"), "weights grown signals")
R.cte(
    "legweights",
    """SELECT strategy, report_period, permno, 1.0 / count(*) OVER (PARTITION BY strategy, report_period) AS weight
    FROM signals JOIN (VALUES ('long_10', 1, 1), ('short_10', 10, 10), ('long_20', 1, 2), ('short_20', 9, 10)) l(strategy, a, b) ON decile BETWEEN a AND b""",
    "signals",
)
R.cte("legturnover", TURNOVER_SQL.format(w="legweights"), "legweights grown signals")
R.cte(
    "lsturnover",
    """SELECT 'breadth_' || right(strategy, 2) AS factor, report_period, CAST(sum(stocks) AS BIGINT) AS stocks, sum(one_way_turnover) AS one_way_turnover
    FROM legturnover GROUP BY 1, 2""",
    "legturnover",
)


def turnover_of(s, weights, grown):
    return pf.one_way_turnover(weights, pf.ending_weights(weights, grown), s)


@case("i9_one_way_turnover", "SELECT * FROM turnover", uses="turnover", doubles="one_way_turnover")
def _(spark, sf):
    s, weights, grown, _ = path(spark, sf)
    return turnover_of(s, weights, grown)


@case(
    "i19_later_turnover",
    """SELECT strategy, count(*) AS formations, avg(one_way_turnover) AS mean_turnover FROM turnover WHERE report_period > (SELECT min(report_period) FROM signals) GROUP BY strategy""",
    uses="turnover signals", doubles="mean_turnover",
)
def _(spark, sf):
    s, weights, grown, _ = path(spark, sf)
    return pf.later_turnover(turnover_of(s, weights, grown))


LEGS = (("long_10", 1, 1), ("short_10", 10, 10), ("long_20", 1, 2), ("short_20", 9, 10))
FACTORS = (("breadth_10", "long_10", "short_10"), ("breadth_20", "long_20", "short_20"))
LS = """SELECT '{f}' AS factor, l.report_period, l.day, l.r AS long_return, s.r AS short_return, l.r - s.r AS factor_return
    FROM (SELECT *, w / coalesce(lag(w) OVER (PARTITION BY report_period ORDER BY day), 1.0) - 1.0 AS r FROM (SELECT report_period, day, avg(growth) AS w FROM grown JOIN signals USING (report_period, permno) WHERE decile BETWEEN {a} AND {b} GROUP BY ALL)) l
    JOIN (SELECT *, w / coalesce(lag(w) OVER (PARTITION BY report_period ORDER BY day), 1.0) - 1.0 AS r FROM (SELECT report_period, day, avg(growth) AS w FROM grown JOIN signals USING (report_period, permno) WHERE decile BETWEEN {c} AND {d} GROUP BY ALL)) s USING (report_period, day)"""
R.cte("lsfactor", LS.format(f="breadth_10", a=1, b=1, c=10, d=10) + " UNION ALL " + LS.format(f="breadth_20", a=1, b=2, c=9, d=10), "grown signals")


def factor_parts(spark, sf):
    s, _, grown = base(spark, sf)
    weights = pf.formation_weights(pf.portfolio_members(s, LEGS))
    return s, weights, grown, pf.long_short(pf.portfolio_paths(weights, grown), FACTORS)


@case("i10_long_short_factor", "SELECT * FROM lsfactor", uses="lsfactor", doubles="long_return short_return factor_return")
def _(spark, sf):
    return factor_parts(spark, sf)[3]


def factor_turnover(s, weights, grown):
    return cut_lineage(pf.two_leg_turnover(turnover_of(s, weights, grown), FACTORS))


@case("i10_two_leg_turnover", "SELECT * FROM lsturnover", uses="lsturnover", doubles="one_way_turnover")
def _(spark, sf):
    s, weights, grown, _ = factor_parts(spark, sf)
    return factor_turnover(s, weights, grown)


R.cte(
    "managed",
    """SELECT *, exposure * factor_return AS managed_return, 0.5 * factor_return AS half_exposure_return,
        exposure * CASE WHEN row_number() OVER (PARTITION BY report_period ORDER BY day) = 1 THEN one_way_turnover ELSE 0.0 END + 2 * coalesce(abs(exposure - lag(exposure) OVER (ORDER BY day)), 0.0) AS managed_turnover
    FROM (SELECT report_period, day, factor_return, coalesce(least(1.0, 0.15 / (CASE WHEN count(*) OVER w = 63 THEN stddev_samp(factor_return) OVER w END * sqrt(252.0))), 1.0) AS exposure
          FROM lsfactor WHERE factor = 'breadth_10' WINDOW w AS (ORDER BY day ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))
    JOIN (SELECT report_period, one_way_turnover FROM lsturnover WHERE factor = 'breadth_10') USING (report_period)""",
    "lsfactor lsturnover",
)
MANAGED = "factor_return exposure managed_return half_exposure_return managed_turnover"


@case(
    "i11_managed_exposure",
    "SELECT report_period, day, factor_return, exposure, managed_return, half_exposure_return, managed_turnover FROM managed",
    uses="managed", doubles=MANAGED,
)
def _(spark, sf):
    return managed(spark, sf).select("report_period", "day", *MANAGED.split())


def managed(spark, sf):
    s, weights, grown, factor = factor_parts(spark, sf)
    ten = factor_turnover(s, weights, grown).where("factor = 'breadth_10'")
    return pf.managed_exposure(cut_lineage(factor.where("factor = 'breadth_10'")), ten)


@case(
    "i11_quarterly_managed_turnover",
    "SELECT report_period, sum(managed_turnover) AS one_way_turnover FROM managed GROUP BY 1",
    uses="managed", doubles="one_way_turnover",
)
def _(spark, sf):
    return pf.managed_quarterly_turnover(managed(spark, sf))


@case(
    "i12_managed_costs",
    """SELECT day, cost_bps, cost_bps / 10000.0 * managed_turnover AS daily_cost, managed_return - cost_bps / 10000.0 * managed_turnover AS net_return
    FROM managed CROSS JOIN (VALUES (10), (25), (50)) c(cost_bps)""",
    uses="managed", doubles="daily_cost net_return",
)
def _(spark, sf):
    return pf.managed_net_returns(managed(spark, sf)).select("day", "cost_bps", "daily_cost", "net_return")


R.cte(
    "net",
    """SELECT strategy, report_period, day, cost_bps, (1.0 + portfolio_return) * (1.0 - CASE WHEN row_number() OVER (PARTITION BY strategy, report_period, cost_bps ORDER BY day) = 1
            THEN cost_bps / 10000.0 * one_way_turnover ELSE 0.0 END) - 1.0 AS net_return
    FROM ppath JOIN turnover USING (strategy, report_period) CROSS JOIN (VALUES (10), (25), (50)) c(cost_bps)""",
    "ppath turnover",
)


def net_series(spark, sf):
    s, weights, grown, p = path(spark, sf)
    return pf.net_of_costs(p, turnover_of(s, weights, grown), "portfolio_return")


@case(
    "i12_transaction_costs",
    f"""SELECT strategy, cost_bps, {PERF_SQL.format(r='net_return', f='0.0')} FROM (
        SELECT *, w / greatest(1.0, max(w) OVER (PARTITION BY strategy, cost_bps ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1.0 AS dd FROM (
            SELECT *, product(1.0 + net_return) OVER (PARTITION BY strategy, cost_bps ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM net)) GROUP BY strategy, cost_bps""",
    uses="net", doubles=PERF,
)
def _(spark, sf):
    return pf.performance_rows(net_series(spark, sf), "net_return", by=("strategy", "cost_bps"))


@case(
    "i12_long_short_costs",
    """SELECT factor, report_period, day, cost_bps, factor_return - CASE WHEN row_number() OVER (PARTITION BY factor, report_period, cost_bps ORDER BY day) = 1 THEN cost_bps / 10000.0 * one_way_turnover ELSE 0.0 END AS net_return
    FROM lsfactor JOIN lsturnover USING (factor, report_period) CROSS JOIN (VALUES (10), (25), (50)) c(cost_bps)""",
    uses="lsfactor lsturnover", doubles="net_return",
)
def _(spark, sf):
    s, weights, grown, factor = factor_parts(spark, sf)
    return pf.net_of_costs(cut_lineage(factor), factor_turnover(s, weights, grown), "factor_return", by="factor", multiplicative=False).select(
        "factor", "report_period", "day", "cost_bps", "net_return"
    )


@case(
    "i17_implementation_table",
    """SELECT strategy, (SELECT avg(one_way_turnover) FROM turnover t WHERE t.strategy = x.strategy) AS mean_turnover,
        (SELECT product(1.0 + portfolio_return) - 1.0 FROM ppath p WHERE p.strategy = x.strategy) AS gross, product(1.0 + net_return) FILTER (WHERE cost_bps = 10) - 1.0 AS net_10,
        product(1.0 + net_return) FILTER (WHERE cost_bps = 25) - 1.0 AS net_25, product(1.0 + net_return) FILTER (WHERE cost_bps = 50) - 1.0 AS net_50 FROM net x GROUP BY strategy""",
    uses="net turnover ppath", doubles="mean_turnover gross net_10 net_25 net_50",
)
def _(spark, sf):
    s, weights, grown, p = path(spark, sf)
    turnover = cut_lineage(turnover_of(s, weights, grown))
    net = pf.net_of_costs(p, turnover, "portfolio_return")
    means = turnover.groupBy("strategy").agg(F.avg("one_way_turnover").alias("mean_turnover")).join(
        p.groupBy("strategy").agg((F.product(F.lit(1.0) + F.col("portfolio_return")) - 1.0).alias("gross")), "strategy"
    )
    return net.groupBy("strategy").agg(
        *[(F.product(F.when(F.col("cost_bps") == b, F.col("net_return") + 1.0)) - 1.0).alias(f"net_{b}") for b in pf.COST_BPS]
    ).join(means, "strategy")


R.cte(
    "fperiod",
    "SELECT CAST(last_day(make_date(year(day), quarter(day) * 3, 1)) AS DATE) AS report_period, * FROM factors",
    "factors",
)


@case(
    "i18_quarterly_factor_returns",
    "SELECT report_period, " + ", ".join(f"product(1.0 + {n}) - 1.0 AS {n}" for n in R.FACTOR_RULES) + " FROM fperiod GROUP BY report_period",
    uses="fperiod", doubles=" ".join(R.FACTOR_RULES),
)
def _(spark, sf):
    from quarterdeck.functions.dates import quarter_end

    series = R.factors(spark, sf).withColumn("report_period", quarter_end(F.col("day")))
    return pf.quarterly_compounded(series, list(R.FACTOR_RULES))


@case(
    "i18_factor_correlations",
    "SELECT " + ", ".join(f"corr(active_return, {n}) AS active_{n}" for n in R.FACTOR_RULES) + " FROM active",
    uses="active", doubles=" ".join(f"active_{n}" for n in R.FACTOR_RULES),
)
def _(spark, sf):
    from quarterdeck.functions.aggregates import guarded_corr

    return active(spark, sf).agg(
        *[guarded_corr(F.col("active_return"), F.col(n)).alias(f"active_{n}") for n in R.FACTOR_RULES]
    )


MODELS = {
    "capm": ["market_excess_return"],
    "ff5_momentum": list(R.FACTOR_RULES),
}


@case("i14_factor_regression_hac")
def _(spark, sf):
    frame = cut_lineage(active(spark, sf))
    return alpha_tests(frame, ["screened_return", "active_return"], MODELS, [5], "day")


@case("i15_hac_lag_sensitivity")
def _(spark, sf):
    frame = cut_lineage(active(spark, sf))
    return alpha_tests(frame, ["active_return"], {"ff5_momentum": MODELS["ff5_momentum"]}, [5, 21, 63], "day")


# ------------------------------------------------------------------ series windows
@case(
    "w15_lagged_rolling_deviation",
    """SELECT permno, day, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS trailing_deviation FROM daily
    WINDOW w AS (PARTITION BY permno ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    uses="daily", doubles="trailing_deviation",
)
def _(spark, sf):
    window = Window.partitionBy("permno").orderBy("day")
    return R.daily(spark, sf).select("permno", "day", paths.lagged_rolling_deviation(F.col("ret"), window, 20).alias("trailing_deviation"))


@case(
    "w16_first_flag_and_difference",
    """SELECT report_period, day, row_number() OVER (PARTITION BY report_period ORDER BY day) = 1 AS is_first, abs(market_return - lag(market_return) OVER (ORDER BY day)) AS step
    FROM held JOIN market USING (day)""",
    uses="held market", doubles="step",
)
def _(spark, sf):
    market = R.market(spark, sf)
    calendar = pf.schedule_calendar(pf.rebalance_schedule(signals(spark, sf), market), market)
    series = calendar.join(market, "day")
    time = Window.partitionBy(F.lit(1)).orderBy("day")  # one row per market day
    return series.select(
        "report_period", "day",
        (F.row_number().over(Window.partitionBy("report_period").orderBy("day")) == 1).alias("is_first"),
        F.abs(F.col("market_return") - F.lag("market_return").over(time)).alias("step"),
    )


@case(
    "w17_series_wealth_and_relative",
    """SELECT day, product(1.0 + screened_return) OVER w / product(1.0 + all_return) OVER w AS relative_wealth FROM active
    WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    uses="active", doubles="relative_wealth",
)
def _(spark, sf):
    return pf.relative_wealth(active(spark, sf), "screened_return", "all_return").select("day", "relative_wealth")


@case(
    "g32_friday_weeks",
    """SELECT permno, count(*) AS weeks, avg(r) AS mean_return, stddev_samp(r) AS deviation, quantile_cont(r, 0.05) AS p05, min(r) AS worst FROM (
        SELECT permno, day + CAST((12 - isodow(day)) % 7 AS INTEGER) AS wk, product(1.0 + ret) - 1.0 AS r FROM daily WHERE ret IS NOT NULL GROUP BY ALL) GROUP BY permno""",
    uses="daily", doubles="mean_return deviation p05 worst",
)
def _(spark, sf):
    from quarterdeck.functions.order import exact_quantiles

    weeks = weekly_returns(R.daily(spark, sf).where(F.col("ret").isNotNull()), ["permno"], "day", "ret")
    stats = weeks.groupBy("permno").agg(
        F.count(F.lit(1)).alias("weeks"), F.avg("week_return").alias("mean_return"),
        F.stddev_samp("week_return").alias("deviation"), F.min("week_return").alias("worst"),
    )
    return stats.join(exact_quantiles(weeks, ["permno"], "week_return", {"p05": 0.05}), "permno")
