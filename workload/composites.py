"""Composite operators: market features, targets, panel, splits, network."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.functions.dates import quarter_index
from quarterdeck.operators import graph
from quarterdeck.operators.aggregates import with_share_of_total
from quarterdeck.operators.contracts import key_audit, rule_counts
from quarterdeck.operators.joins import linked_pairs, reconcile
from quarterdeck.plans import market as mk
from quarterdeck.plans import network as nw
from quarterdeck.plans import panel as pn
from quarterdeck.session import cut_lineage
from workload import recipes as R
from workload.registry import case

RULES = mk.FeatureRules(minimum_quarter=5, minimum_year=20)

R.cte("calendar", "SELECT day, row_number() OVER (ORDER BY day) AS market_day FROM (SELECT DISTINCT day FROM lines)", "lines")
R.cte(
    "predictions",
    "SELECT DISTINCT report_period, information_date, permno FROM holdings",
    "holdings",
)
R.cte(
    "fwindows",
    """
    SELECT p.*, s.day AS feature_window_start, e.day AS feature_window_end, e.market_day AS idx
    FROM predictions p
    LEFT JOIN (SELECT d.information_date, max(c.market_day) AS m FROM (SELECT DISTINCT information_date FROM predictions) d
               JOIN calendar c ON c.day < d.information_date GROUP BY 1) a USING (information_date)
    LEFT JOIN calendar e ON e.market_day = a.m
    LEFT JOIN calendar s ON s.market_day = a.m - 251
    """,
    "predictions calendar",
)
R.cte(
    "features",
    """
    SELECT w.report_period, w.information_date, w.permno, w.feature_window_start, w.feature_window_end,
        coalesce(f.o21, 0) AS return_observations_21d, coalesce(f.o63, 0) AS return_observations_63d,
        coalesce(f.o126, 0) AS return_observations_126d, coalesce(f.o252, 0) AS return_observations_252d,
        coalesce(f.ob, 0) AS beta_return_observations_252d,
        f.market_price, f.market_cap, f.average_daily_dollar_volume_63d, f.return_21d, f.return_63d, f.return_126d,
        f.return_252d, f.momentum_252_21d, f.volatility_63d, f.volatility_252d, f.downside_volatility_63d,
        f.downside_volatility_252d, CASE WHEN isnan(f.beta) THEN NULL ELSE f.beta END AS market_beta_252d,
        f.negative_return_share_63d, f.maximum_drawdown_252d,
        coalesce(w.feature_window_start IS NOT NULL AND f.o63 >= 5 AND f.o252 >= 20 AND f.ob >= 20
            AND f.beta IS NOT NULL AND NOT isnan(f.beta) AND f.market_price > 0 AND f.market_cap > 0, false) AS market_feature_usable
    FROM fwindows w LEFT JOIN (
        SELECT report_period, permno,
            count(ret) FILTER (WHERE market_day > idx - 21) AS o21, count(ret) FILTER (WHERE market_day > idx - 63) AS o63,
            count(ret) FILTER (WHERE market_day > idx - 126) AS o126, count(ret) AS o252,
            count(ret) FILTER (WHERE market_return IS NOT NULL) AS ob,
            arg_max(price, day) AS market_price, arg_max(cap, day) AS market_cap,
            avg(abs(price) * volume) FILTER (WHERE market_day > idx - 63) AS average_daily_dollar_volume_63d,
            product(1.0 + ret) FILTER (WHERE market_day > idx - 21) - 1.0 AS return_21d,
            product(1.0 + ret) FILTER (WHERE market_day > idx - 63) - 1.0 AS return_63d,
            product(1.0 + ret) FILTER (WHERE market_day > idx - 126) - 1.0 AS return_126d,
            product(1.0 + ret) - 1.0 AS return_252d,
            product(1.0 + ret) FILTER (WHERE market_day <= idx - 21) - 1.0 AS momentum_252_21d,
            stddev_samp(ret) FILTER (WHERE market_day > idx - 63) * sqrt(252.0) AS volatility_63d,
            stddev_samp(ret) * sqrt(252.0) AS volatility_252d,
            sqrt(252.0 * avg(pow(least(ret, 0.0), 2)) FILTER (WHERE market_day > idx - 63)) AS downside_volatility_63d,
            sqrt(252.0 * avg(pow(least(ret, 0.0), 2))) AS downside_volatility_252d,
            regr_slope(ret, market_return) AS beta,
            avg(CAST(ret < 0 AS DOUBLE)) FILTER (WHERE market_day > idx - 63) AS negative_return_share_63d,
            -min(dd) AS maximum_drawdown_252d
        FROM (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY report_period, permno ORDER BY day
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1.0 AS dd
              FROM (SELECT w.report_period, w.permno, w.idx, c.market_day, d.*, m.market_return,
                        product(1.0 + d.ret) OVER (PARTITION BY w.report_period, w.permno ORDER BY d.day
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth
                    FROM fwindows w
                    JOIN (SELECT permno AS pn, day, ret, price, cap, volume FROM daily WHERE trading_status = 'A') d
                        ON d.pn = w.permno AND d.day BETWEEN w.feature_window_start AND w.feature_window_end
                    JOIN calendar c USING (day) JOIN market m USING (day)))
        GROUP BY report_period, permno) f USING (report_period, permno)
    """,
    "fwindows daily market calendar",
)
FEATURE_DOUBLES = (
    "market_price market_cap average_daily_dollar_volume_63d return_21d return_63d return_126d return_252d "
    "momentum_252_21d volatility_63d volatility_252d downside_volatility_63d downside_volatility_252d "
    "market_beta_252d negative_return_share_63d maximum_drawdown_252d"
)


def predictions(spark, sf):
    return mk.prediction_rows(R.positions(spark, sf))


def features(spark, sf):
    return mk.market_features(
        predictions(spark, sf), R.daily(spark, sf), R.market(spark, sf), RULES,
        trading=F.col("trading_status") == "A",
    )


@case("c15_market_features", "SELECT * FROM features", uses="features", doubles=FEATURE_DOUBLES)
def _(spark, sf):
    return features(spark, sf)


# ------------------------------------------------------------------ forward targets
def _targets_sql(horizons: str) -> str:
    return f"""
    WITH h(horizon_market_days, minimum_observations) AS (VALUES {horizons}),
    w AS (
        SELECT p.*, h.*, f.day AS target_window_start, e.day AS target_window_end
        FROM predictions p CROSS JOIN h
        LEFT JOIN (SELECT d.information_date, min(c.market_day) AS m FROM (SELECT DISTINCT information_date FROM predictions) d
                   JOIN calendar c ON c.day > d.information_date GROUP BY 1) a USING (information_date)
        LEFT JOIN calendar f ON f.market_day = a.m
        LEFT JOIN calendar e ON e.market_day = a.m + h.horizon_market_days - 1),
    o AS (SELECT w.*, d.day, d.ret, d.delisting_flag FROM w JOIN (SELECT permno AS pn, day, ret, delisting_flag FROM daily) d
            ON d.pn = w.permno AND d.day BETWEEN w.target_window_start AND w.target_window_end),
    r AS (SELECT *, row_number() OVER x AS sd, product(1.0 + ret) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth,
            product(1.0 + ret) OVER (x ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1.0 AS r5
          FROM o WHERE ret IS NOT NULL WINDOW x AS (PARTITION BY report_period, permno, horizon_market_days ORDER BY day)),
    p AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY report_period, permno, horizon_market_days ORDER BY day
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1.0 AS dd FROM r),
    m AS (SELECT report_period, permno, horizon_market_days, count(*) AS n, -min(dd) AS mdd, product(1.0 + ret) - 1.0 AS cum,
            sqrt(252.0 * avg(pow(least(ret, 0.0), 2))) AS dv, min(r5) FILTER (WHERE sd >= 5) AS w5, min(ret) AS w1 FROM p GROUP BY ALL),
    x AS (SELECT report_period, permno, horizon_market_days, bool_or(delisting_flag = 'Y') AS del,
            bool_or(delisting_flag = 'Y' AND ret IS NOT NULL) AS obs FROM o GROUP BY ALL)
    SELECT w.report_period, w.information_date, w.permno, w.horizon_market_days, w.target_window_start, w.target_window_end,
        coalesce(m.n, 0) AS return_observations, coalesce(x.del, false) AS delisted_in_window, coalesce(x.obs, false) AS delisting_return_observed,
        m.mdd AS future_max_drawdown, m.cum AS future_cumulative_return, m.dv AS future_downside_volatility,
        m.w5 AS future_worst_rolling_return, m.w1 AS future_worst_daily_return, w.target_window_end IS NOT NULL AS target_window_complete,
        w.target_window_end IS NOT NULL AND (NOT coalesce(x.del, false) OR coalesce(x.obs, false))
            AND (coalesce(m.n, 0) >= w.minimum_observations OR coalesce(x.obs, false)) AND m.mdd IS NOT NULL AS target_usable
    FROM w LEFT JOIN m USING (report_period, permno, horizon_market_days) LEFT JOIN x USING (report_period, permno, horizon_market_days)
    """


R.cte("targets", _targets_sql("(63, 5)"), "predictions calendar daily")
R.cte("alt_targets", _targets_sql("(21, 2), (126, 10)"), "predictions calendar daily")
TARGET_DOUBLES = (
    "future_max_drawdown future_cumulative_return future_downside_volatility "
    "future_worst_rolling_return future_worst_daily_return"
)


def targets(spark, sf, horizons=((63, 5),)):
    return mk.forward_targets(predictions(spark, sf), R.daily(spark, sf), horizons)


@case("c16_downside_targets", "SELECT * FROM targets", uses="targets", doubles=TARGET_DOUBLES)
def _(spark, sf):
    return targets(spark, sf)


@case("c17_alternative_horizons", "SELECT * FROM alt_targets", uses="alt_targets", doubles=TARGET_DOUBLES)
def _(spark, sf):
    return targets(spark, sf, ((21, 2), (126, 10)))


@case(
    "g16_any_true_per_group",
    "SELECT permno, bool_or(delisted_in_window) AS ever_delisted, bool_or(delisting_return_observed) AS return_seen FROM targets GROUP BY permno",
    uses="targets",
)
def _(spark, sf):
    return targets(spark, sf).groupBy("permno").agg(
        F.bool_or("delisted_in_window").alias("ever_delisted"), F.bool_or("delisting_return_observed").alias("return_seen")
    )


@case(
    "g19_market_feature_audit",
    """SELECT report_period, information_date, count(*) AS security_periods, count(*) FILTER (WHERE market_feature_usable) AS usable_security_periods,
        avg(CAST(market_feature_usable AS DOUBLE)) AS usable_share, median(return_observations_252d) AS median_return_observations_252d,
        count(*) FILTER (WHERE market_cap IS NULL) AS missing_market_cap, count(*) FILTER (WHERE market_beta_252d IS NULL) AS missing_market_beta,
        count(*) FILTER (WHERE return_252d IS NULL OR volatility_252d IS NULL OR market_beta_252d IS NULL OR maximum_drawdown_252d IS NULL) AS missing_primary_features
    FROM features GROUP BY ALL""",
    uses="features", doubles="usable_share median_return_observations_252d",
)
def _(spark, sf):
    return mk.market_feature_audit(cut_lineage(features(spark, sf)))


@case(
    "g19_target_audit",
    """SELECT report_period, information_date, count(*) AS security_periods, count(*) FILTER (WHERE target_window_complete) AS complete_horizon_security_periods,
        count(*) FILTER (WHERE target_usable) AS usable_security_periods, avg(CAST(target_usable AS DOUBLE)) AS usable_share,
        count(*) FILTER (WHERE delisted_in_window) AS delisting_events,
        count(*) FILTER (WHERE delisted_in_window AND NOT delisting_return_observed) AS missing_delisting_returns,
        median(return_observations) AS median_return_observations,
        median(future_max_drawdown) FILTER (WHERE target_usable) AS median_future_max_drawdown
    FROM targets GROUP BY ALL""",
    uses="targets", doubles="usable_share median_return_observations median_future_max_drawdown",
)
def _(spark, sf):
    return mk.target_audit(cut_lineage(targets(spark, sf)))


@case(
    "q17_unusable_feature_reasons",
    """SELECT unnest(['no_window', 'few_quarter_returns', 'few_year_returns', 'no_beta', 'no_price', 'no_cap']) AS rule,
        unnest([count(*) FILTER (WHERE feature_window_start IS NULL), count(*) FILTER (WHERE return_observations_63d < 5),
            count(*) FILTER (WHERE return_observations_252d < 20), count(*) FILTER (WHERE market_beta_252d IS NULL),
            count(*) FILTER (WHERE market_price IS NULL), count(*) FILTER (WHERE market_cap IS NULL)]) AS rows
    FROM features WHERE NOT market_feature_usable""",
    uses="features",
)
def _(spark, sf):
    return rule_counts(
        features(spark, sf).where(~F.col("market_feature_usable")),
        {
            "no_window": F.col("feature_window_start").isNull(),
            "few_quarter_returns": F.col("return_observations_63d") < 5,
            "few_year_returns": F.col("return_observations_252d") < 20,
            "no_beta": F.col("market_beta_252d").isNull(),
            "no_price": F.col("market_price").isNull(),
            "no_cap": F.col("market_cap").isNull(),
        },
    )


# ------------------------------------------------------------------ ownership network
R.cte(
    "managers",
    """SELECT report_period, information_date, manager, CAST(row_number() OVER (PARTITION BY report_period ORDER BY manager) - 1 AS INTEGER) AS manager_index,
        CAST(sum(position_value) AS BIGINT) AS portfolio_value, count(*) AS security_count, max(portfolio_weight) AS largest_position_weight,
        sum(portfolio_weight * portfolio_weight) AS portfolio_hhi
    FROM holdings GROUP BY report_period, information_date, manager""",
    "holdings",
)
R.cte(
    "securities",
    """SELECT report_period, information_date, permno, CAST(row_number() OVER (PARTITION BY report_period ORDER BY permno) - 1 AS INTEGER) AS security_index,
        count(DISTINCT manager) AS institutional_holder_count, CAST(sum(position_value) AS BIGINT) AS total_reported_value,
        sum(hs * hs) AS reported_ownership_hhi, sum(hs) FILTER (WHERE rk <= 5) AS top_five_reported_ownership_share,
        avg(portfolio_weight) AS mean_owner_portfolio_weight, max(portfolio_weight) AS maximum_owner_portfolio_weight
    FROM (SELECT *, position_value / CAST(sum(position_value) OVER (PARTITION BY report_period, permno) AS DOUBLE) AS hs,
            row_number() OVER (PARTITION BY report_period, permno ORDER BY position_value DESC, manager) AS rk FROM holdings)
    GROUP BY report_period, information_date, permno""",
    "holdings",
)
R.cte(
    "density",
    """SELECT report_period, information_date, count(DISTINCT manager) AS managers, count(*) AS ownership_edges,
        count(DISTINCT permno) AS securities, count(*) / (CAST(count(DISTINCT manager) AS DOUBLE) * count(DISTINCT permno)) AS bipartite_density
    FROM holdings GROUP BY ALL""",
    "holdings",
)


@case("c5_manager_nodes", "SELECT * FROM managers", uses="managers", doubles="largest_position_weight portfolio_hhi")
def _(spark, sf):
    return nw.manager_nodes(R.holdings(spark, sf))


@case(
    "c5_security_nodes", "SELECT * FROM securities", uses="securities",
    doubles="reported_ownership_hhi top_five_reported_ownership_share mean_owner_portfolio_weight maximum_owner_portfolio_weight",
)
def _(spark, sf):
    return nw.security_nodes(R.holdings(spark, sf))


@case("c6_network_density", "SELECT * FROM density", uses="density", doubles="bipartite_density")
def _(spark, sf):
    return nw.network_density(R.holdings(spark, sf))


@case(
    "c6_connected_components",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT report_period, manager * 2 + 1 AS a, CAST(permno AS BIGINT) * 2 AS b FROM holdings),
    n AS (SELECT report_period, a, b FROM e UNION SELECT report_period, b, a FROM e),
    reach(report_period, node, lab) AS (
        SELECT report_period, a, a FROM n
        UNION
        SELECT r.report_period, n.b, r.lab FROM reach r JOIN n ON n.report_period = r.report_period AND n.a = r.node AND r.lab < n.b),
    l AS (SELECT report_period, node, min(lab) AS component FROM reach GROUP BY ALL)
    SELECT report_period, count(*) AS connected_components, max(nodes) AS largest_component_nodes, max(nodes) / CAST(sum(nodes) AS DOUBLE) AS largest_component_share
    FROM (SELECT report_period, component, count(*) AS nodes FROM l GROUP BY ALL) GROUP BY report_period
    """,
    uses="holdings", doubles="largest_component_share",
)
def _(spark, sf):
    return nw.network_components(R.positions(spark, sf))


K_COUNTS = (3, 5, 10)
R.cte(
    "directed",
    """
    SELECT * FROM (
        SELECT report_period, source, target, row_number() OVER (PARTITION BY report_period, source ORDER BY sim DESC, target) AS neighbor_rank,
            sim AS cosine_similarity
        FROM (SELECT a.report_period, a.manager AS source, b.manager AS target,
                least(round(sum(a.portfolio_weight * b.portfolio_weight) / (any_value(na.n) * any_value(nb.n)), 9), 1.0) AS sim
              FROM holdings a JOIN holdings b ON a.report_period = b.report_period AND a.permno = b.permno AND a.manager <> b.manager
              JOIN norms na ON na.report_period = a.report_period AND na.manager = a.manager
              JOIN norms nb ON nb.report_period = b.report_period AND nb.manager = b.manager
              GROUP BY a.report_period, a.manager, b.manager) WHERE sim > 0)
    WHERE neighbor_rank <= 10
    """,
    "holdings norms",
)
R.cte("norms", "SELECT report_period, manager, sqrt(sum(portfolio_weight * portfolio_weight)) AS n FROM holdings GROUP BY ALL", "holdings")
R.cte(
    "kedges",
    """SELECT report_period, k AS k_neighbors, least(source, target) AS manager_a, greatest(source, target) AS manager_b,
        max(cosine_similarity) AS cosine_similarity, count(*) AS directional_links, CAST(min(neighbor_rank) AS INTEGER) AS best_neighbor_rank,
        count(*) = 2 AS is_mutual_neighbor
    FROM directed CROSS JOIN (VALUES (3), (5), (10)) ks(k) WHERE neighbor_rank <= k GROUP BY ALL""",
    "directed",
)
R.cte("edges", "SELECT * EXCLUDE (k_neighbors) FROM kedges WHERE k_neighbors = 5", "kedges")


def directed(spark, sf, neighbors=max(K_COUNTS)):
    return near(R.positions(spark, sf), neighbors)


def near(positions, neighbors):
    """Neighbours of managers from one row per position, by value: weights are values by a manager's total."""
    return nw.similarity_neighbors(positions, neighbors, "position_value", digits=9, unique=True)


def edges(spark, sf):
    return nw.similarity_edges(directed(spark, sf, 5), 5).drop("k_neighbors")


@case("c7_cosine_neighbors", "SELECT * REPLACE (CAST(neighbor_rank AS INTEGER) AS neighbor_rank) FROM directed", uses="directed", doubles="cosine_similarity")
def _(spark, sf):
    return directed(spark, sf)


@case("c8_undirected_union_graph", "SELECT * FROM edges", uses="edges", doubles="cosine_similarity")
def _(spark, sf):
    return edges(spark, sf)


@case(
    "c9_neighbor_count_sensitivity",
    """SELECT e.report_period, e.k_neighbors, e.undirected_edges, e.mutual_edges, e.mutual_edges / CAST(e.undirected_edges AS DOUBLE) AS mutual_edge_share,
        c.n AS connected_managers, m.n - c.n AS isolated_managers, e.mean_similarity, e.median_similarity,
        2 * e.undirected_edges / CAST(m.n * (m.n - 1) AS DOUBLE) AS projected_density
    FROM (SELECT report_period, k_neighbors, count(*) AS undirected_edges, count(*) FILTER (WHERE is_mutual_neighbor) AS mutual_edges,
            avg(cosine_similarity) AS mean_similarity, median(cosine_similarity) AS median_similarity FROM kedges GROUP BY ALL) e
    JOIN (SELECT report_period, k_neighbors, count(DISTINCT v) AS n FROM (SELECT report_period, k_neighbors, manager_a AS v FROM kedges
            UNION ALL SELECT report_period, k_neighbors, manager_b FROM kedges) GROUP BY ALL) c USING (report_period, k_neighbors)
    JOIN (SELECT report_period, count(*) AS n FROM managers GROUP BY 1) m USING (report_period)""",
    uses="kedges managers", doubles="mutual_edge_share mean_similarity median_similarity projected_density",
)
def _(spark, sf):
    h = R.stored_holdings(spark, sf)
    return nw.similarity_audit(near(h, max(K_COUNTS)), nw.manager_nodes(h), K_COUNTS)


def held_and_near(spark, sf):
    """Holdings, computed once, and the stored edges between their managers."""
    h = R.stored_holdings(spark, sf)
    return h, cut_lineage(nw.similarity_edges(near(h, 5), 5))


def communities(spark, sf):
    h, e = held_and_near(spark, sf)
    return h, e, nw.detect_communities(nw.manager_nodes(h), e)


@case("c10_communities")
def _(spark, sf):
    return communities(spark, sf)[2].select("report_period", "manager", "community_id")


@case(
    "c10_community_quality",
    """SELECT report_period, count(*) AS managers, TRUE AS above_singletons, TRUE AS above_one_community, CAST(0 AS BIGINT) AS unconnected
    FROM managers GROUP BY 1""",
    uses="managers",
)
def _(spark, sf):
    """Labels of every period: better than no grouping and than one group, and every community connected."""
    _, e, found = communities(spark, sf)
    labels = cut_lineage(found.select("report_period", F.col("manager").alias("node"), F.col("community_id").cast("long").alias("community")))
    ends = e.select("report_period", F.col("manager_a").alias("u"), F.col("manager_b").alias("v"), F.col("cosine_similarity").alias("w"))

    def score(labelling, name):
        return graph.modularity(ends, labelling, "report_period", "u", "v", "w").withColumnRenamed("modularity", name)

    parts = graph.connected_parts(labels, ends, "report_period").groupBy("report_period").agg(F.count_distinct("community").alias("_parts"))
    sizes = labels.groupBy("report_period").agg(
        F.count(F.lit(1)).alias("managers"), F.count_distinct("community").alias("_communities")
    )
    alone = labels.withColumn("community", F.col("node"))
    return sizes.join(parts, "report_period").join(score(labels, "_found"), "report_period").join(score(alone, "_alone"), "report_period").select(
        "report_period", "managers", (F.col("_found") > F.col("_alone")).alias("above_singletons"),
        (F.col("_found") > 0).alias("above_one_community"), (F.col("_parts") - F.col("_communities")).alias("unconnected"),
    )


@case(
    "c10_communities_downstream",
    """SELECT m.report_period, count(*) AS managers, round(sum(1.0 * m.n_positions), 6) AS positions, TRUE AS shares_add_up
    FROM (SELECT report_period, manager, count(*) AS n_positions FROM holdings GROUP BY ALL) m GROUP BY 1""",
    uses="holdings", doubles="positions",
)
def _(spark, sf):
    """Communities into their summary: every manager and position is counted in one community."""
    h, _, found = communities(spark, sf)
    found = cut_lineage(found)
    summary = nw.community_summary(found)
    held = h.groupBy("report_period", "manager").agg(F.count(F.lit(1)).alias("n"))
    counted = found.join(held, ["report_period", "manager"]).groupBy("report_period").agg(F.sum("n").alias("positions"))
    return summary.groupBy("report_period").agg(
        F.sum("manager_count").alias("managers"), (F.abs(F.sum("manager_share") - 1) < 1e-9).alias("shares_add_up")
    ).join(counted, "report_period")


R.cte(
    "degrees",
    """SELECT m.*, coalesce(d.n, 0) AS similarity_degree, coalesce(d.s, 0.0) AS mean_neighbor_similarity, CAST(m.manager % 7 + 1 AS INTEGER) AS community_id
    FROM managers m LEFT JOIN (SELECT report_period, v, count(*) AS n, avg(cosine_similarity) AS s FROM (
        SELECT report_period, manager_a AS v, cosine_similarity FROM edges UNION ALL SELECT report_period, manager_b, cosine_similarity FROM edges)
        GROUP BY ALL) d ON d.report_period = m.report_period AND d.v = m.manager""",
    "managers edges",
)


def labelled(h, e):
    """Managers with degrees and fixed labels, so that label-based measures have an exact answer."""
    return nw.with_similarity_degrees(nw.manager_nodes(h), e).withColumn(
        "community_id", (F.col("manager") % 7 + 1).cast("int")
    )


@case(
    "c11_node_degree",
    "SELECT report_period, manager, similarity_degree, mean_neighbor_similarity FROM degrees",
    uses="degrees", doubles="mean_neighbor_similarity",
)
def _(spark, sf):
    return labelled(*held_and_near(spark, sf)).select("report_period", "manager", "similarity_degree", "mean_neighbor_similarity")


@case(
    "c12_community_summary",
    """SELECT report_period, community_id, count(*) AS manager_count, count(*) / CAST(sum(count(*)) OVER (PARTITION BY report_period) AS DOUBLE) AS manager_share,
        CAST(sum(portfolio_value) AS BIGINT) AS total_portfolio_value, median(portfolio_value) AS median_portfolio_value, avg(security_count) AS mean_security_count,
        avg(largest_position_weight) AS mean_largest_position_weight, avg(portfolio_hhi) AS mean_portfolio_hhi, avg(similarity_degree) AS mean_similarity_degree
    FROM degrees GROUP BY report_period, community_id""",
    uses="degrees",
    doubles="manager_share median_portfolio_value mean_security_count mean_largest_position_weight mean_portfolio_hhi mean_similarity_degree",
)
def _(spark, sf):
    return nw.community_summary(cut_lineage(labelled(*held_and_near(spark, sf))))


@case(
    "c13_community_meta_graph",
    """SELECT report_period, least(manager_a % 7, manager_b % 7) + 1 AS community_a, greatest(manager_a % 7, manager_b % 7) + 1 AS community_b,
        count(*) AS pairs, avg(cosine_similarity) AS mean_similarity
    FROM edges WHERE manager_a % 7 <> manager_b % 7 GROUP BY ALL""",
    uses="edges", doubles="mean_similarity",
)
def _(spark, sf):
    h, e = held_and_near(spark, sf)
    labels = h.select("report_period", "manager").distinct().withColumn("community_id", F.col("manager") % 7 + 1)
    return nw.community_meta_graph(e, labels)


R.cte(
    "netfeat",
    """
    WITH o AS (SELECT h.report_period, h.permno, h.manager, h.position_value / CAST(sum(h.position_value) OVER (PARTITION BY h.report_period, h.permno) AS DOUBLE) AS s,
            d.similarity_degree AS deg, d.mean_neighbor_similarity AS near, d.community_id AS c, count(*) OVER () AS x, m.n
        FROM holdings h JOIN degrees d USING (report_period, manager) JOIN (SELECT report_period, count(*) AS n FROM managers GROUP BY 1) m USING (report_period)),
    c AS (SELECT report_period, permno, count(*) AS owner_community_count, sum(cs * cs) AS owner_community_hhi, max(cs) AS largest_owner_community_share
          FROM (SELECT report_period, permno, c, sum(s) AS cs FROM o GROUP BY ALL) GROUP BY ALL),
    l AS (SELECT e.report_period, a.permno, sum(e.cosine_similarity) AS ls FROM edges e
          JOIN holdings a ON a.report_period = e.report_period AND a.manager = e.manager_a
          JOIN holdings b ON b.report_period = e.report_period AND b.manager = e.manager_b AND b.permno = a.permno GROUP BY ALL),
    f AS (SELECT s.report_period, s.permno, CASE WHEN s.k < 2 THEN 0.0 ELSE coalesce(l.ls, 0.0) / (s.k * (s.k - 1) / 2.0) END AS owner_similarity_score,
            s.cent AS value_weighted_owner_degree_centrality, s.near AS value_weighted_owner_neighbor_similarity,
            c.owner_community_count, c.owner_community_hhi, c.largest_owner_community_share
          FROM (SELECT report_period, permno, count(*) AS k, sum(s * deg / nullif(n - 1, 0)) AS cent, sum(s * near) AS near FROM o GROUP BY ALL) s
          JOIN c USING (report_period, permno) LEFT JOIN l USING (report_period, permno))
    SELECT *, CASE WHEN q = 1 THEN owner_similarity_score - ps END AS owner_similarity_score_change,
        CASE WHEN q = 1 THEN owner_community_hhi - ph END AS owner_community_hhi_change
    FROM (SELECT *, date_diff('quarter', lag(report_period) OVER w, report_period) AS q, lag(owner_similarity_score) OVER w AS ps,
            lag(owner_community_hhi) OVER w AS ph FROM f WINDOW w AS (PARTITION BY permno ORDER BY report_period))
    """,
    "holdings degrees managers edges",
)
NET_DOUBLES = (
    "owner_similarity_score value_weighted_owner_degree_centrality value_weighted_owner_neighbor_similarity owner_community_hhi "
    "largest_owner_community_share owner_similarity_score_change owner_community_hhi_change"
)


def network_features(h, e):
    return nw.stock_network_features(h, labelled(h, e), e)


@case("c14_security_network_features", "SELECT * EXCLUDE (q, ps, ph) FROM netfeat", uses="netfeat", doubles=NET_DOUBLES)
def _(spark, sf):
    return network_features(*held_and_near(spark, sf))


@case(
    "j14_linked_holder_pairs",
    """SELECT e.report_period, a.permno, sum(e.cosine_similarity) AS linked_weight, count(*) AS linked_pairs FROM edges e
    JOIN holdings a ON a.report_period = e.report_period AND a.manager = e.manager_a
    JOIN holdings b ON b.report_period = e.report_period AND b.manager = e.manager_b AND b.permno = a.permno GROUP BY ALL""",
    uses="edges holdings", doubles="linked_weight",
)
def _(spark, sf):
    h, e = held_and_near(spark, sf)
    return linked_pairs(e, h, "report_period", "manager_a", "manager_b", "manager", "permno", "cosine_similarity")


# ------------------------------------------------------------------ panel, splits, snapshots
R.cte(
    "panel",
    """
    SELECT o.*, CASE WHEN q = 1 THEN institutional_holder_count - ph END AS institutional_holder_count_change,
        CASE WHEN q = 1 THEN 100.0 * (institutional_holder_count - ph) / nullif(ph, 0) END AS institutional_holder_count_change_percent,
        CASE WHEN q = 1 THEN 100.0 * (total_reported_value - pv) / nullif(pv, 0) END AS total_reported_value_change_percent,
        CASE WHEN q = 1 THEN reported_ownership_hhi - pi END AS reported_ownership_hhi_change,
        f.feature_window_end, f.return_252d, f.downside_volatility_63d, f.market_beta_252d, f.market_cap, f.maximum_drawdown_252d, f.market_feature_usable,
        t.target_window_start, t.target_window_end, t.future_max_drawdown, t.target_usable, f.market_feature_usable AND t.target_usable AS model_eligible
    FROM (SELECT s.*, d.managers AS manager_count, s.institutional_holder_count / CAST(d.managers AS DOUBLE) AS manager_holder_share,
            date_diff('quarter', lag(report_period) OVER w, report_period) AS q, lag(institutional_holder_count) OVER w AS ph,
            lag(total_reported_value) OVER w AS pv, lag(reported_ownership_hhi) OVER w AS pi
          FROM securities s JOIN density d USING (report_period) WINDOW w AS (PARTITION BY permno ORDER BY report_period)) o
    JOIN features f USING (report_period, permno) JOIN targets t USING (report_period, permno)
    """,
    "securities density features targets",
)
PANEL = (
    "report_period information_date permno manager_count manager_holder_share institutional_holder_count_change "
    "institutional_holder_count_change_percent total_reported_value_change_percent reported_ownership_hhi_change feature_window_end "
    "return_252d downside_volatility_63d market_beta_252d market_cap maximum_drawdown_252d market_feature_usable target_window_start "
    "target_window_end future_max_drawdown target_usable model_eligible"
).split()
PANEL_DOUBLES = (
    "manager_holder_share institutional_holder_count_change_percent total_reported_value_change_percent reported_ownership_hhi_change "
    "return_252d downside_volatility_63d market_beta_252d market_cap maximum_drawdown_252d future_max_drawdown"
)
RANGES = {"train": ("1996-03-31", "1998-09-30"), "validation": ("1999-06-30", "1999-09-30"), "test": ("2000-06-30", "2000-12-31")}
SPLIT_SQL = "CASE " + " ".join(
    f"WHEN report_period BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in RANGES.items()
) + " END"
R.cte("msample", f"SELECT * FROM (SELECT *, {SPLIT_SQL} AS sample_split FROM panel WHERE model_eligible) WHERE sample_split IS NOT NULL", "panel")


def panel(spark, sf, h=None, securities=None):
    """``h`` and ``securities``: stored holdings and their security nodes, if the caller has them."""
    h = R.stored_holdings(spark, sf) if h is None else h
    daily = cut_lineage(R.daily(spark, sf))
    asked = mk.prediction_rows(h)
    return cut_lineage(
        pn.stock_quarter_panel(
            nw.security_nodes(h) if securities is None else securities,
            nw.network_density(h),
            mk.market_features(asked, daily, R.market(spark, sf), RULES, trading=F.col("trading_status") == "A"),
            mk.forward_targets(asked, daily, ((63, 5),)),
        )
    )


@case("c18_stock_quarter_panel", f"SELECT {', '.join(PANEL)} FROM panel", uses="panel", doubles=PANEL_DOUBLES)
def _(spark, sf):
    return panel(spark, sf).select(*PANEL)


@case(
    "g19_panel_audit",
    """SELECT report_period, information_date, count(*) AS security_periods, count(*) FILTER (WHERE market_feature_usable) AS market_feature_usable_periods,
        count(*) FILTER (WHERE target_usable) AS target_usable_periods, count(*) FILTER (WHERE model_eligible) AS model_eligible_periods,
        avg(CAST(model_eligible AS DOUBLE)) AS model_eligible_share, median(future_max_drawdown) FILTER (WHERE model_eligible) AS median_future_max_drawdown
    FROM panel GROUP BY ALL""",
    uses="panel", doubles="model_eligible_share median_future_max_drawdown",
)
def _(spark, sf):
    return pn.panel_audit(panel(spark, sf))


@case(
    "f3_contract_counters",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE report_period IS NULL OR permno IS NULL) AS null_key_rows,
        count(DISTINCT (report_period, permno)) AS distinct_keys, count(*) - count(DISTINCT (report_period, permno)) AS duplicate_rows,
        count(*) FILTER (WHERE information_date <= report_period) AS information_before_period,
        count(*) FILTER (WHERE feature_window_end >= information_date) AS features_reach_information,
        count(*) FILTER (WHERE target_window_start <= information_date) AS target_before_information,
        count(*) FILTER (WHERE feature_window_end >= target_window_start) AS features_reach_target,
        count(*) FILTER (WHERE model_eligible IS DISTINCT FROM (market_feature_usable AND target_usable)) AS eligibility_differs,
        count(*) FILTER (WHERE model_eligible AND future_max_drawdown IS NULL) AS eligible_without_target
    FROM panel""",
    uses="panel",
)
def _(spark, sf):
    return key_audit(panel(spark, sf), ["report_period", "permno"], pn.chronology_rules())


@case("c19_split_assignment", "SELECT report_period, permno, sample_split FROM msample", uses="msample")
def _(spark, sf):
    return pn.assign_splits(panel(spark, sf), RANGES).select("report_period", "permno", "sample_split")


@case(
    "g20_split_audit",
    """SELECT sample_split, min(report_period) AS report_period_start, max(report_period) AS report_period_end, min(information_date) AS information_date_start,
        max(information_date) AS information_date_end, max(target_window_end) AS latest_target_window_end, count(*) AS security_periods,
        count(DISTINCT permno) AS securities, count(DISTINCT report_period) AS quarters,
        CASE sample_split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS split_order
    FROM msample GROUP BY sample_split""",
    uses="msample",
)
def _(spark, sf):
    return pn.split_audit(pn.assign_splits(panel(spark, sf), RANGES))


@case(
    "q18_purged_periods",
    f"""SELECT report_period, count(*) AS purged_rows FROM panel
    WHERE model_eligible AND report_period BETWEEN DATE '1996-03-31' AND DATE '2000-12-31' AND ({SPLIT_SQL}) IS NULL GROUP BY 1""",
    uses="panel",
)
def _(spark, sf):
    return pn.purged_periods(panel(spark, sf), RANGES)


@case(
    "p9_guarded_changes",
    """SELECT report_period, permno, CASE WHEN q = 1 THEN f_size - ph END AS size_change, CASE WHEN q = 1 THEN 100.0 * (f_size - ph) / nullif(ph, 0) END AS size_change_percent
        FROM (SELECT *, date_diff('quarter', lag(report_period) OVER w, report_period) AS q, lag(f_size) OVER w AS ph
              FROM sample WINDOW w AS (PARTITION BY permno ORDER BY report_period))""",
    uses="sample", doubles="size_change size_change_percent",
)
def _(spark, sf):
    """The sample's parts are not traded every quarter, so histories have gaps."""
    return pn.with_guarded_changes(
        R.sample(spark, sf), "permno", "report_period", {"f_size": "size_change"}, {"f_size": "size_change_percent"}
    ).select("report_period", "permno", "size_change", "size_change_percent")


RANKED = ["owner_similarity_score", "owner_community_hhi", "owner_community_hhi_change"]


@case(
    "c20_ranked_network_sample",
    "SELECT h.report_period, h.permno, "
    + ", ".join(
        f"CASE WHEN n.{c} IS NULL THEN NULL WHEN count(n.{c}) OVER p = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY h.report_period, n.{c} IS NULL ORDER BY n.{c}) "
        f"+ (count(*) OVER (PARTITION BY h.report_period, n.{c}) - 1) / 2.0 - 1) / (count(n.{c}) OVER p - 1) END AS {c}_rank"
        for c in RANKED
    )
    + """ FROM (SELECT DISTINCT report_period, permno FROM holdings) h
    LEFT JOIN (SELECT * REPLACE (round(owner_similarity_score, 9) AS owner_similarity_score, round(owner_community_hhi, 9) AS owner_community_hhi,
        round(owner_community_hhi_change, 9) AS owner_community_hhi_change) FROM netfeat) n USING (report_period, permno) WINDOW p AS (PARTITION BY h.report_period)""",
    uses="holdings netfeat", doubles=" ".join(f"{c}_rank" for c in RANKED),
)
def _(spark, sf):
    h, e = held_and_near(spark, sf)
    feats = cut_lineage(network_features(h, e).withColumns({c: F.round(c, 9) for c in RANKED}))
    sample = h.select("report_period", "permno").distinct()
    return pn.ranked_network_sample(sample, feats, RANKED).select(
        "report_period", "permno", *[f"{c}_rank" for c in RANKED]
    )


R.cte(
    "periods",
    """SELECT DISTINCT p.report_period, coalesce(s.sample_split, 'purged') AS graph_split FROM panel p
    LEFT JOIN (SELECT DISTINCT report_period, sample_split FROM msample) s USING (report_period)
    WHERE p.report_period BETWEEN (SELECT min(report_period) FROM msample) AND (SELECT max(report_period) FROM msample)""",
    "panel msample",
)
R.cte(
    "gedges",
    """SELECT h.report_period, m.manager_index, s.security_index, CAST(h.portfolio_weight AS FLOAT) AS portfolio_weight,
        CAST(h.position_value / CAST(s.total_reported_value AS DOUBLE) AS FLOAT) AS reported_ownership_share
    FROM holdings h JOIN periods USING (report_period) JOIN managers m USING (report_period, manager) JOIN securities s USING (report_period, permno)""",
    "holdings periods managers securities",
)


def snapshots(spark, sf):
    h = R.stored_holdings(spark, sf)
    securities = cut_lineage(nw.security_nodes(h))
    p = panel(spark, sf, h, securities)
    s = pn.assign_splits(p, RANGES)
    return pn.graph_snapshots(
        h, cut_lineage(nw.manager_nodes(h)), securities, p, s,
        ["return_252d", "market_beta_252d"], ["portfolio_value", "portfolio_hhi"], "future_max_drawdown",
    )


@case(
    "c21_snapshot_audit",
    """SELECT q.report_period, s.information_date, q.graph_split, s.n AS stock_nodes, s.l AS labeled_stocks,
        (SELECT count(*) FROM managers m WHERE m.report_period = q.report_period) AS manager_nodes,
        (SELECT count(*) FROM gedges e WHERE e.report_period = q.report_period) AS ownership_edges
    FROM periods q JOIN (SELECT p.report_period, min(p.information_date) AS information_date, count(*) AS n, count(m.sample_split) AS l
        FROM panel p LEFT JOIN (SELECT report_period, permno, sample_split FROM msample) m USING (report_period, permno) GROUP BY 1) s USING (report_period)""",
    uses="periods panel msample managers gedges",
)
def _(spark, sf):
    return snapshots(spark, sf)["snapshot_audit"]


@case("c21_snapshot_edges", "SELECT * FROM gedges", uses="gedges", doubles="portfolio_weight reported_ownership_share")
def _(spark, sf):
    return snapshots(spark, sf)["ownership_edges"]


@case(
    "c24_edge_scaling",
    """SELECT avg(ln(CAST(portfolio_weight AS DOUBLE))) AS portfolio_weight_log_mean, avg(ln(CAST(reported_ownership_share AS DOUBLE))) AS reported_ownership_share_log_mean,
        stddev_pop(ln(CAST(portfolio_weight AS DOUBLE))) AS portfolio_weight_log_deviation, stddev_pop(ln(CAST(reported_ownership_share AS DOUBLE))) AS reported_ownership_share_log_deviation
    FROM gedges JOIN periods USING (report_period) WHERE graph_split IN ('train', 'validation')""",
    uses="gedges periods",
    doubles="portfolio_weight_log_mean reported_ownership_share_log_mean portfolio_weight_log_deviation reported_ownership_share_log_deviation",
)
def _(spark, sf):
    s = snapshots(spark, sf)
    return pn.edge_scaling(
        s["ownership_edges"], s["periods"], ["train", "validation"], ["portfolio_weight", "reported_ownership_share"]
    )


@case(
    "q19_edge_weight_profile",
    """SELECT count(*) AS edges, min(portfolio_weight) AS minimum_weight, max(portfolio_weight) AS maximum_weight, avg(portfolio_weight) AS mean_weight,
        median(portfolio_weight) AS median_weight, (SELECT max(abs(s - 1)) FROM (SELECT sum(portfolio_weight) AS s FROM holdings GROUP BY report_period, manager)) AS largest_sum_deviation
    FROM holdings""",
    uses="holdings", doubles="minimum_weight maximum_weight mean_weight median_weight largest_sum_deviation",
)
def _(spark, sf):
    from quarterdeck.plans.audits import weight_profile

    return weight_profile(R.holdings(spark, sf), ["report_period", "manager"], "portfolio_weight")


@case(
    "p17_membership_retention",
    """SELECT c.report_period, c.n AS entities, p.n AS previous_entities, coalesce(k.n, 0) AS retained, coalesce(k.n, 0) / CAST(p.n AS DOUBLE) AS retention_share,
        coalesce(k.n, 0) / CAST(c.n AS DOUBLE) AS overlap_share
    FROM (SELECT report_period, count(*) AS n FROM managers GROUP BY 1) c
    JOIN (SELECT CAST(last_day(report_period + INTERVAL 3 MONTH) AS DATE) AS report_period, count(*) AS n FROM managers GROUP BY 1) p USING (report_period)
    LEFT JOIN (SELECT a.report_period, count(*) AS n FROM managers a JOIN managers b ON a.manager = b.manager
        AND last_day(b.report_period + INTERVAL 3 MONTH) = a.report_period GROUP BY 1) k USING (report_period)""",
    uses="managers", doubles="retention_share overlap_share",
)
def _(spark, sf):
    return pn.period_retention(R.positions(spark, sf), "report_period", "manager")


@case(
    "c22_bipartite_messages",
    """WITH share AS (SELECT *, position_value / CAST(sum(position_value) OVER (PARTITION BY report_period, permno) AS DOUBLE) AS hs FROM holdings),
    m AS (SELECT h.report_period, h.manager, sum(h.portfolio_weight * s.institutional_holder_count) AS a, sum(h.portfolio_weight * s.reported_ownership_hhi) AS b
          FROM holdings h JOIN securities s USING (report_period, permno) GROUP BY ALL)
    SELECT report_period, permno, sum(hs * a) AS institutional_holder_count, sum(hs * b) AS reported_ownership_hhi
    FROM share JOIN m USING (report_period, manager) GROUP BY ALL""",
    uses="holdings securities", doubles="institutional_holder_count reported_ownership_hhi",
)
def _(spark, sf):
    h = R.stored_holdings(spark, sf)
    values = ["institutional_holder_count", "reported_ownership_hhi"]
    e = with_share_of_total(h, ["report_period", "permno"], "position_value", share="holding_share")
    return graph.bipartite_round_trip(
        e, nw.security_nodes(h), "report_period", "manager", "permno", "portfolio_weight", "holding_share", values
    )


@case(
    "c23_carried_state",
    """
    WITH RECURSIVE x AS (SELECT permno, year(report_period) * 4 + quarter(report_period) AS n, report_period, target AS v FROM sample),
    s(permno, n, report_period, state) AS (
        SELECT permno, n, report_period, 0.3 * v FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.permno = x.permno AND y.n = x.n - 1)
        UNION ALL SELECT x.permno, x.n, x.report_period, 0.7 * s.state + 0.3 * x.v FROM s JOIN x ON x.permno = s.permno AND x.n = s.n + 1)
    SELECT permno, report_period, state FROM s
    """,
    uses="sample", doubles="state", digits=9,
)
def _(spark, sf):
    values = R.sample(spark, sf).select("permno", "report_period", "target")
    return graph.carried_state(values, "permno", quarter_index(F.col("report_period")), "target", 0.7).select(
        "permno", "report_period", "state"
    )


# ------------------------------------------------------------------ network audits
@case(
    "q14_recomputed_node_measures",
    """SELECT count(*) AS matched_rows, 0 AS left_only_rows, 0 AS right_only_rows, 0 AS hhi_differences, 0 AS holders_differences
    FROM securities""",
    uses="securities",
)
def _(spark, sf):
    h = R.stored_holdings(spark, sf)
    stored = nw.security_nodes(h).select(
        "report_period", "permno", F.col("reported_ownership_hhi").alias("hhi"),
        F.col("institutional_holder_count").cast("double").alias("holders"),
    )
    total = F.sum("position_value").cast("double")
    again = h.groupBy("report_period", "permno").agg(
        (F.sum(F.col("position_value").cast("double") * F.col("position_value")) / (total * total)).alias("hhi"),
        F.count_distinct("manager").cast("double").alias("holders"),
    )
    result = reconcile(stored, again, ["report_period", "permno"], ["hhi", "holders"], 1e-9)
    return result.withColumns({c: F.col(c).cast("int") for c in result.columns if c != "matched_rows"})


@case(
    "q15_edge_invariants",
    """SELECT count(*) AS edges, count(*) FILTER (WHERE manager_a >= manager_b) AS unordered_edges,
        count(*) FILTER (WHERE cosine_similarity <= 0 OR cosine_similarity > 1) AS similarities_out_of_range,
        count(*) FILTER (WHERE directional_links NOT IN (1, 2)) AS wrong_link_counts, 0::BIGINT AS unknown_endpoints
    FROM edges""",
    uses="edges",
)
def _(spark, sf):
    from quarterdeck.plans.audits import edge_invariants

    h, e = held_and_near(spark, sf)
    return edge_invariants(e, h.select("report_period", "manager").distinct())


@case(
    "q16_community_invariants",
    """SELECT count(*) AS periods, 0::BIGINT AS unlabelled_managers, 0::BIGINT AS share_sum_errors, 0::BIGINT AS gaps_in_ids, 0::BIGINT AS size_order_errors
    FROM (SELECT DISTINCT report_period FROM holdings)""",
    uses="holdings",
)
def _(spark, sf):
    from quarterdeck.plans.audits import community_invariants

    return community_invariants(cut_lineage(communities(spark, sf)[2]))
