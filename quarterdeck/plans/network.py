"""Ownership networks, manager similarity, communities and security-level network features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.functions import order
from quarterdeck.functions.dates import quarters_between
from quarterdeck.operators import graph
from quarterdeck.operators.aggregates import top_share, with_share_of_total
from quarterdeck.operators.joins import linked_pairs
from quarterdeck.session import as_stored, stored

NEIGHBOR_COUNTS = (10, 25, 50)
BASELINE_NEIGHBORS = 25


def manager_nodes(holdings: DataFrame) -> DataFrame:
    """Managers per period with portfolio size, concentration and a dense index."""
    stats = holdings.groupBy("report_period", "information_date", "manager").agg(
        F.sum("position_value").alias("portfolio_value"),
        F.count(F.lit(1)).alias("security_count"),
        F.max("portfolio_weight").alias("largest_position_weight"),
        F.sum(F.pow("portfolio_weight", F.lit(2.0))).alias("portfolio_hhi"),
    )
    return order.with_dense_index(stats, ["report_period"], "manager", "manager_index")


def security_nodes(holdings: DataFrame, top: int = 5) -> DataFrame:
    """Securities per period with holder counts and ownership concentration."""
    keys = ["report_period", "permno"]
    shares = stored(with_share_of_total(holdings, keys, "position_value", share="holding_share"))
    stats = shares.groupBy("report_period", "information_date", "permno").agg(
        F.count_distinct("manager").alias("institutional_holder_count"),
        F.sum("position_value").alias("total_reported_value"),
        F.sum(F.pow("holding_share", F.lit(2.0))).alias("reported_ownership_hhi"),
        F.avg("portfolio_weight").alias("mean_owner_portfolio_weight"),
        F.max("portfolio_weight").alias("maximum_owner_portfolio_weight"),
    )
    best = top_share(shares, keys, "holding_share", "manager", top, "top_five_reported_ownership_share")
    return order.with_dense_index(
        stats.join(best, keys, "left"), ["report_period"], "permno", "security_index"
    )


def network_density(holdings: DataFrame) -> DataFrame:
    """Node counts, edges and bipartite density per period."""
    # Rows are moved once: all of a manager's, which are then made distinct and counted in place.
    edges = holdings.select("report_period", "information_date", "manager", "permno").repartition(
        "report_period", "manager"
    ).distinct()
    per_manager = edges.groupBy("report_period", "information_date", "manager").agg(F.count(F.lit(1)).alias("_n"))
    managers = per_manager.groupBy("report_period", "information_date").agg(
        F.count(F.lit(1)).alias("managers"), F.sum("_n").alias("ownership_edges")
    )
    securities = (
        holdings.groupBy("report_period", "permno").agg(F.lit(1).alias("_one"))
        .groupBy("report_period").agg(F.count(F.lit(1)).alias("securities"))
    )
    return managers.join(securities, "report_period").withColumn(
        "bipartite_density",
        F.col("ownership_edges") / (F.col("managers").cast("double") * F.col("securities")),
    )


def network_components(holdings: DataFrame) -> DataFrame:
    """Connected components of the bipartite graph: count and largest share of nodes.

    Managers and securities share one id space: securities on even, managers on odd numbers.
    """
    edges = holdings.select(
        "report_period",
        (F.col("manager").cast("bigint") * 2 + 1).alias("m"),
        (F.col("permno").cast("bigint") * 2).alias("s"),
    )
    labels = graph.connected_components(edges, "report_period", "m", "s")
    sizes = labels.groupBy("report_period", "component").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.groupBy("report_period").agg(
        F.count(F.lit(1)).alias("connected_components"),
        F.max("nodes").alias("largest_component_nodes"),
        (F.max("nodes") / F.sum("nodes")).alias("largest_component_share"),
    )


def network_summary(holdings: DataFrame) -> DataFrame:
    return network_density(holdings).join(network_components(holdings), "report_period")


def similarity_neighbors(
    holdings: DataFrame, neighbors: int = max(NEIGHBOR_COUNTS), weight: str = "portfolio_weight", **tiling
) -> DataFrame:
    """Nearest managers by portfolios; values of positions give the same similarities as their weights."""
    return graph.cosine_neighbors(holdings, "report_period", "manager", "permno", weight, neighbors, **tiling)


def similarity_edges(directed: DataFrame, neighbors: int = BASELINE_NEIGHBORS) -> DataFrame:
    return graph.undirected_union(directed, "report_period", [neighbors])


def similarity_audit(
    directed: DataFrame, managers: DataFrame, neighbor_counts: Sequence[int] = NEIGHBOR_COUNTS
) -> DataFrame:
    """Edges, mutual share, isolation, similarity level and density for each neighbour count."""
    # A pair is stored once, whatever the number of counts; the counts are listed in place.
    pairs = stored(graph.neighbor_pairs(directed, "report_period"))
    edges = as_stored(graph.pairs_by_count(pairs, "report_period", neighbor_counts), pairs)
    keys = ["report_period", "k_neighbors"]
    stats = edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("undirected_edges"),
        F.count(F.when(F.col("is_mutual_neighbor"), F.lit(1))).alias("mutual_edges"),
        F.avg("cosine_similarity").alias("mean_similarity"),
    )
    medians = order.exact_quantiles(edges, keys, "cosine_similarity", {"median_similarity": 0.5})
    # A manager is connected from the least rank on that any of its pairs has.
    nearest = graph.endpoints(
        pairs.withColumn("_rank", F.least("forward_rank", "backward_rank")), ["report_period", "_rank"], "manager_a", "manager_b"
    ).groupBy("report_period", "node").agg(F.min("_rank").alias("_rank"))
    k = F.explode(F.array(*[F.lit(int(n)) for n in neighbor_counts])).alias("k_neighbors")
    connected = nearest.select("report_period", "_rank", k).where("_rank <= k_neighbors").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("connected_managers")
    )
    counts = managers.groupBy("report_period").agg(F.count(F.lit(1)).alias("manager_count"))
    n = F.col("manager_count").cast("double")
    return (
        stats.join(medians, keys).join(connected, keys).join(counts, "report_period")
        .select(
            *keys,
            "undirected_edges",
            "mutual_edges",
            (F.col("mutual_edges") / F.col("undirected_edges")).alias("mutual_edge_share"),
            "connected_managers",
            (F.col("manager_count") - F.col("connected_managers")).alias("isolated_managers"),
            "mean_similarity",
            "median_similarity",
            (2 * F.col("undirected_edges") / F.nullif(n * (n - 1), F.lit(0.0))).alias("projected_density"),
        )
    )


def with_similarity_degrees(managers: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and mean neighbour similarity per manager, zero when isolated."""
    # Stored, so that the shuffles that made the edges end before those of the degrees.
    edges = stored(edges)
    degrees = graph.node_degrees(
        edges, "report_period", "manager_a", "manager_b", "cosine_similarity"
    ).withColumnRenamed("node", "manager")
    return managers.join(degrees, ["report_period", "manager"], "left").withColumns(
        {
            "similarity_degree": F.coalesce("similarity_degree", F.lit(0)),
            "mean_neighbor_similarity": F.coalesce("mean_neighbor_similarity", F.lit(0.0)),
        }
    )


def detect_communities(managers: DataFrame, edges: DataFrame, **settings) -> DataFrame:
    """Managers with degree, neighbour similarity and community."""
    labels = graph.modularity_communities(
        managers, edges, "report_period", "manager", "manager_a", "manager_b",
        "cosine_similarity", **settings,
    ).withColumnRenamed("node", "manager")
    return with_similarity_degrees(managers, edges).join(labels, ["report_period", "manager"], "left")


def community_summary(labelled: DataFrame) -> DataFrame:
    """Size, share, value and mean measures per community and period."""
    keys = ["report_period", "community_id"]
    stats = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("manager_count"),
        F.sum("portfolio_value").alias("total_portfolio_value"),
        F.avg("security_count").alias("mean_security_count"),
        F.avg("largest_position_weight").alias("mean_largest_position_weight"),
        F.avg("portfolio_hhi").alias("mean_portfolio_hhi"),
        F.avg("similarity_degree").alias("mean_similarity_degree"),
    )
    medians = order.exact_quantiles(labelled, keys, "portfolio_value", {"median_portfolio_value": 0.5})
    return with_share_of_total(
        stats.join(medians, keys), ["report_period"], "manager_count", share="manager_share"
    )


def community_meta_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Number and mean similarity of the edges between different communities."""
    edges, labels = stored(edges), stored(labels)
    a = labels.select("report_period", F.col("manager").alias("manager_a"), F.col("community_id").alias("_a"))
    b = labels.select("report_period", F.col("manager").alias("manager_b"), F.col("community_id").alias("_b"))
    return (
        edges.join(a, ["report_period", "manager_a"]).join(b, ["report_period", "manager_b"])
        .where(F.col("_a") != F.col("_b"))
        .groupBy("report_period", F.least("_a", "_b").alias("community_a"), F.greatest("_a", "_b").alias("community_b"))
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg("cosine_similarity").alias("mean_similarity"))
    )


def stock_network_features(holdings: DataFrame, labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """Owner similarity, centrality and community concentration per security, with changes."""
    keys = ["report_period", "permno"]
    labelled = stored(labelled)
    counts = labelled.groupBy("report_period").agg(F.count(F.lit(1)).alias("_managers"))
    owners = holdings.select(*keys, "manager", "position_value").join(
        labelled.select("report_period", "manager", "similarity_degree", "mean_neighbor_similarity", "community_id"),
        ["report_period", "manager"],
    )
    # Owners are combined per community first; totals, shares and summaries are then small.
    value = F.col("position_value").cast("double")
    communities = with_share_of_total(
        owners.groupBy(*keys, "community_id").agg(
            F.count(F.lit(1)).alias("_owners"),
            F.sum("position_value").alias("_value"),
            F.sum(value * F.col("similarity_degree")).alias("_degree"),
            F.sum(value * F.col("mean_neighbor_similarity")).alias("_near"),
        ),
        keys, "_value", share="_share", total="_total",
    )
    total = F.nullif("_total", F.lit(0))
    summary = communities.groupBy(*keys).agg(
        F.sum("_owners").alias("owner_count"),
        F.sum(F.col("_degree") / total).alias("_degree"),
        F.sum(F.col("_near") / total).alias("value_weighted_owner_neighbor_similarity"),
        F.count(F.lit(1)).alias("owner_community_count"),
        F.sum(F.pow("_share", F.lit(2.0))).alias("owner_community_hhi"),
        F.max("_share").alias("largest_owner_community_share"),
    )
    linked = linked_pairs(
        edges, holdings, "report_period", "manager_a", "manager_b", "manager", "permno", "cosine_similarity"
    )
    n = F.col("owner_count").cast("double")
    static = (
        summary.join(counts, "report_period").join(linked, keys, "left")
        .withColumns(
            {
                "value_weighted_owner_degree_centrality": F.col("_degree")
                / F.nullif(F.col("_managers") - 1, F.lit(0)),
                "owner_similarity_score": F.when(F.col("owner_count") < 2, F.lit(0.0)).otherwise(
                    F.coalesce("linked_weight", F.lit(0.0)) / F.nullif(n * (n - 1) / 2.0, F.lit(0.0))
                ),
            }
        )
    )
    history = Window.partitionBy("permno").orderBy("report_period")
    consecutive = quarters_between(F.lag("report_period").over(history), F.col("report_period")) == 1

    def change(name: str):
        return F.when(consecutive, F.col(name) - F.lag(name).over(history))

    return static.select(
        *keys,
        "owner_similarity_score",
        "value_weighted_owner_degree_centrality",
        "value_weighted_owner_neighbor_similarity",
        "owner_community_count",
        "owner_community_hhi",
        "largest_owner_community_share",
        change("owner_similarity_score").alias("owner_similarity_score_change"),
        change("owner_community_hhi").alias("owner_community_hhi_change"),
    )
