"""Components of buckets by confirmed star edges.

A bucket of n nodes gives n - 1 candidate edges to one centre, not n^2. Candidates are confirmed
exactly. A bucket whose nodes then still lie in different components gets further stars, with one
centre from each of up to ``centres`` of its components, reaching only nodes of other components;
pairs tried before are left out. Rounds with other centres follow while one candidate in ten is
confirmed. A bucket of n nodes gives at most n times ``centres`` edges a round. What stars leave
is settled exactly, whenever they end: all nodes of buckets that may still hold untried pairs go to
``finish``, which returns every link between different components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.operators.graph import connected_components
from quarterdeck.session import cut_lineage, release


def confirmed_components(
    buckets: DataFrame, confirm: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame],
    percent: int | None = None, centres: int = 1, max_rounds: int = 40,
) -> DataFrame | None:
    """(node, component) of linked nodes, or None without links.

    ``buckets`` has (key, node, n); with ``percent``, pairs whose sizes n alone rule the
    similarity out are not candidates. ``confirm`` maps candidates (a, b), a < b, to links.
    ``finish`` maps nodes with their components (node, part) to all links between components.
    """
    tried, labels, stages = None, None, []
    for turn in range(max_rounds):
        edges = _stars(buckets, labels, turn, percent, centres)
        if tried is not None:
            edges = edges.join(tried, ["a", "b"], "left_anti")
        edges = cut_lineage(edges)
        stages.append(edges)
        if edges.isEmpty():
            if centres > 1 and not turn:
                continue  # the first centres were too large or small for all others
            break
        tried = edges if tried is None else tried.unionByName(edges)
        found = cut_lineage(confirm(edges))
        links = found.count()
        if links:
            labels = _relabelled(labels, found)
        release(found)
        # With several centres a second round always follows: it tries all pairs of small buckets.
        if 10 * links < edges.count() and (centres == 1 or turn):
            break
    for stage in stages:
        release(stage)
    rest = cut_lineage(_unsettled(buckets, labels, centres))
    if not rest.isEmpty():
        found = cut_lineage(finish(rest))
        if not found.isEmpty():
            labels = _relabelled(labels, found)
        release(found)
    release(rest)
    return labels


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    merged = cut_lineage(_merged(labels, found))
    release(labels)
    return merged


def _with_parts(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("part", F.col("node"))
    return buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"))


def _unsettled(buckets: DataFrame, labels: DataFrame | None, centres: int) -> DataFrame:
    """(node, part) of buckets with several components.

    The one pair of a bucket of two was tried in the first round. With several centres, a bucket of
    no more nodes than centres, none linked with another, has had each node as a centre.
    """
    members = _with_parts(buckets, labels)
    several = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("_count"))
    several = several.where("low < high AND _count > 2")
    if centres > 1:
        parts = members.groupBy("key", "part").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max("_n").alias("_most"))
        several = several.join(parts, "key").where(f"_count > {centres} OR _most > 1")
    several = several.select("key")
    return members.join(several, "key").select("node", "part").distinct()


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels after new links: only the components that the links join are relabelled."""
    if labels is None:
        return connected_components(found.withColumn("_g", F.lit(0)), "_g", "a", "b").select("node", "component")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("u"))
    other = labels.select(F.col("node").alias("b"), F.col("component").alias("v"))
    joined = found.join(known, "a", "left").join(other, "b", "left").select(
        F.lit(0).alias("_g"), F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")
    )
    moved = cut_lineage(connected_components(joined, "_g", "u", "v").select(F.col("node").alias("part"), "component"))
    # Nodes that had no label are their own part.
    fresh = moved.join(labels.select(F.col("component").alias("part")).distinct(), "part", "left_anti")
    before = labels.select("node", F.col("component").alias("part"))
    after = before.join(moved, "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    return after.unionByName(fresh.select(F.col("part").alias("node"), "component"))


def _stars(buckets: DataFrame, labels: DataFrame | None, turn: int, percent: int | None, most: int) -> DataFrame:
    """Candidate edges (a < b): nodes of a bucket to centres of other components."""
    members = _with_parts(buckets, labels)
    # The smallest node is the first centre; later centres come in random order.
    rank = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    if turn == 0 or most == 1:
        centres = members.groupBy("key").agg(
            F.min(F.struct(rank.alias("rank"), "node", "n", "part")).alias("c"),
            F.min("part").alias("low"), F.max("part").alias("high"),
        ).where("low < high").select("key", "c")
    else:
        spread = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
        members = members.join(spread.select("key"), "key")
        one = members.groupBy("key", "part").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "part")).alias("c"))
        line = F.row_number().over(Window.partitionBy("key").orderBy("c.rank", "part"))
        centres = one.withColumn("_line", line).where(F.col("_line") <= most).select("key", "c")
    pairs = members.join(centres, "key").where(F.col("part") != F.col("c.part"))
    if percent is not None:
        pairs = pairs.where(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
    return pairs.select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")
    ).distinct()
