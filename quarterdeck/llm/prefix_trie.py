"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A trie node is a distinct sequence of first turns. Sequences are named by sums of hashed (place,
turn) pairs in two lanes of 60 bits, so prefixes of conversations of any length come from running
sums in blocks, and a node's parent is known without a join (two different sequences share a name
with probability about n^2 / 2^121).

Subtree totals are not passed from level to level, which would take a round per turn. Each round
finds the centroid of every component of the parent-edge forest, the deepest node that carries
half of the component's mass or more. The mass of a node is the number of (conversation, place)
pairs below it; it is positive at every node and known from one grouped sum. The part below the
centroid is summed (its total), the total is added to all nodes on the path from the centroid to
the component's top, and the component falls apart into the parts below the centroid's children
and the rest. No part has more than half of the mass, so rounds grow with the logarithm of the
number of turns, and a node is added to at most once a round. Components of a few thousand nodes
are finished inside a task, by the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.llm.tables import prepare
from quarterdeck.session import cut_lineage, release

_LANE = 1 << 60
_BLOCK = 1024
_CHUNK_BYTES = 1 << 16
#: Components of at most this many nodes are finished in one task.
TASK_NODES = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): turns numbered from 1 in each conversation, stored.

    Turns are ordered by turn (null first), ties by role and text. Null roles and texts count as
    empty; rows with a null conv_id take no part. A conversation of any length is dealt over tasks.
    """
    prepare(conversations.sparkSession)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"))
    dealt = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    framed = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    # The id of a row grows along the sorted partition and from partition to partition.
    lined = cut_lineage(
        dealt.select(
            "conv_id", F.monotonically_increasing_id().alias("line"), F.sha2(framed, 256).alias("digest"),
            F.length("text").cast("long").alias("chars"),
        )
    ).withColumn("part", F.shiftright("line", 33))
    runs = lined.groupBy("conv_id", "part").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    numbered = cut_lineage(
        lined.join(runs.select("conv_id", "part", "first", "before"), ["conv_id", "part"]).select(
            "conv_id", (F.col("line") - F.col("first") + F.col("before") + 1).alias("place"), "digest", "chars"
        )
    )
    release(lined)
    return numbered


def share_openings(turns: DataFrame, span: int = 100, choices: int = 6) -> DataFrame:
    """(conv_id, place, digest, chars, length) of rebuilt conversations, with a row of place 0 each.

    A conversation c takes its first h turns from conversation c - c % span and keeps its own turns
    after its first h; h is the unsigned crc32 of c's decimal digits, modulo ``choices``.
    """
    own = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    first = F.struct("place", "digest", "chars")
    heads = turns.where((F.col("conv_id") % span == 0) & (F.col("place") < choices)).groupBy(
        F.col("conv_id").alias("base")
    ).agg(F.array_sort(F.collect_list(first)).alias("opening"))  # fewer than ``choices`` turns
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices).cast("int")
    plans = own.select("conv_id", "own", cut.alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    plans = plans.join(heads, "base", "left")
    taken = F.least("h", F.greatest(F.size("opening"), F.lit(0)))
    plans = cut_lineage(
        plans.select(
            "conv_id", "h", taken.alias("taken"), F.slice("opening", 1, F.greatest(taken, F.lit(0))).alias("opening"),
            (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"),
        )
    )
    opened = plans.select("conv_id", "length", F.explode("opening").alias("o")).select("conv_id", "o.*", "length")
    kept = turns.join(plans.select("conv_id", "h", "taken", "length"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "chars", "length"
    )
    return _tops(plans).unionByName(opened.select("conv_id", "place", "digest", "chars", "length")).unionByName(kept)


def with_length(turns: DataFrame) -> DataFrame:
    """The rows of ``ordered_turns`` as they are, in the form that ``prefix_trie`` takes."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    return _tops(lengths).unionByName(turns.join(lengths, "conv_id").select("conv_id", "place", "digest", "chars", "length"))


def _tops(lengths: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    return lengths.select("conv_id", none.alias("place"), F.lit("").alias("digest"), none.alias("chars"), "length")


def _lane(number: int) -> Column:
    named = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")), 256)
    lane = F.conv(F.substring(named, 1 + 15 * number, 15), 16, 10).cast("long")
    return F.when(F.col("place") > 0, lane).otherwise(F.lit(0).cast("long"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds to each turn the two-lane name of the prefix it ends (p1, p2) and of the one before (q1, q2)."""
    wide = "decimal(38,0)"
    rows = turns.select("*", _lane(0).alias("f1"), _lane(1).alias("f2"), F.expr(f"place div {_BLOCK}").alias("block"))
    rows = cut_lineage(rows)
    inner = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where(F.col("length") >= _BLOCK).groupBy("conv_id", "block").agg(
        *[F.sum(F.col(f"f{i}").cast(wide)).alias(f"t{i}") for i in (1, 2)]
    )
    carry = blocks.select("conv_id", "block", *[F.sum(f"t{i}").over(earlier).cast(wide).alias(f"c{i}") for i in (1, 2)])
    rows = rows.select("*", *[F.sum(F.col(f"f{i}").cast(wide)).over(inner).alias(f"s{i}") for i in (1, 2)])
    rows = rows.join(carry.where("block > 0"), ["conv_id", "block"], "left")

    def name(i: int, own: bool) -> Column:
        total = F.col(f"s{i}").cast(wide) + F.coalesce(f"c{i}", F.lit(0).cast(wide))
        if not own:
            total = total - F.col(f"f{i}").cast(wide)
        return F.pmod(total.cast(wide), F.lit(_LANE).cast(wide)).cast("long")

    return rows.select(
        "conv_id", "place", "chars", "length",
        *[name(i, True).alias(f"p{i}") for i in (1, 2)], *[name(i, False).alias(f"q{i}") for i in (1, 2)],
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of runs of sorted rows (node, conv_id), in pieces of bounded size."""
    node, first, parts, size = None, None, [], 0

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(parts).encode()])],
            ["node", "first", "ids"],
        )

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if parts and (n != node or size > _CHUNK_BYTES):
                yield out()
                parts, size = [], 0
            if not parts:
                node, first = n, c
            parts.append(str(c))
            size += len(parts[-1]) + 1
    if parts:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, read in order; nothing but the running hash is held."""
    node, state = None, None
    for batch in batches:
        nodes, hashes = [], []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
            if n != node:
                if state is not None:
                    nodes.append(node)
                    hashes.append(state.hexdigest())
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def ordered_digest(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the comma-joined conv_ids of each node in ascending order.

    Ids are sorted over all tasks and packed into pieces of 64 KB first, so that a node with a
    third of all conversations gives one task its few pieces and never its ids as rows.
    """
    sorted_rows = members.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = sorted_rows.mapInArrow(_chunks, "node long, first long, ids binary")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node long, ends_sha256 string")


def _component_sums(parent: list[int], mass: list[int], values: list[list[int]], added: list[list[int]]) -> None:
    """Turn ``added`` into subtree totals of a component whose nodes come with parents first.

    ``parent`` holds places in the component, -1 at the top.
    """
    open_ = [list(range(len(parent)))]
    while open_:
        part = open_.pop()
        half = mass[part[0]]
        centroid = next(u for u in reversed(part) if 2 * mass[u] >= half)
        inside, rest = {centroid: None}, []
        below: dict[int, list[int]] = {}
        for u in part:
            up = parent[u]
            if u == centroid:
                continue
            if up == centroid:
                inside[u] = u
                below[u] = [u]
            elif up in inside:
                inside[u] = inside[up]
                below[inside[u]].append(u)
            else:
                rest.append(u)
        totals = [sum(v[u] for u in inside) for v in values]
        if rest:
            lost, top, u = mass[centroid], part[0], centroid
            while u != top:
                u = parent[u]
                mass[u] -= lost
                for a, t in zip(added, totals, strict=True):
                    a[u] += t
            open_.append(rest)
        for a, t in zip(added, totals, strict=True):
            a[centroid] += t
        open_.extend(below.values())


def _small_components(names: list[str]):
    def solve(rows: pa.Table) -> pa.RecordBatch:
        node = rows.column("node").to_pylist()
        at = {n: i for i, n in enumerate(node)}
        # Parents outside the component are those of its top.
        parent = [at.get(p, -1) for p in rows.column("parent").to_pylist()]
        added = [rows.column(f"a_{n}").to_pylist() for n in names]
        _component_sums(parent, rows.column("mass").to_pylist(), [rows.column(n).to_pylist() for n in names], added)
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int64()), *[pa.array(a, pa.int64()) for a in added]], ["node", *names]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tops = batch.column("top").to_numpy()
            cuts = [0, *(np.flatnonzero(tops[1:] != tops[:-1]) + 1).tolist(), len(tops)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[-1].column("top")[0].as_py() != tops[a]:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def centroid_rollup(nodes: DataFrame, paths: DataFrame, names: list[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, *names): subtree totals of the columns ``names`` over a forest, stored.

    ``nodes`` has (node, parent, depth, rep, mass, *names); ``mass`` is the sum of any positive
    weights over the node's subtree. ``paths`` has (conv_id, place, node, parent), the nodes on the
    way to each ``rep``. Both are stored tables.
    """
    keep = ["node", "parent", "depth", "rep", "mass", *names, *[f"a_{n}" for n in names]]
    roots = paths.where("place = 0").select(F.col("conv_id").alias("rep"), F.col("node").alias("top"))
    state = cut_lineage(nodes.join(roots, "rep").select("*", *[F.lit(0).cast("long").alias(f"a_{n}") for n in names]))
    small, solved, stages = [], [], []
    while True:
        sums = state.groupBy("top").agg(
            F.max("mass").alias("total"), F.min("depth").alias("top_depth"), F.count("*").alias("n")
        )
        sized = cut_lineage(state.join(sums, "top"))
        release(state)
        stages.append(sized)
        small.append(sized.where(F.col("n") <= task_nodes).select("top", *keep))
        big = sized.where(F.col("n") > task_nodes)
        centroids = cut_lineage(
            big.where("2 * mass >= total").groupBy("top").agg(
                F.max(F.struct("depth", "node", "rep", "mass")).alias("c"), F.first("top_depth").alias("top_depth")
            ).select(
                "top", "top_depth", F.col("c.depth").alias("c_depth"), F.col("c.node").alias("c_node"),
                F.col("c.rep").alias("c_rep"), F.col("c.mass").alias("c_mass"),
            )
        )
        if centroids.isEmpty():
            release(centroids)
            break
        # A node lies below the centroid if its own way from the top passes a child of the centroid.
        steps = paths.select(
            F.col("conv_id").alias("rep"), F.col("place").alias("c_place"), F.col("node").alias("child"), F.col("parent").alias("over")
        )
        placed = big.join(centroids.drop("top_depth"), "top").withColumn("c_place", F.col("c_depth") + 1)
        deep = placed.where("depth > c_depth").join(steps, ["rep", "c_place"])
        placed = cut_lineage(
            placed.where("depth <= c_depth").withColumn("child", F.lit(None).cast("long")).unionByName(
                deep.withColumn("child", F.when(F.col("over") == F.col("c_node"), F.col("child"))).drop("over")
            )
        )
        inside = placed.where("child IS NOT NULL OR node = c_node")
        totals = inside.groupBy("top").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
        totals = cut_lineage(centroids.join(totals, "top"))
        release(centroids)
        way = paths.select(F.col("conv_id").alias("c_rep"), "place", "node").join(totals, "c_rep").where(
            "place >= top_depth AND place < c_depth"
        ).select("node", F.col("c_mass").alias("lost"), *[f"t_{n}" for n in names])
        moved = placed.where("node != c_node").join(way, "node", "left").select(
            F.coalesce("child", "top").alias("top"), "node", "parent", "depth", "rep",
            (F.col("mass") - F.coalesce("lost", F.lit(0))).alias("mass"), *names,
            *[(F.col(f"a_{n}") + F.coalesce(f"t_{n}", F.lit(0))).alias(f"a_{n}") for n in names],
        )
        found = placed.where("node = c_node").join(totals.select("top", *[f"t_{n}" for n in names]), "top")
        solved.append(cut_lineage(found.select("node", *[(F.col(f"a_{n}") + F.col(f"t_{n}")).alias(n) for n in names])))
        state = cut_lineage(moved)
        release(placed)
        release(totals)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    fields = ", ".join(f"{n} long" for n in names)
    finished = rest.repartition("top").sortWithinPartitions("top", "depth").mapInArrow(
        _small_components(names), f"node long, {fields}"
    )
    for more in solved:
        finished = finished.unionByName(more)
    finished = cut_lineage(finished)
    for stage in [*stages, *solved]:
        release(stage)
    return finished


def prefix_trie(turns: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """A row per distinct sequence of first turns, with totals over its subtree.

    ``turns`` has (conv_id, place, digest, chars, length): gapless places from 1 and one row of
    place 0 for each conversation. Columns out: conv_id (smallest member), depth, parent_conv_id
    (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table
    gives no rows; a conversation without turns is a member of the root alone.
    """
    rows = cut_lineage(_prefixes(turns))
    grouped = rows.groupBy(F.col("place").alias("depth"), "p1", "p2").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
        F.sum(F.col("length") - F.col("place") + 1).alias("mass"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    named = cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()))
    above = named.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("node").alias("parent"), F.col("rep").alias("parent_conv_id"),
    )
    linked = named.join(above, ["depth", "q1", "q2"], "left")
    children = named.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")
    ).agg(F.count("*").alias("n_children"))
    linked = linked.join(children, ["depth", "p1", "p2"], "left")
    nodes = cut_lineage(
        linked.select(
            "node", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "depth", "rep", "mass", "p1", "p2", "n_convs",
            F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        )
    )
    release(named)
    places = rows.select("conv_id", F.col("place").alias("depth"), "p1", "p2", "length")
    paths = cut_lineage(
        places.join(nodes.select("depth", "p1", "p2", "node", "parent"), ["depth", "p1", "p2"]).select(
            "conv_id", F.col("depth").alias("place"), "node", "parent", "length"
        )
    )
    release(rows)
    totals = centroid_rollup(
        nodes.select("node", "parent", "depth", "rep", "mass", "n_leaves", "saved_tokens"),
        paths.drop("length"), ["n_leaves", "saved_tokens"], task_nodes,
    )
    ends = ordered_digest(paths.where("place = length").select("node", "conv_id"))
    return nodes.drop("n_leaves", "saved_tokens").join(totals, "node").join(ends, "node", "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
