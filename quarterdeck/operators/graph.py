"""Graph operators on edge tables: components, cosine neighbours, communities, messages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarterdeck.operators.communities import communities
from quarterdeck.session import as_stored, cut_lineage, is_stored, release

_MAX_ROUNDS = 60
_MAX_MOVES = 1000
_ROWS_PER_PRODUCT = 100_000
#: Entries of a strip that a task holds, and items that are multiplied at once.
_STRIP_ENTRIES = 20_000_000
#: Edges of a group up to which one task finds its communities.
_TASK_EDGES = 2_000_000
_TILE_COLUMNS = 2048


def connected_components(
    edges: DataFrame, group: str, first: str, second: str, max_rounds: int = _MAX_ROUNDS
) -> DataFrame:
    """Component label (smallest node id) of every node with an edge, per group.

    Alternating large-star and small-star steps (Kiveris et al., 2014) shrink the graph to
    stars in a logarithmic number of rounds. A step is a grouped minimum and a join, so a hub
    never has its neighbours gathered in one place. Rounds end when the edge set is stable.
    """

    def star(current: DataFrame, large: bool) -> DataFrame:
        both = current.select(group, F.col("u"), F.col("v"))
        if large:
            both = both.unionByName(current.select(group, F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy(group, "u").agg(F.min("v").alias("_m")).select(
            group, "u", F.least("_m", "u").alias("m")
        )
        linked = both.join(smallest, [group, "u"])
        if large:
            moved = linked.where(F.col("v") > F.col("u")).select(group, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = linked.select(group, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                smallest.select(group, "u", F.col("m").alias("v"))
            )
        return moved.where(F.col("u") != F.col("v")).distinct()

    # Every edge points from its larger to its smaller end.
    current = edges.select(
        group, F.greatest(first, second).alias("u"), F.least(first, second).alias("v")
    ).where(F.col("u") != F.col("v")).distinct()
    current = cut_lineage(current)
    signature = None
    for _ in range(max_rounds):
        previous, current = current, cut_lineage(star(star(current, large=True), large=False))
        release(previous)
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(group, "u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (state["n"], state["h"]) == signature:
            break
        signature = (state["n"], state["h"])
    else:
        raise RuntimeError("Components did not settle; raise max_rounds.")
    members = current.select(group, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(group, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def cosine_neighbors(
    weights: DataFrame,
    group: str,
    source: str,
    item: str,
    weight: str,
    neighbors: int,
    tile_rows: int = 2048,
    column_blocks: int = 64,
    digits: int = 12,
    strip_tiles: int = 64,
    unique: bool = False,
) -> DataFrame:
    """The ``neighbors`` most similar sources of each source within its group, exactly.

    Joining on the item would emit every pair of sources that share one, which is quadratic in
    the holders of a popular item. Instead sources with the same items and weights are one class
    first: it is compared once, and its neighbours are dealt to its members at the end.

    A group of up to ``tile_rows`` classes is multiplied in one task, block by block, into one
    matrix. Larger groups are cut into strips of up to ``strip_tiles`` tiles. A task holds one strip
    and streams all classes of the group past it, so a class is sent once for each strip and not
    for each tile it may meet, and each source's best ``neighbors`` are final within the task.
    Classes with the same largest item stand next to each other and a strip meets its own classes
    first: a piece of the stream is then multiplied only by sources for which its greatest weights,
    item by item, allow a similarity above that of their last neighbour.

    Similar values are ordered by similarity rounded to ``digits``, then by id; pairs without
    positive similarity are not neighbours. Ids must be integers. With ``unique`` a source has one
    row an item, and rows are not summed first.
    """
    portfolios = cut_lineage(_portfolios(weights, group, source, item, weight, unique))
    classes, members = _classes(portfolios)
    sizes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("items")).alias("entries"))
    total = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("n"), F.sum("entries").alias("entries")).first()
    key_type = weights.schema[group].dataType
    schema = T.StructType(
        [
            T.StructField("g", key_type),
            T.StructField("s", T.LongType()),
            T.StructField("t", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("neighbor_rank", T.IntegerType()),
        ]
    )
    unit = None
    if (total["largest"] or 0) <= tile_rows:
        entries = classes.select("g", "s", F.explode("items").alias("e")).select("g", "s", "e.i", "e.w")
        unit, _ = _tiled_unit_rows(entries, "g", "s", "i", "w", total["largest"] or 1, column_blocks, unique=True)
        both = [F.lit(True).alias("in_a"), F.lit(True).alias("in_b")]
        placed = unit.select("g", "s", "i", "w", F.col("tile").alias("a"), F.col("tile").alias("b"), *both, "block")
        found = (
            placed.repartition("g", "a", "b")
            .sortWithinPartitions("g", "a", "b", "block")
            .mapInPandas(_TileMultiplier(neighbors, digits, False, ranked=True), schema)
        )
    else:
        tiles = -(-total["n"] // tile_rows)
        per_strip = min(
            strip_tiles, tiles // weights.sparkSession.sparkContext.defaultParallelism,
            _STRIP_ENTRIES * tiles // total["entries"],
        )
        found = _strips(classes, max(per_strip, 1) * tile_rows).mapInArrow(
            _StripMultiplier(neighbors, digits, tile_rows, ranked=True), schema
        )
    # Stored, so that portfolios and their shuffle are gone before the neighbours are used.
    found = cut_lineage(found)
    release(unit)
    release(classes)
    best = found if members is None else _dealt_to_members(found, members, neighbors)
    return best.select(
        F.col("g").alias(group),
        F.col("s").alias("source"),
        F.col("t").alias("target"),
        "neighbor_rank",
        F.col("similarity").alias("cosine_similarity"),
    )


def _portfolios(weights: DataFrame, group: str, source: str, item: str, weight: str, unique: bool = False) -> DataFrame:
    """(g, s, items): each source's items and weights as one sorted array."""
    rows = _summed_weights(weights, group, source, item, weight, unique).where("g IS NOT NULL AND s IS NOT NULL AND i IS NOT NULL AND w <> 0")
    return rows.groupBy("g", "s").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("items"))


def _classes(portfolios: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(g, items, s): each set of equal portfolios by its smallest source; (g, s, c) of sets of several, if any.

    Portfolios are equal if their digests of 128 bits are, and only digests are moved: two of n
    different portfolios share one with probability n^2 / 2^129. Without a digest that occurs twice
    all portfolios are the classes; else a stored table that is passed is replaced by that of the
    classes.
    """
    alike = Window.partitionBy("g", "h", "h2")
    digests = portfolios.select("g", "s", F.xxhash64("items").alias("h"), F.xxhash64(F.lit(1), "items").alias("h2")).select(
        "g", "s", F.min("s").over(alike).alias("c"), F.count(F.lit(1)).over(alike).alias("n")
    )
    listed = cut_lineage(digests.select("g", "s", "c", (F.col("n") > 1).alias("several")))
    members = as_stored(listed.where("several").select("g", "s", "c"), listed)
    if members.isEmpty():
        release(listed)
        return portfolios, None
    # Stored, so that the planner sees how many classes there are and leaves the portfolios where they are.
    least = cut_lineage(listed.where("s = c").select("g", "s"))
    classes = cut_lineage(portfolios.join(least, ["g", "s"], "left_semi").select("g", "items", "s"))
    release(least)
    release(portfolios)
    return classes, members


def _dealt_to_members(found: DataFrame, members: DataFrame, neighbors: int) -> DataFrame:
    """Neighbours of classes as neighbours of their members; ``members`` (g, s, c) has the classes of several.

    A class has ``neighbors`` classes that come first by similarity and smallest member. Nobody
    outside of them and of the class itself can be a neighbour, nor any but the smallest members
    of each: one more than ``neighbors``, as a source is not its own neighbour. What is found for a
    class of one that has only such neighbours stays as it is and is not moved.
    """
    by_id = Window.partitionBy("g", "c").orderBy("s")
    least = members.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= neighbors + 1)
    least = cut_lineage(least.groupBy("g", F.col("c").alias("t")).agg(F.array_sort(F.collect_list("s")).alias("ids")))
    several = least.select("g", F.col("t").alias("s"))
    near = found.join(least.select("g", "t"), ["g", "t"], "left_semi").select("g", "s")
    touched = cut_lineage(several.unionByName(near).distinct())
    settled = found.join(touched, ["g", "s"], "left_anti").where(F.col("neighbor_rank") <= neighbors)
    theirs = found.join(touched, ["g", "s"], "left_semi").join(least, ["g", "t"], "left").select(
        "g", F.col("s").alias("c"), "similarity", F.explode(F.coalesce("ids", F.array("t"))).alias("t")
    )
    own = least.where(F.size("ids") > 1).select("g", F.col("t").alias("c"), F.lit(1.0).alias("similarity"), F.explode("ids").alias("t"))
    listed = cut_lineage(
        theirs.unionByName(own).groupBy("g", "c").agg(
            F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("n"), "t"))), 1, neighbors + 1).alias("listed")
        )
    )
    moved = touched.join(several, ["g", "s"], "left_anti").select("g", "s", F.col("s").alias("c")).unionByName(members)
    others = F.slice(F.filter("listed", lambda x: x["t"] != F.col("s")), 1, neighbors)
    dealt = moved.join(listed, ["g", "c"]).select("g", "s", F.posexplode(others).alias("_p", "_x")).select(
        "g", "s", "_x.t", (-F.col("_x.n")).alias("similarity"), (F.col("_p") + 1).alias("neighbor_rank")
    )
    return settled.select("g", "s", "t", "similarity", "neighbor_rank").unionByName(dealt)


def _strips(classes: DataFrame, strip_rows: int) -> DataFrame:
    """Rows of each strip: its own classes first, then all classes of its group, those nearest in line first.

    A group of one strip is sent once: its own classes are all there are.
    """
    largest = F.array_max(F.transform("items", lambda x: F.struct(F.abs(x["w"]).alias("w"), x["i"].alias("i"))))["i"]
    heads = classes.withColumn("largest", largest)
    lined = Window.partitionBy("g").orderBy("largest").rowsBetween(Window.unboundedPreceding, -1)
    blocks = heads.groupBy("g", "largest").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(lined), F.lit(0))
    )
    strips = classes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / strip_rows).cast("int").alias("strips"))
    # Stored, so that the planner sees a small table and leaves the portfolios where they are.
    blocks = cut_lineage(blocks.join(strips, "g"))
    place = F.col("before") + F.pmod(F.xxhash64("s"), F.col("n"))
    lists = [F.transform("items", lambda x: x["i"]).alias("i"), F.transform("items", lambda x: x["w"]).alias("w")]
    own = F.floor(place / strip_rows).cast("int")
    placed = heads.join(blocks, ["g", "largest"]).select("g", "s", *lists, place.alias("place"), own.alias("own"), "strips")
    # The first copy is held by its own strip; of the others, each strip gets one.
    copies = F.sequence(F.lit(-1), F.when(F.col("strips") > 1, F.col("strips") - 1).otherwise(-1))
    own, strip = F.col("own"), F.col("copy")
    sent = placed.withColumn("copy", F.explode(copies)).select(
        "g", F.when(strip < 0, own).otherwise(strip).alias("strip"),
        F.when(strip < 0, -1).otherwise(F.abs(own - strip)).alias("distance"), "place", "s", "i", "w",
    )
    order = ["g", "strip", "distance", "place"]
    return sent.repartition("g", "strip").sortWithinPartitions(*order).select(*order[:3], "s", "i", "w")


class _Rows:
    """Sparse rows of unit length: ids, row number of each entry, items and weights."""

    def __init__(self, parts: list[tuple]) -> None:
        self.ids = np.concatenate([p[0] for p in parts])
        lengths = np.concatenate([p[1] for p in parts])
        self.items = np.concatenate([p[2] for p in parts])
        weights = np.concatenate([p[3] for p in parts])
        self.row = np.repeat(np.arange(len(self.ids)), lengths)
        norm = np.sqrt(np.bincount(self.row, weights * weights, len(self.ids)))
        self.weights = weights / norm[self.row]

    def dense(self, at: np.ndarray, width: int, wanted: np.ndarray, n: int) -> np.ndarray:
        """Matrix of the entries whose column ``at`` is below ``width``, of rows numbered by ``wanted``."""
        keep = (at >= 0) & (at < width) & (wanted[self.row] >= 0)
        matrix = np.zeros((n, width))
        matrix[wanted[self.row[keep]], at[keep]] = self.weights[keep]
        return matrix


class _StripMultiplier:
    """Holds the classes of one strip and keeps each one's best among all classes that pass."""

    def __init__(self, neighbors: int, digits: int, tile_rows: int, ranked: bool = False) -> None:
        self.neighbors = neighbors
        self.digits = digits
        self.tile_rows = tile_rows
        self.ranked = ranked

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles, waiting, held = None, [], [], True

        def meet(rows: _Rows) -> None:
            passing = _Passing(rows)
            for tile in tiles:
                tile.meet(passing)

        def settle() -> None:
            if waiting:
                rows = _Rows(waiting)
                waiting.clear()
                if held:
                    tiles.append(_StripTile(self, rows))
                else:
                    meet(rows)

        def finish() -> Iterator[pa.RecordBatch]:
            settle()
            if held:
                # Nothing passed: the group is this strip, and its classes meet each other.
                for tile in tiles:
                    meet(tile.rows)
            for tile in tiles:
                yield tile.out(key[0])

        for key_, held_, part in self._parts(batches):
            if key_ != key:
                yield from finish()
                key, tiles, held = key_, [], held_
            if held_ != held or sum(len(p[0]) for p in waiting) + len(part[0]) > self.tile_rows:
                settle()
            held = held_
            waiting.append(part)
        yield from finish()

    def _parts(self, batches: Iterator[pa.RecordBatch]):
        """((g, strip), whether held, (ids, lengths, items, weights)) of at most ``tile_rows`` rows."""
        for batch in batches:
            if not batch.num_rows:
                continue
            strip, held = batch.column("strip").to_numpy(), batch.column("distance").to_numpy() < 0
            codes = batch.column("g").dictionary_encode().indices.to_numpy()
            new = (codes[1:] != codes[:-1]) | (strip[1:] != strip[:-1]) | (held[1:] != held[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for first in range(low, high, self.tile_rows):
                    some = batch.slice(first, min(self.tile_rows, high - first))
                    part = (
                        some.column("s").to_numpy(), np.diff(some.column("i").offsets.to_numpy()),
                        some.column("i").flatten().to_numpy(), some.column("w").flatten().to_numpy(),
                    )
                    yield (some.column("g")[0], int(strip[first])), bool(held[first]), part


class _Passing:
    """A piece of the stream with its items and their greatest and least weights."""

    def __init__(self, rows: _Rows) -> None:
        self.rows = rows
        self.columns, self.at = np.unique(rows.items, return_inverse=True)
        self.high, self.low = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        np.maximum.at(self.high, self.at, rows.weights)
        np.minimum.at(self.low, self.at, rows.weights)
        self.all = np.arange(len(rows.ids))


class _StripTile:
    """Some classes of a strip and the best neighbours of each so far."""

    def __init__(self, owner: _StripMultiplier, rows: _Rows) -> None:
        self.owner = owner
        self.rows = rows
        n, k = len(rows.ids), owner.neighbors
        self.best = np.zeros((n, k))
        self.best_ids = np.full((n, k), np.iinfo(np.int64).max)

    def meet(self, other: _Passing) -> None:
        rows, slack = self.rows, 10.0**-self.owner.digits + 1e-9
        at = np.minimum(np.searchsorted(other.columns, rows.items), len(other.columns) - 1)
        at[other.columns[at] != rows.items] = -1
        known = at >= 0
        w = rows.weights[known]
        most = np.maximum(w * other.high[at[known]], w * other.low[at[known]])
        bound = np.bincount(rows.row[known], most, len(rows.ids))
        last = self.best[:, -1]
        active = np.flatnonzero((bound > 0) & (bound + slack >= last))
        if not len(active):
            return
        wanted = np.full(len(rows.ids), -1)
        wanted[active] = np.arange(len(active))
        sums = np.zeros((len(active), len(other.rows.ids)))
        for low in range(0, len(other.columns), _TILE_COLUMNS):
            width = min(_TILE_COLUMNS, len(other.columns) - low)
            sums += rows.dense(at - low, width, wanted, len(active)) @ other.rows.dense(other.at - low, width, other.all, len(other.all)).T
        self._merge(active, sums, other.rows.ids, slack)

    def _merge(self, active: np.ndarray, sums: np.ndarray, ids: np.ndarray, slack: float) -> None:
        k, last = self.owner.neighbors, self.best[active, -1]
        # Without a last neighbour anything positive after rounding may count.
        least = np.where(last > 0, last - slack, 0.5 * 10.0**-self.owner.digits)
        hits = sums >= least[:, None]
        if sums.shape[1] > k + 1 and np.count_nonzero(hits) > 8 * k * len(active):
            # The source itself may be among the k + 1 greatest.
            least = np.maximum(least, np.partition(sums, -k - 1, axis=1)[:, -k - 1] - slack)
            hits = sums >= least[:, None]
        r, c = np.nonzero(hits)
        value = np.minimum(np.round(sums[r, c], self.owner.digits), 1.0)
        good = (value > 0) & (self.rows.ids[active[r]] != ids[c])
        r, value, t = r[good], value[good], ids[c[good]]
        if not len(r):
            return
        changed, r = np.unique(r, return_inverse=True)
        at = active[changed]
        place = np.concatenate((np.repeat(np.arange(len(at)), k), r))
        value = np.concatenate((self.best[at].ravel(), value))
        t = np.concatenate((self.best_ids[at].ravel(), t))
        order = np.lexsort((t, -value, place))
        first = np.searchsorted(place[order], np.arange(len(at)))
        kept = order[first[:, None] + np.arange(k)]
        self.best[at], self.best_ids[at] = value[kept], t[kept]

    def out(self, g: pa.Scalar) -> pa.RecordBatch:
        row, place = np.nonzero(self.best > 0)
        columns = {
            "g": pa.array([g.as_py()] * len(row), g.type), "s": pa.array(self.rows.ids[row]),
            "t": pa.array(self.best_ids[row, place]), "similarity": pa.array(self.best[row, place]),
        }
        if self.owner.ranked:
            columns["neighbor_rank"] = pa.array((place + 1).astype(np.int32))
        return pa.RecordBatch.from_pydict(columns)


def _summed_weights(weights: DataFrame, group: str, source: str, item: str, weight: str, unique: bool = False) -> DataFrame:
    """(g, s, i, w): one row per source and item, items as numbers; sums are left out if rows are ``unique`` already."""
    chosen = weights.where(F.col(weight).isNotNull() & (F.col(weight) != 0)).select(
        F.col(group).alias("g"), F.col(source).cast("bigint").alias("s"), F.col(item).alias("i"), F.col(weight).cast("double").alias("w")
    )
    if not isinstance(weights.schema[item].dataType, T.IntegralType):
        # Items of other types are numbered, so that no two are taken for one.
        numbers = cut_lineage(chosen.select("i").distinct().withColumn("_number", F.monotonically_increasing_id()))
        chosen = chosen.join(numbers, "i").select("g", "s", F.col("_number").alias("i"), "w")
    if is_stored(weights):
        # Dealt by source at once: sums and portfolios then share one shuffle.
        chosen = chosen.repartition("g", "s")
    if unique:
        return chosen.withColumn("i", F.col("i").cast("bigint"))
    return chosen.groupBy("g", "s", F.col("i").cast("bigint").alias("i")).agg(F.sum("w").alias("w"))


def _tiled_unit_rows(
    weights: DataFrame, group: str, source: str, item: str, weight: str, tile_rows: int, column_blocks: int, unique: bool = False
) -> tuple[DataFrame, int]:
    """Stored (g, s, i, w, tile, block) of unit vectors, and the largest number of tiles of a group."""
    rows = _summed_weights(weights, group, source, item, weight, unique)
    heads = rows.groupBy("g", "s").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.max(F.struct(F.abs("w"), "i"))["i"].alias("largest")
    )
    lined = Window.partitionBy("g").orderBy("largest").rowsBetween(Window.unboundedPreceding, -1)
    blocks = heads.groupBy("g", "largest").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(lined), F.lit(0))
    )
    # Sources with the same largest item fill neighbouring places in an order of their own.
    place = F.col("before") + F.pmod(F.xxhash64("s"), F.col("n"))
    sources = heads.join(blocks, ["g", "largest"]).select("g", "s", "norm", F.floor(place / tile_rows).cast("int").alias("tile"))
    unit = cut_lineage(
        rows.join(sources, ["g", "s"]).where("norm > 0").select(
            "g", "s", "i", (F.col("w") / F.col("norm")).alias("w"), "tile",
            F.pmod(F.xxhash64("i"), F.lit(column_blocks)).cast("int").alias("block"),
        )
    )
    return unit, (unit.agg(F.max("tile")).first()[0] or 0) + 1


def _allowed_meetings(unit: DataFrame, found: DataFrame, neighbors: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows of sources and of tiles that they have to meet beyond their own.

    A source's similarity to any row of a tile is at most the sum, over its items, of its weight
    times the tile's greatest (for negative weights, smallest) weight of the item.
    """
    rank = Window.partitionBy("g", "s").orderBy(F.col("similarity").desc(), "t")
    floor = found.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == neighbors).select(
        "g", "s", F.col("similarity").alias("last")
    )
    zero = F.lit(0.0)
    reach = unit.groupBy("g", "i", F.col("tile").alias("b")).agg(
        F.greatest(F.max("w"), zero).alias("high"), F.least(F.min("w"), zero).alias("low")
    )
    most = F.greatest(F.col("w") * F.col("high"), F.col("w") * F.col("low"))
    bounds = unit.join(reach, ["g", "i"]).where("tile <> b").groupBy("g", "s", "tile", "b").agg(F.sum(most).alias("bound"))
    slack = 10.0**-digits + 1e-9
    needed = bounds.join(floor, ["g", "s"], "left").where(F.col("bound") + slack >= F.coalesce("last", zero)).where("bound > 0")
    needed = cut_lineage(needed.select("g", "s", F.col("tile").alias("a"), "b"))
    columns = ["g", "s", "i", "w", "a", "b"]
    queries = unit.join(needed, ["g", "s"]).select(*columns, F.lit(True).alias("in_a"), F.lit(False).alias("in_b"), "block")
    pairs = needed.select("g", "a", "b").distinct()
    bases = unit.withColumnRenamed("tile", "b").join(pairs, ["g", "b"]).select(
        *columns, F.lit(False).alias("in_a"), F.lit(True).alias("in_b"), "block"
    )
    return queries, bases


class _TileMultiplier:
    """Streams the sorted rows of tile pairs and emits each tile pair's best neighbours (of its first tile if ``directed``)."""

    def __init__(self, neighbors: int, digits: int, directed: bool = False, ranked: bool = False) -> None:
        self.neighbors = neighbors
        self.digits = digits
        self.directed = directed
        self.ranked = ranked

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, tile = None, None
        pending: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            if batch.empty:
                continue
            for key, part in batch.groupby(["g", "a", "b"], sort=False):
                if key != open_key:
                    if tile is not None:
                        tile.add(pd.concat(pending))
                        yield from tile.emit(open_key[0])
                    open_key, tile, pending, held = key, _TilePair(self, key[1] == key[2]), [], 0
                pending.append(part)
                held += len(part)
                if held >= _ROWS_PER_PRODUCT:
                    # Rows are sorted by block and only the last block may still continue.
                    rows = pd.concat(pending)
                    complete = rows["block"] != rows["block"].iloc[-1]
                    if complete.any():
                        tile.add(rows[complete])
                    pending, held = [rows[~complete]], int((~complete).sum())
        if tile is not None:
            tile.add(pd.concat(pending))
            yield from tile.emit(open_key[0])


class _TilePair:
    """Similarity sums of one tile pair, grown as new sources appear."""

    def __init__(self, owner: _TileMultiplier, same: bool) -> None:
        self.owner = owner
        self.same = same
        self.index_a: dict[int, int] = {}
        self.index_b: dict[int, int] = self.index_a if same else {}
        self.sums = np.zeros((0, 0))

    @staticmethod
    def _positions(index: dict[int, int], ids: np.ndarray) -> np.ndarray:
        codes, distinct = pd.factorize(ids)
        for value in distinct.tolist():
            index.setdefault(value, len(index))
        return np.array([index[v] for v in distinct.tolist()], np.int64)[codes] if len(distinct) else codes

    def add(self, rows: pd.DataFrame) -> None:
        side_a, side_b = rows[rows["in_a"]], rows[rows["in_b"]]
        at_a = self._positions(self.index_a, side_a["s"].to_numpy())
        at_b = self._positions(self.index_b, side_b["s"].to_numpy())
        shape = (len(self.index_a), len(self.index_b))
        if shape != self.sums.shape:
            grown = np.zeros(shape)
            grown[: self.sums.shape[0], : self.sums.shape[1]] = self.sums
            self.sums = grown
        if not len(side_a) or not len(side_b):
            return
        columns = np.intersect1d(side_a["i"].to_numpy(), side_b["i"].to_numpy())
        for low in range(0, len(columns), 2048):
            some = columns[low : low + 2048]
            self.sums += self._dense(side_a, at_a, some, shape[0]) @ self._dense(side_b, at_b, some, shape[1]).T

    @staticmethod
    def _dense(side: pd.DataFrame, at: np.ndarray, columns: np.ndarray, height: int) -> np.ndarray:
        items = side["i"].to_numpy()
        keep = np.isin(items, columns)
        matrix = np.zeros((height, len(columns)))
        matrix[at[keep], np.searchsorted(columns, items[keep])] = side["w"].to_numpy()[keep]
        return matrix

    def emit(self, g) -> Iterator[pd.DataFrame]:
        ids_a = np.fromiter(self.index_a, dtype=np.int64, count=len(self.index_a))
        ids_b = np.fromiter(self.index_b, dtype=np.int64, count=len(self.index_b))
        similar = np.clip(np.round(self.sums, self.owner.digits), None, 1.0)
        yield self._best(g, ids_a, ids_b, similar)
        if not self.same and not self.owner.directed:
            yield self._best(g, ids_b, ids_a, similar.T)

    def _best(self, g, ids: np.ndarray, others: np.ndarray, similar: np.ndarray) -> pd.DataFrame:
        by_id = np.argsort(others, kind="stable")
        others, similar = others[by_id], similar[:, by_id]
        kept = np.argsort(-similar, axis=1, kind="stable")[:, : self.owner.neighbors + 1]
        out = pd.DataFrame(
            {
                "s": np.repeat(ids, kept.shape[1]),
                "t": others[kept].ravel(),
                "similarity": np.take_along_axis(similar, kept, axis=1).ravel(),
            }
        )
        out = out[(out["similarity"] > 0) & (out["s"] != out["t"])]
        out.insert(0, "g", [g] * len(out))
        if self.owner.ranked:
            # A source's rows stand together, nearest first.
            out["neighbor_rank"] = (out.groupby("s").cumcount() + 1).astype(np.int32)
            out = out[out["neighbor_rank"] <= self.owner.neighbors]
        return out


def undirected_union(
    directed: DataFrame, group: str, neighbor_counts: Sequence[int]
) -> DataFrame:
    """Undirected union graph for each neighbour count: best similarity, links, best rank."""
    k = F.explode(F.array(*[F.lit(int(n)) for n in neighbor_counts])).alias("k_neighbors")
    return (
        directed.select("*", k)
        .where((F.col("neighbor_rank") <= F.col("k_neighbors")) & (F.col("cosine_similarity") > 0))
        .groupBy(
            group,
            "k_neighbors",
            F.least("source", "target").alias("manager_a"),
            F.greatest("source", "target").alias("manager_b"),
        )
        .agg(
            F.max("cosine_similarity").alias("cosine_similarity"),
            F.count(F.lit(1)).alias("directional_links"),
            F.min("neighbor_rank").alias("best_neighbor_rank"),
        )
        .withColumn("is_mutual_neighbor", F.col("directional_links") == 2)
    )


def neighbor_pairs(directed: DataFrame, group: str) -> DataFrame:
    """One row per pair of neighbours: rank and similarity from each side, null where it is none.

    ``backward_similarity`` is null too where it equals ``forward_similarity``.
    """
    forward = F.col("source") <= F.col("target")
    rank, similarity = F.col("neighbor_rank"), F.col("cosine_similarity")
    pairs = directed.where("cosine_similarity > 0").groupBy(
        group, F.least("source", "target").alias("manager_a"), F.greatest("source", "target").alias("manager_b")
    ).agg(
        F.max(F.when(forward, rank)).alias("forward_rank"), F.max(F.when(~forward, rank)).alias("backward_rank"),
        F.max(F.when(forward, similarity)).alias("forward_similarity"), F.max(F.when(~forward, similarity)).alias("_other"),
    )
    other = F.when(~F.col("_other").eqNullSafe(F.col("forward_similarity")), F.col("_other"))
    return pairs.withColumn("backward_similarity", other).drop("_other")


def pairs_by_count(pairs: DataFrame, group: str, neighbor_counts: Sequence[int]) -> DataFrame:
    """(group, k_neighbors, cosine_similarity, is_mutual_neighbor): ``undirected_union`` from ``neighbor_pairs``, in place."""
    k = F.explode(F.array(*[F.lit(int(n)) for n in neighbor_counts])).alias("k_neighbors")
    ahead = F.coalesce(F.col("forward_rank") <= F.col("k_neighbors"), F.lit(False))
    back = F.coalesce(F.col("backward_rank") <= F.col("k_neighbors"), F.lit(False))
    similarity = F.greatest(
        F.when(ahead, F.col("forward_similarity")),
        F.when(back, F.coalesce("backward_similarity", "forward_similarity")),
    )
    return pairs.select("*", k).where(ahead | back).select(
        group, "k_neighbors", similarity.alias("cosine_similarity"), (ahead & back).alias("is_mutual_neighbor")
    )


def endpoints(edges: DataFrame, keep: Sequence[str], first: str, second: str, node: str = "node") -> DataFrame:
    """One row per edge end."""
    return edges.select(*keep, F.explode(F.array(first, second)).alias(node))


def node_degrees(edges: DataFrame, group: str, first: str, second: str, weight: str) -> DataFrame:
    """Degree and mean edge weight of every node with an edge."""
    return endpoints(edges, [group, weight], first, second).groupBy(group, "node").agg(
        F.count(F.lit(1)).alias("similarity_degree"), F.avg(weight).alias("mean_neighbor_similarity")
    )


def modularity(
    edges: DataFrame, labels: DataFrame, group: str, first: str, second: str, weight: str,
    resolution: float = 1.0,
) -> DataFrame:
    """Newman modularity of a labelling per group (edges listed once per pair)."""
    a = labels.select(group, F.col("node").alias(first), F.col("community").alias("_ca"))
    b = labels.select(group, F.col("node").alias(second), F.col("community").alias("_cb"))
    marked = edges.join(a, [group, first]).join(b, [group, second])
    inside = marked.groupBy(group).agg(
        F.sum(weight).alias("_m"),
        F.sum(F.when(F.col("_ca") == F.col("_cb"), F.col(weight)).otherwise(0.0)).alias("_in"),
    )
    totals = (
        marked.select(group, weight, F.explode(F.array("_ca", "_cb")).alias("_c"))
        .groupBy(group, "_c").agg(F.sum(weight).alias("_tot"))
        .groupBy(group).agg(F.sum(F.col("_tot") * F.col("_tot")).alias("_sq"))
    )
    return inside.join(totals, group).select(
        group,
        (F.col("_in") / F.col("_m") - resolution * F.col("_sq") / (4 * F.col("_m") * F.col("_m")))
        .alias("modularity"),
    )


def modularity_communities(
    nodes: DataFrame,
    edges: DataFrame,
    group: str,
    node: str,
    first: str,
    second: str,
    weight: str,
    resolution: float = 1.0,
    tolerance: float = 1e-6,
    task_edges: int = _TASK_EDGES,
) -> DataFrame:
    """Weighted communities per group by local moving and contraction.

    In a round every node weighs its neighbouring communities by modularity gain, and all moves
    are made that raise modularity whatever the moves before them in a random order do
    (``_moves_that_add_up``), so each round raises it and rounds end when no node wants to move;
    nodes of finished groups stay where they are. Communities are then contracted to nodes and
    moving starts again. Each group decides for itself: a level that does not raise its modularity
    is not taken, and the group leaves the later levels. At the end communities without a path
    between their parts are split (``connected_parts``). A group's labels do not depend on the
    other groups of the frame. Labels are numbered by falling size, then smallest member. Rounds
    and levels have a high limit only to end a fault, and then raise.

    A group of up to ``task_edges`` edges goes through all of its rounds in one task, on arrays
    (``communities``); the tables of larger groups are moved round by round. Labels are the same.
    """
    base = edges.select(group, F.col(first).alias("u"), F.col(second).alias("v"), F.col(weight).cast("double").alias("w"))
    if not is_stored(edges):
        base = cut_lineage(base)
    sizes = cut_lineage(base.groupBy(group).agg(F.count(F.lit(1)).alias("_edges")))
    large = sizes.where(F.col("_edges") > task_edges).select(group)
    start = nodes.select(group, F.col(node).alias("node"), F.col(node).cast("bigint").alias("community"))
    if large.isEmpty():
        return number_communities(_settled_in_tasks(start, base, group, sizes.count(), resolution, tolerance), group)
    start = cut_lineage(start)
    if sizes.where(F.col("_edges") <= task_edges).isEmpty():
        found = _settled_in_rounds(start, base, group, resolution, tolerance)
    else:
        found = _settled_in_rounds(
            cut_lineage(start.join(large, group, "left_semi")), cut_lineage(base.join(large, group, "left_semi")), group, resolution, tolerance
        ).unionByName(
            _settled_in_tasks(
                start.join(large, group, "left_anti"), base.join(large, group, "left_anti"), group, sizes.count(), resolution, tolerance
            )
        )
    return number_communities(cut_lineage(found), group)


def _settled_in_tasks(
    assignment: DataFrame, base: DataFrame, group: str, groups: int, resolution: float, tolerance: float
) -> DataFrame:
    """(group, node, community) of groups that a task holds; a group is dealt to a task of its own, if numbers allow."""
    kind = assignment.schema["node"].dataType

    def settle(edges: pd.DataFrame) -> pd.DataFrame:
        nodes, labels = communities(
            edges["u"].to_numpy(np.int64), edges["v"].to_numpy(np.int64), edges["w"].to_numpy(np.float64),
            resolution, tolerance, _MAX_ROUNDS, _MAX_MOVES,
        )
        return pd.DataFrame({group: [edges[group].iloc[0]] * len(nodes), "node": nodes, "community": labels})

    schema = T.StructType([base.schema[group], T.StructField("node", kind), T.StructField("community", T.LongType())])
    dealt = base.repartition(max(1, min(8 * groups, 2000)), group).groupBy(group)
    # Stored, so that the tasks run once, whoever counts and reads their labels.
    labels = cut_lineage(dealt.applyInPandas(settle, schema))
    return assignment.withColumnRenamed("community", "_alone").join(labels, [group, "node"], "left").select(
        group, "node", F.coalesce("community", "_alone").alias("community")
    )


def _settled_in_rounds(
    assignment: DataFrame, base: DataFrame, group: str, resolution: float, tolerance: float
) -> DataFrame:
    """(group, node, community) of groups of any size, by tables that are moved in each round."""
    level_edges = base.select(
        group, F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), "w"
    )
    score = cut_lineage(modularity(base, assignment, group, "u", "v", "w", resolution))
    for level in range(_MAX_ROUNDS):
        labels = _local_moving(level_edges, group, resolution, level)
        merged = cut_lineage(
            assignment.join(
                labels.select(group, F.col("node").alias("community"), F.col("community").alias("_next")),
                [group, "community"],
                "left",
            ).select(group, "node", F.coalesce("_next", "community").alias("community"))
        )
        reached = modularity(base, merged, group, "u", "v", "w", resolution).withColumnRenamed("modularity", "_new")
        # One row per group.
        compared = cut_lineage(reached.join(score, group))
        better = compared.where(F.col("_new") > F.col("modularity") + tolerance).select(group)
        if better.isEmpty():
            return connected_parts(assignment, base, group)
        kept = assignment.join(better, group, "left_anti")
        previous, assignment = assignment, cut_lineage(
            merged.join(better, group, "left_semi").unionByName(kept)
        )
        release(previous)
        release(merged)
        score = cut_lineage(compared.select(group, F.greatest("_new", "modularity").alias("modularity")))
        a = labels.select(group, F.col("node").alias("u"), F.col("community").alias("cu"))
        b = labels.select(group, F.col("node").alias("v"), F.col("community").alias("cv"))
        previous, level_edges = level_edges, cut_lineage(
            level_edges.join(better, group, "left_semi").join(a, [group, "u"]).join(b, [group, "v"])
            .groupBy(group, F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"))
            .agg(F.sum("w").alias("w"))
        )
        release(previous)
        release(labels)
    raise RuntimeError("Communities did not settle.")


def _local_moving(edges: DataFrame, group: str, resolution: float, level: int) -> DataFrame:
    """Moving rounds until no node wants to move; each is stored and its predecessor deleted."""
    plain = edges.where(F.col("u") != F.col("v"))
    arcs = plain.select(group, "u", "v", "w").unionByName(
        plain.select(group, F.col("v").alias("u"), F.col("u").alias("v"), "w")
    )
    strength = (
        endpoints(edges, [group, "w"], "u", "v", "u").groupBy(group, "u").agg(F.sum("w").alias("k"))
    )
    total = edges.groupBy(group).agg(F.sum("w").alias("m"))
    fixed = cut_lineage(strength.join(total, group))
    labels = fixed.select(group, F.col("u").alias("node"), F.col("u").alias("community"))
    for round_number in range(_MAX_MOVES):
        salt = F.lit(round_number + 1000 * level)

        def turn(end: str, salt: Column = salt) -> Column:
            return F.struct(F.xxhash64(end, salt), F.col(end))

        state = labels.join(fixed.withColumnRenamed("u", "node"), [group, "node"])
        volume = state.groupBy(group, "community").agg(F.sum("k").alias("tot"))
        # Labels carry the volume of their community, so that arcs are moved by their ends only.
        placed = cut_lineage(state.join(volume, [group, "community"]).select(group, "node", "community", "tot", "k", "m"))
        near = arcs.join(placed.select(group, F.col("node").alias("v"), "community", "tot"), [group, "v"]).select(
            group, "u", "community", "tot", "w"
        )
        stay = placed.select(group, F.col("node").alias("u"), "community", "tot", F.lit(0.0).alias("w"))
        own = placed.select(group, F.col("node").alias("u"), F.col("community").alias("own"), "k", "m")
        options = (
            near.unionByName(stay).repartition(group, "u")
            .groupBy(group, "u", "community").agg(F.sum("w").alias("w_in"), F.first("tot").alias("tot"))
            .join(own, [group, "u"])
        )
        others = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("w_in") - resolution * F.col("k") * others / (2 * F.col("m"))
        choice = options.groupBy(group, "u").agg(
            F.max(F.struct(F.round(gain, 12).alias("gain"), (-F.col("community")).alias("c"))).alias("best"),
            F.max(F.when(F.col("community") == F.col("own"), F.round(gain, 12))).alias("stay"),
            F.first("own").alias("own"), F.first("k").alias("k"), F.first("m").alias("m"),
        ).where(F.col("best.gain") > F.col("stay"))
        wanting = cut_lineage(
            choice.select(
                group, "u", "own", (-F.col("best.c")).alias("target"), (F.col("best.gain") - F.col("stay")).alias("gain"),
                (resolution * F.col("k") / (2 * F.col("m"))).alias("share"), "k", turn("u").alias("turn"),
            )
        )
        release(placed)
        if wanting.isEmpty():
            release(wanting)
            if is_stored(labels):
                release(fixed)
            return labels
        moving = _moves_that_add_up(wanting, arcs.where(turn("v") < turn("u")), group)
        moved = cut_lineage(
            labels.join(moving.select(group, F.col("u").alias("node"), "target"), [group, "node"], "left").select(
                group, "node", F.coalesce("target", "community").alias("community")
            )
        )
        release(labels)
        release(wanting)
        labels = moved
    raise RuntimeError("Moves did not settle.")


def _moves_that_add_up(wanting: DataFrame, arcs: DataFrame, group: str) -> DataFrame:
    """Wanted moves that raise modularity even if all wanted moves before them are made.

    Moves have an order, and ``arcs`` lead from a node to those with a turn before it. What those before a move can take from its gain is bounded: they may fill
    its target and empty its community (by the volume that enters and leaves), and neighbours
    among them may leave the target or enter the community. A move whose gain exceeds all of that
    is made. Any number of nodes can enter a community at once; the first in order always moves.
    """
    def volume_before(end: str):
        return F.coalesce(
            F.sum("k").over(Window.partitionBy(group, end).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
        )

    bounded = wanting.withColumn("filled", volume_before("target")).withColumn("emptied", volume_before("own"))
    mine = wanting.select(group, "u", "own", "target")
    theirs = wanting.select(group, F.col("u").alias("v"), F.col("own").alias("v_own"), F.col("target").alias("v_target"))
    met = arcs.join(mine, [group, "u"]).join(theirs, [group, "v"]).where("v_own = target OR v_target = own")
    leaves, enters = (F.col("v_own") == F.col("target")).cast("int"), (F.col("v_target") == F.col("own")).cast("int")
    lost = met.groupBy(group, "u").agg(F.sum(F.col("w") * (leaves + enters)).alias("lost"))
    margin = F.col("gain") - F.col("share") * (F.col("filled") + F.col("emptied")) - F.coalesce("lost", F.lit(0.0))
    return bounded.join(lost, [group, "u"], "left").where(margin > 0)


def connected_parts(assignment: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """Labels in which every community is connected: its parts become communities of their own.

    Splitting parts without an edge between them keeps all edges inside and never lowers modularity.
    """
    a = assignment.select(group, F.col("node").alias("u"), F.col("community").alias("_cu"))
    b = assignment.select(group, F.col("node").alias("v"), F.col("community").alias("_cv"))
    inside = edges.join(a, [group, "u"]).join(b, [group, "v"]).where(F.col("_cu") == F.col("_cv")).where("u <> v")
    parts = connected_components(inside.select(group, "u", "v"), group, "u", "v")
    return assignment.join(parts.select(group, "node", "component"), [group, "node"], "left").select(
        group, "node", F.coalesce("component", "node").alias("community")
    )


def number_communities(assignment: DataFrame, group: str) -> DataFrame:
    """Consecutive ids from one, largest community first, then by smallest member."""
    sizes = assignment.groupBy(group, "community").agg(
        F.count(F.lit(1)).alias("_size"), F.min("node").alias("_first")
    )
    # One row per community; communities per group are few compared with nodes.
    by_size = Window.partitionBy(group).orderBy(F.col("_size").desc(), F.col("_first"))
    numbered = sizes.select(group, "community", F.row_number().over(by_size).alias("community_id"))
    return assignment.join(numbered, [group, "community"]).select(group, "node", "community_id")


def weighted_messages(
    edges: DataFrame,
    features: DataFrame,
    group: str,
    source: str,
    destination: str,
    weight: str,
    values: Sequence[str],
) -> DataFrame:
    """Sum of weight times source feature per destination node."""
    return (
        edges.join(features.select(group, source, *values), [group, source])
        .groupBy(group, destination)
        .agg(*[F.sum(F.col(weight).cast("double") * F.col(v)).alias(v) for v in values])
    )


def bipartite_round_trip(
    edges: DataFrame,
    stock_features: DataFrame,
    group: str,
    manager: str,
    security: str,
    to_manager: str,
    to_stock: str,
    values: Sequence[str],
) -> DataFrame:
    """Security features passed to managers by portfolio weight and back by ownership share."""
    managers = weighted_messages(edges, stock_features, group, security, manager, to_manager, values)
    return weighted_messages(edges, managers, group, manager, security, to_stock, values)


def carried_state(
    frame: DataFrame, entity: str, period_number: Column, value: str, decay: float, output: str = "state"
) -> DataFrame:
    """Exponentially decayed state over consecutive periods, reset after an absence.

    ``state = decay * previous + (1 - decay) * value`` where the previous state is zero on an
    entity's first period and after a gap. An entity has one row per period, so its history is
    bounded by the number of periods; runs are further split at gaps.
    """
    history = Window.partitionBy(entity).orderBy("_period")
    runs = (
        frame.withColumn("_period", period_number)
        .withColumn("_starts", F.when(F.col("_period") - F.lag("_period").over(history) == 1, 0).otherwise(1))
        .withColumn("_run", F.sum("_starts").over(history.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # One array per run, folded once; every state is emitted from the same pass.
    columns = [c for c in frame.columns if c != entity]
    rows = F.array_sort(F.collect_list(F.struct("_period", *columns)))
    listed = runs.groupBy(entity, "_run").agg(rows.alias("_rows"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, row: Column) -> Column:
        state = acc["s"] * decay + row[value].cast("double") * (1.0 - decay)
        return F.struct(state.alias("s"), F.concat(acc["all"], F.array(state)).alias("all"))

    states = F.aggregate("_rows", start, step, lambda acc: acc["all"])
    zipped = F.arrays_zip(F.col("_rows").alias("row"), states.alias("state"))
    return listed.select(entity, F.explode(zipped).alias("_z")).select(
        *[F.col(entity) if c == entity else F.col(f"_z.row.{c}").alias(c) for c in frame.columns],
        F.col("_z.state").alias(output),
    )
