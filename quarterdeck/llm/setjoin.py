"""Exact candidates of a set-similarity join, for nodes that stars left in different components.

Items of a set are ordered by rarity (any fixed order is exact; the rarest first gives the
fewest candidates). Two sets with 100 * intersection >= percent * union have their first common
item in a short prefix of both, and what may follow it bounds the intersection. Every pair of
different components that passes this bound is a candidate: nothing is capped or sampled. An
item with many sets is dealt in tiles, a task per pair of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.session import cut_lineage, release

_BITS = 18
_TILE = 512
_CHUNK = 1 << 21


def _cells(items: np.ndarray) -> np.ndarray:
    return ((items * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << _BITS, np.int64)
    for batch in batches:
        items = b"".join(batch.column("items").to_pylist())
        table += np.bincount(_cells(np.frombuffer(items, np.uint64)), minlength=1 << _BITS)
    full = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(table[full])], ["cell", "n"])


def _prefixes(percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes, places = [], [], []
            for raw in batch.column("items"):
                items = np.frombuffer(raw.as_buffer(), np.uint64)
                n = len(items)
                most = n + percent * n // -100 + 1 if n else 0
                order = np.lexsort((items, shared.value[_cells(items)]))[:most]
                tokens.append(items[order])
                sizes.append(n)
                places.append(np.arange(most))
            lengths = [len(t) for t in tokens]
            rows = np.repeat(np.arange(len(tokens)), lengths)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([none.view(np.uint64), *tokens]).view(np.int64)),
                    batch.column("node").take(pa.array(rows)), batch.column("part").take(pa.array(rows)),
                    pa.array(np.repeat(np.array(sizes, np.int64), lengths)), pa.array(np.concatenate([none, *places])),
                ],
                ["token", "node", "part", "n", "at"],
            )

    return run


def _group_pairs(percent: int):
    """Pairs (a, b), a < b, of a row's members that lie in different components and pass the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten()
            base = offsets[0]
            node, part, n, at, tile = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            crossed = batch.column("crossed").to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            upto = np.cumsum(sizes * sizes)
            first = 0
            while first < len(sizes):
                done = upto[first - 1] if first else 0
                last = max(int(np.searchsorted(upto, done + _CHUNK, "right")), first + 1)
                own = sizes[first:last]
                group = np.repeat(np.arange(first, last), own)
                x = np.arange(offsets[first] - base, offsets[last] - base)
                width = sizes[group]
                left = np.repeat(x, width)
                run_start = np.repeat(np.cumsum(width) - width, width)
                right = np.repeat(offsets[group] - base, width) + np.arange(len(left)) - run_start
                keep = (node[left] < node[right]) & (part[left] != part[right])
                keep &= ~np.repeat(crossed[group], width) | (tile[left] != tile[right])
                left, right = left[keep], right[keep]
                most = np.minimum(n[left] - at[left], n[right] - at[right])
                keep = most * (100 + percent) >= percent * (n[left] + n[right])
                pairs = np.unique(np.stack((node[left[keep]], node[right[keep]]), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
                first = last

    return run


def candidate_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: all pairs of different parts that may reach the similarity.

    ``sets`` is a stored table (node, part, items) with a row per node; ``items`` are the bytes
    of the sorted distinct 64-bit items.
    """
    rows = sets.select("items").mapInArrow(_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << _BITS, np.int64)
    table[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(table)  # 2^18 counts
    entries = cut_lineage(
        sets.select("node", "part", "items").mapInArrow(
            _prefixes(percent, shared), "token long, node long, part long, n long, at long"
        )
    )
    # The smaller set of a pair has the first common item among its first n - 2 percent n / (100 + percent).
    early = F.col("at") * (100 + percent) <= F.col("n") * (100 - percent)
    wanted = entries.groupBy("token").agg(
        F.count("*").alias("_count"), F.min("part").alias("low"), F.max("part").alias("high"), F.max(early).alias("early")
    ).where("low < high AND early").select("token", F.ceil(F.col("_count") / _TILE).alias("tiles"))
    dealt = entries.join(wanted, "token").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    member = F.struct("node", "part", "n", "at", "tile")
    groups = dealt.groupBy("token", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two")).agg(
        F.collect_list(member).alias("members"), F.min("part").alias("low"), F.max("part").alias("high")
    ).where("low < high")
    pairs = cut_lineage(
        groups.select("members", (F.col("one") != F.col("two")).alias("crossed")).mapInArrow(
            _group_pairs(percent), "a long, b long"
        ).distinct()
    )
    release(entries)
    return pairs
