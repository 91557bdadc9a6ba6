"""Approximate nearest neighbours by collision counting over sorted projections.

Every vector is projected on m random directions; each direction's projections form a sorted
array. A query opens a window around its own projection in every array and counts, for each
vector, the arrays whose window holds it. Two points at distance s fall into a window of radius
w R / 2 with a probability that depends on s / R only, so the windows of a larger R are the same
arrays opened wider (virtual rehashing): only the new ends are read. A vector whose count
reaches the threshold is verified, that is compared on the original components. A query is done
once its k-th verified distance is at most R.

The largest inner product becomes the smallest distance by one more component: vectors are
scaled by the largest norm and completed to length one, queries are scaled to length one.

Vectors are dealt into blocks of bounded size by a hash of their id, queries into blocks as
well; a task holds one pair of blocks. Each block is indexed whole; only the first radius and
the bound at which a query may stop are fitted, on a sample of ``sample_rows`` vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.session import cut_lineage

_GROWTH = 1.1


@lru_cache(maxsize=4)
def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dim, projections))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


class CollisionIndex:
    """Sorted projection arrays of one block of completed vectors."""

    def __init__(self, points: np.ndarray, projections: int, width: float, confidence: float):
        if projections > 255:
            raise ValueError("counts are kept in one byte")
        # Single precision serves counting and stopping; results are scored in double precision.
        self.points, self.width = points.astype(np.float32), width
        self.axes = directions(points.shape[1], projections)
        shadow = (points @ self.axes).T
        self.order = np.argsort(shadow, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(shadow, self.order.astype(np.int64), axis=1)
        # A point at distance R collides with this probability; the threshold is met but for ``confidence`` deviations.
        p = erf(width / 2 / sqrt(2))
        self.threshold = max(1, int(np.floor(projections * p - confidence * np.sqrt(projections * p * (1 - p)))))

    def search(self, queries: np.ndarray, itself: np.ndarray, bounds: np.ndarray, k: int, radius: float):
        """(query, places of verified vectors) for each query, as its stopping rule is met."""
        shadows = queries @ self.axes
        queries = queries.astype(np.float32)
        m, total = self.order.shape
        active = np.arange(len(queries))
        counts = np.zeros((len(queries), total), np.uint8)
        low = np.zeros((len(queries), m), np.int64)
        high = low.copy()
        verified = [np.zeros(0, np.int64) for _ in queries]
        nearest_ = np.full((len(queries), k), np.inf)
        reach = radius
        while len(active):
            half = self.width * reach / 2
            begin, end = np.zeros((len(active), m), np.int64), np.zeros((len(active), m), np.int64)
            for i in range(m):
                begin[:, i] = np.searchsorted(self.sorted[i], shadows[active, i] - half)
                end[:, i] = np.searchsorted(self.sorted[i], shadows[active, i] + half, "right")
            left = []
            for at, q in enumerate(active):
                if reach == radius:
                    parts = [o[a:b] for o, a, b in zip(self.order, begin[at], end[at], strict=True)]
                else:
                    parts = [o[a:b] for o, a, b in zip(self.order, begin[at], low[q], strict=True)]
                    parts += [o[a:b] for o, a, b in zip(self.order, high[q], end[at], strict=True)]
                low[q], high[q] = begin[at], end[at]
                before = counts[q] >= self.threshold
                counts[q] += np.bincount(np.concatenate(parts), minlength=total).astype(np.uint8)
                fresh = np.flatnonzero((counts[q] >= self.threshold) & ~before)
                fresh = fresh[fresh != itself[q]]
                if len(fresh):
                    gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.points[fresh] @ queries[q])))
                    merged = np.concatenate((nearest_[q], gaps))
                    if merged.size > k:
                        nearest_[q] = np.partition(merged, k - 1)[:k]
                    verified[q] = np.concatenate((verified[q], fresh))
                everything = len(verified[q]) + (itself[q] >= 0) == total
                if min(nearest_[q].max(), bounds[q]) <= reach or everything:
                    yield q, verified[q]
                else:
                    left.append(q)
            active = np.array(left, np.int64)
            reach *= _GROWTH


def _complete(vectors: np.ndarray, largest: float) -> np.ndarray:
    scaled = vectors / largest
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.column_stack((scaled, rest))


def _as_queries(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack((vectors / np.linalg.norm(vectors, axis=1)[:, None], np.zeros(len(vectors))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("vec_id", kind="stable")
    data = np.stack(group["vector"].to_numpy()).astype(np.float64)
    return pd.DataFrame(
        {"block": [int(group["block"].iloc[0])], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]}
    )


def _searched(dim: int, largest: float, sample: np.ndarray, radius: float, k: int, projections: int, width: float, confidence: float):
    completed = _complete(sample, largest) if len(sample) else np.zeros((0, dim + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, ids, vectors = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                if block != held:
                    ids = np.frombuffer(batch.column("ids")[row].as_buffer(), np.int64)
                    vectors = np.frombuffer(batch.column("data")[row].as_buffer(), np.float64).reshape(-1, dim)
                    index, held = CollisionIndex(_complete(vectors, largest), projections, width, confidence), block
                asked = np.frombuffer(batch.column("q_ids")[row].as_buffer(), np.int64)
                raw = np.frombuffer(batch.column("q_data")[row].as_buffer(), np.float64).reshape(-1, dim)
                queries = _as_queries(raw)
                place = np.searchsorted(ids, asked)
                place = np.where((place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == asked), place, -1)
                bounds = np.full(len(queries), np.inf)
                if len(completed) > k + 1:
                    # The sample may hold the query itself: one neighbour more bounds the k-th.
                    gaps = np.maximum(0.0, 2.0 - 2.0 * queries @ completed.T) if len(completed) else None
                    bounds = np.sqrt(np.partition(gaps, k, axis=1)[:, k]) + 1e-9
                out_q, out_v, out_s = [], [], []
                for q, candidates in index.search(queries, place, bounds, k, radius):
                    rough = index.points[candidates] @ queries[q].astype(np.float32)
                    if len(rough) > k:  # those that rounding cannot have put below the k-th
                        candidates = candidates[rough >= np.partition(rough, -k)[-k] - 1e-5]
                    scores = np.einsum("ij,j->i", vectors[candidates], raw[q])
                    best = np.lexsort((ids[candidates], -scores))[:k]
                    out_q.append(np.full(len(best), asked[q]))
                    out_v.append(ids[candidates][best])
                    out_s.append(scores[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def nearest(
    vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20,
    projections: int = 48, width: float = 1.5, confidence: float = 0.9, block_rows: int = 16_384,
    query_rows: int = 1_024, sample_rows: int = 2_048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row that ``queries`` selects.

    Vectors that are null or zero, or hold a null or non-finite component, take no part, nor do
    those with a null id or of another length than the commonest (the longest of these). Rows
    that repeat an id count once, with their smallest vector. Ties go to the smaller id; a query
    is never its own neighbour. Other columns are not read. With fewer than k other vectors all
    are returned. Scores are taken in double precision on the original components.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"),
        queries.alias("asked"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asked").alias("asked")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], shape)
    dim, total = sizes["dim"], sizes["count"]
    rows = rows.where(F.size("vector") == dim)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    largest = float(np.sqrt(rows.agg(F.max(norm)).first()[0])) * (1 + 1e-9)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").collect()
    sample = np.array([r["vector"] for r in drawn], np.float64).reshape(-1, dim)
    blocks, asked_blocks = -(-total // block_rows), -(-rows.where("asked").count() // query_rows)
    if asked_blocks == 0:
        return spark.createDataFrame([], shape)
    radius = _first_radius(_complete(sample, largest), _as_queries(sample[:256]), k, total)

    def packed(frame: DataFrame, count: int) -> DataFrame:
        dealt = frame.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(count)))
        return dealt.groupBy("block").applyInPandas(_pack, "block long, ids binary, data binary")

    stored = cut_lineage(packed(rows.select("vec_id", "vector"), blocks))
    asked = cut_lineage(packed(rows.where("asked").select("vec_id", "vector"), asked_blocks))
    asked = asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # Every query block meets every vector block once: rows here are blocks.
    pairs = stored.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked_blocks - 1).cast("long"))))
    pairs = pairs.join(asked, "q_block").repartition("block", "q_block").sortWithinPartitions("block")
    found = pairs.mapInArrow(
        _searched(dim, largest, sample, radius, k, projections, width, confidence), "query_id long, vec_id long, score double"
    )
    # At most k per query and vector block are left.
    order = F.struct((-F.col("score")).alias("below"), "vec_id", "score")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "b.vec_id", "b.score"
    )


def _first_radius(points: np.ndarray, queries: np.ndarray, k: int, total: int) -> float:
    """Just below the typical distance at which a query has k neighbours, from the sample."""
    if len(points) < 2 or not len(queries):
        return 1.0
    gaps = np.sort(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * queries @ points.T)), axis=1)
    # The first neighbour is the row itself; the sample's next ones are no nearer than the k-th of all.
    place = min(len(points) - 1, max(1, round(k * len(points) / total)))
    near = gaps[:, place]
    near = near[near > 1e-3]
    return float(np.median(near)) * 0.9 if len(near) else 1e-3
