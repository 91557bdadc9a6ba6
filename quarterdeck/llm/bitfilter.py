"""Bit tables of fixed size that keep rows without a partner out of a shuffle.

A table is built by grouped bit-or and gathered as at most 2^bits / 64 numbers, whatever the
size of the data. What passes may still lack a partner; the join decides. With far more keys
than bits nearly everything passes and the join alone does the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a task sorts together.
HELD_KEYS = 1_000_000


def place_of(key: Column, bits: int) -> Column:
    """Place of a key in a table of 2^bits bits."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def build(keys: DataFrame, place: str, bits: int) -> np.ndarray:
    """Table in which the bits at column ``place`` are set."""
    words = keys.select(
        F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, CAST({place} & 63 AS INT))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table


def _key_slices(arrays: Callable[[pa.RecordBatch], Iterator[np.ndarray]], slice_bits: int):
    """Sorted keys of a stretch of rows by slice of the key range: those met once, and those met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        limits = np.arange(1, 1 << slice_bits, dtype=np.uint64) << np.uint64(64 - slice_bits)

        def out():
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            again = np.diff(np.append(first, len(keys))) > 1
            keys = keys[first]
            edges = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
            rows = [
                (s, keys[a:b][~again[a:b]].tobytes(), keys[a:b][again[a:b]].tobytes())
                for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]],
                ["slice", "once", "again"],
            )

        for batch in batches:
            for keys in arrays(batch):
                held.append(keys)
                size += len(keys)
                if size > HELD_KEYS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _bit_words(bits: int):
    """(word, bits) of keys that occur twice, one slice of the key range after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, once, again = None, [], []

        def out():
            keys = np.sort(np.concatenate(once)) if once else np.zeros(0, np.uint64)
            keys = np.concatenate((keys[1:][keys[1:] == keys[:-1]], *again))
            place = np.unique(keys >> np.uint64(64 - bits))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            set_ = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
            return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(set_.view(np.int64))], ["word", "bits"])

        for batch in batches:
            for s, a, b in zip(batch.column("slice").to_pylist(), batch.column("once"), batch.column("again"), strict=True):
                if s != number:
                    if number is not None:
                        yield out()
                    number, once, again = s, [], []
                fresh, twice = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                once.append(np.concatenate((fresh, twice)))
                again.append(twice)
                if len(once) > 64:  # hold each key once, and once more if it is known to repeat
                    keys = np.sort(np.concatenate(once))
                    again = [np.unique(np.concatenate((keys[1:][keys[1:] == keys[:-1]], *again)))]
                    once = [np.unique(keys)]
        if number is not None:
            yield out()

    return run


def build_repeated(*parts: tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[np.ndarray]]], bits: int) -> np.ndarray:
    """Table of the places (top bits) of 64-bit keys that occur at least twice in all parts together.

    A part is a frame and a function that yields a batch's keys; they must be spread over the whole range. Keys move as packed
    arrays, by slices of the range, whose number grows with the session's shuffle partitions; a
    slice never shares a word of the table with another.
    """
    slices = min(max(8, int(parts[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1), bits - 6)
    packed = None
    for frame, arrays in parts:
        own = frame.mapInArrow(_key_slices(arrays, slices), "slice long, once binary, again binary")
        packed = own if packed is None else packed.unionByName(own)
    rows = packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(_bit_words(bits), "word long, bits long").toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table


def contains(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> 6] >> (place & 63)) & 1 == 1


def without_ids(frame: DataFrame, ids: DataFrame, id_column: str = "doc_id", bits: int = 24) -> DataFrame:
    """Rows of ``frame`` whose id is not among ``ids`` (one column of that name).

    Rows whose bit is not set cannot be among them and stay where they are; only the others,
    which are about as many as there are ids, are shuffled to be compared. Null ids stay.
    """
    place = place_of(F.col(id_column), bits)
    own = "_place"
    while own in frame.columns:
        own += "_"
    table = build(ids.select(place.alias(own)), own, bits)
    shared = frame.sparkSession.sparkContext.broadcast(table)  # 2^bits bits
    placed = frame.withColumn(own, F.when(F.col(id_column).isNotNull(), place))

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(own)
                hit = contains(shared.value, at.fill_null(0).to_numpy()) & at.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == wanted)).drop_columns([own])

        return run

    rest = placed.mapInArrow(part(True), frame.schema).join(ids.select(id_column), id_column, "left_anti")
    return placed.mapInArrow(part(False), frame.schema).unionByName(rest.select(*frame.columns))
