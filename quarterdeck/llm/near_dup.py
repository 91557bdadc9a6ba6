"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges, exact check.

1. A document is the set of hashes of its distinct word shingles. Documents with equal sets
   (compared by a 128-bit digest) are one class, so copies cost one row each from there on.
2. One permutation: the hash range is cut into bins, and a bin's value is its smallest hash. An
   empty bin takes the value of the first non-empty bin on a fixed random probe sequence of its
   own (optimal densification), so small sets have full signatures too.
3. Bins are grouped into bands; classes that agree on a band share a bucket. A bucket links each
   member to its smallest member only, so a bucket of n gives n - 1 candidate edges, not n^2.
4. Candidates are confirmed on the full sets. A bucket whose members then still lie in different
   components gets further stars with other centres, while they confirm much. Members of buckets
   that are still not of one component are then joined exactly (``setjoin``), so a pair that shares
   a bucket is never lost.
5. Components are labelled by their smallest document id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm import bitfilter
from quarterdeck.llm.setjoin import candidate_pairs
from quarterdeck.llm.stars import confirmed_components
from quarterdeck.llm.textbytes import NON_SPACE, distinct_sorted, gram_hashes, mix, pieces, word_hashes
from quarterdeck.session import cut_lineage

_BAND = 0xC2B2AE3D27D4EB4F
_PROBES = 256
_FILTER_BITS = 24


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order."""
    for first, end, data, offsets in pieces(texts):
        words, _, _, at = word_hashes(data, offsets, NON_SPACE)
        grams = gram_hashes(words, size)
        for d in range(end - first):
            a, b = at[d], at[d + 1]
            if b - a >= size:
                yield distinct_sorted(grams[a : b - size + 1])
            elif b > a:
                yield gram_hashes(words[a:b], int(b - a))
            else:
                yield words[:0]


@lru_cache(maxsize=4)
def probe_table(bins: int) -> np.ndarray:
    """Probe sequence of each bin: ``bins`` rows of bin numbers."""
    cells = np.arange(bins * _PROBES, dtype=np.uint64) + np.uint64(0x51ED270B)
    return (mix(cells) % np.uint64(bins)).astype(np.int64).reshape(bins, _PROBES)


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty set of hashes."""
    cell = (((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    lead = np.concatenate(([True], cell[1:] != cell[:-1]))
    out = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    out[cell[lead]] = values[lead]
    full[cell[lead]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[probe_table(bins)[empty]]
        found = hit.argmax(axis=1)
        source = probe_table(bins)[empty, found]
        lost = ~hit[np.arange(len(empty)), found]
        if lost.any():  # no probe met a full bin: the next full bin upwards, around the end
            there = np.flatnonzero(full)
            source[lost] = there[np.searchsorted(there, empty[lost]) % len(there)]
        out[empty] = out[source]
    return out


def _profiles(size: int, bins: int, band_rows: int):
    bands = bins // band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            counts, digests, signatures = [], [], []
            for values in shingle_sets(batch.column("text"), size):
                counts.append(len(values))
                if len(values):
                    digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    signatures.append(signature(values, bins))
                else:
                    digests.append(None)
            full = np.array([c > 0 for c in counts], bool)
            rows = np.array(signatures, np.uint64).reshape(len(signatures), bins)[:, : bands * band_rows]
            keys = np.zeros((len(rows), bands), np.uint64)
            for r in range(band_rows):
                keys = mix(keys * np.uint64(_BAND) + rows[:, r::band_rows])
            keys = mix(keys + numbers).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def _sets(size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitfilter.contains(shared.value, batch.column("place").to_numpy())))
            sets = [values.tobytes() for values in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["node", "items"])

    return run


def _confirmed(percent: int):
    """Keep pairs of sets with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left_items"), batch.column("right_items"), strict=True):
                a = np.frombuffer(left.as_buffer(), np.uint64)
                b = np.frombuffer(right.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((a, b)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 85,
    bins: int = 160, band_rows: int = 5, max_rounds: int = 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Null, empty and blank texts have no shingles and are linked with nothing (component_id is
    their own id). Rows with a null id take no part: their component_id is null and they are
    kept. Rows that repeat an id count as one document and all carry its component. Other
    columns of ``docs`` are not read. With the default 32 bands of 5, a pair at the threshold
    itself is missed with probability below 1e-8 per bucket search.
    """
    ids = F.col(id_column).cast("long").alias("doc_id")
    source = docs.select(ids, F.col(text_column).cast("string").alias("text"))
    profile = cut_lineage(
        source.mapInArrow(
            _profiles(shingle, bins, band_rows), "doc_id long, n_shingles long, digest binary, bands array<long>"
        )
    )
    named = profile.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Equal sets have equal bands; the grouped minimum is combined in each task, however large a group of copies is.
    classes = cut_lineage(
        named.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        )
    )
    entries = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    # Only buckets with two classes or more are stored.
    buckets = cut_lineage(entries.join(shared.select("key"), "key").distinct())
    repeated = not named.groupBy("doc_id").count().where("count > 1").isEmpty()

    def finish(rest: DataFrame) -> DataFrame:
        sets = _item_sets(rest.select("node"), source, shingle, repeated)
        edges = candidate_pairs(cut_lineage(sets.join(rest, "node")), percent)
        return _verified(edges, sets, percent)

    def confirm(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        return _verified(edges, _item_sets(ends, source, shingle, repeated), percent)

    labels = confirmed_components(buckets, confirm, finish, percent, max_rounds=max_rounds)
    out = profile.drop("bands").join(classes.select("digest", "node"), "digest", "left")
    if labels is not None:
        out = out.join(labels, "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _item_sets(nodes: DataFrame, source: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """(node, items): full shingle sets of the wanted nodes, stored."""
    place = bitfilter.place_of(F.col("doc_id"), _FILTER_BITS).alias("place")
    table = bitfilter.build(nodes.select(F.col("node").alias("doc_id")).select(place), "place", _FILTER_BITS)
    shared = source.sparkSession.sparkContext.broadcast(table)  # 2^24 bits
    sets = source.where("doc_id IS NOT NULL").select("doc_id", place, "text").mapInArrow(
        _sets(shingle, shared), "node long, items binary"
    ).join(nodes, "node", "left_semi")
    return cut_lineage(sets.distinct() if repeated else sets)


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges confirmed on full shingle sets."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("left_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("right_items"))
    return edges.join(left, "a").join(right, "b").select("a", "b", "left_items", "right_items").mapInArrow(
        _confirmed(percent), "a long, b long"
    ).distinct()
