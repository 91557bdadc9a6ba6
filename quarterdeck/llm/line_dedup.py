"""Fuzzy repeated lines: MinHash of character shingles, exact Jaccard, one line per component.

Lines equal but for the case of A-Z are one class, named by a 64-bit digest, so copies cost
nothing from there on (two of n different lines share a digest with probability n^2 / 2^65).
A class has a one-permutation signature of its character shingles (empty bins take the value of
the first full bin on a fixed probe sequence); bands of it are buckets. Star edges of the buckets
are confirmed by the exact Jaccard similarity of the two lines' shingle sets; lines of buckets
that are then still not of one component are joined exactly (``setjoin``). Components are
labelled by rounds of large-star and small-star steps. The first line of a component, by
document id and then place, is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm import bitfilter
from quarterdeck.llm.near_dup import probe_table
from quarterdeck.llm.setjoin import candidate_pairs
from quarterdeck.llm.stars import confirmed_components
from quarterdeck.llm.textbytes import distinct_sorted, lookup, mix, pieces, prefix_sums, span_hash
from quarterdeck.session import cut_lineage, release

_FOLD = lookup(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_BAND = np.uint64(0xA0761D6478BD642F)
_FILTER_BITS = 24
_SEEN = 500_000
_PIECE = 1 << 18
_LINE_BITS = 13
_PAIRS = 1000
_BAND_BITS = 24
_CENTRES = 8


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends, text number and place of all lines that are not blank."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < len(data)]
    owner = np.searchsorted(offsets, start, "right") - 1
    # A line ends at its break or where its text ends.
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], offsets[owner + 1])
    before = np.searchsorted(breaks, start)
    place = before - np.searchsorted(breaks, offsets[owner])
    ink = np.concatenate(([0], np.cumsum(_FOLD[0][data])))
    kept = ink[stop] > ink[start]
    return start[kept], stop[kept], owner[kept], place[kept]


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    raw = _FOLD[1][data].tobytes()
    joined = b"".join(
        hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)
    )
    return np.frombuffer(joined, np.int64)


def shingle_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int):
    """(line, byte start, byte end) of all shingles of ``size`` characters; a shorter line is one shingle."""
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(chars, start), np.searchsorted(chars, stop)
    counts = np.maximum(last - first - size + 1, 1)
    upto = np.cumsum(counts)
    line = np.repeat(np.arange(len(start)), counts)
    at = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - counts - first, counts)
    ends = np.append(chars, len(data))
    return line, chars[at], np.minimum(ends[np.minimum(at + size, len(chars))], stop[line])


def packed_shingles(line: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of lines: a line's number above the top bits of the hash.

    All but _LINE_BITS bits of a hash are kept, so the count of a line's n shingles is short by one
    with probability n^2 / 2^51.
    """
    packed = (line.astype(np.uint64) << np.uint64(64 - _LINE_BITS)) | (hashes >> np.uint64(_LINE_BITS))
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    return packed[new]


def signatures(packed: np.ndarray, lines: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, shingle counts): densified one-permutation signatures (lines x bins) of ``packed_shingles``."""
    line = (packed >> np.uint64(64 - _LINE_BITS)).astype(np.int64)
    # The first 32 bits of the hash choose the bin, all kept bits are its value; sorted, a bin's first is its smallest.
    value = packed << np.uint64(_LINE_BITS)
    cell = line * bins + (((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    flat, full = np.zeros(lines * bins, np.uint64), np.zeros(lines * bins, bool)
    flat[cell[lead]] = value[lead]
    full[cell[lead]] = True
    open_, probes, turn = np.flatnonzero(~full), probe_table(bins), 0
    out = flat.copy()
    while len(open_) and turn < probes.shape[1]:
        row = open_ // bins
        source = row * bins + probes[open_ % bins, turn]
        hit = full[source]
        out[open_[hit]] = flat[source[hit]]
        open_ = open_[~hit]
        turn += 1
    for cell_ in open_:  # no probe met a full bin
        row = cell_ // bins
        own = slice(row * bins, (row + 1) * bins)
        out[cell_] = flat[own][full[own]].min()
    return out.reshape(lines, bins), np.bincount(line, minlength=lines)


def line_bands(data: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int, bands: int, band_rows: int):
    """(band keys, shingle counts) of lines."""
    all_keys, all_counts = [np.zeros((0, bands), np.uint64)], [np.zeros(0, np.int64)]
    for first in range(0, len(start), 1 << _LINE_BITS):
        own = slice(first, first + (1 << _LINE_BITS))
        base = start[first]
        part = data[base : stop[own][-1]]
        line, a, b = shingle_spans(part, start[own] - base, stop[own] - base, size)
        packed = packed_shingles(line, span_hash(prefix_sums(part, _FOLD[1]), a, b))
        rows, counts = signatures(packed, len(start[own]), bands * band_rows)
        keys = np.zeros((len(rows), bands), np.uint64)
        for r in range(band_rows):
            keys = mix(keys * _BAND + rows[:, r::band_rows])
        all_keys.append(mix(keys + mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))))
        all_counts.append(counts)
    return np.concatenate(all_keys), np.concatenate(all_counts)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _row, line_no, class) of all lines that are not blank."""
    for batch in batches:
        for first, _, data, offsets in pieces(batch.column("text")):
            start, stop, owner, place = line_spans(data, offsets)
            at = pa.array(first + owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("_row").take(at), pa.array(place, pa.int64()), pa.array(_digests(data, start, stop))],
                ["doc_id", "_row", "line_no", "class"],
            )


def _class_arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield mix(batch.column("class").to_numpy().view(np.uint64).copy())


class _Bands:
    """Bands of the lines of a batch whose class repeats in the corpus, or of all other lines."""

    def __init__(self, size: int, bands: int, band_rows: int, shared, repeated: bool):
        self.shape, self.shared, self.repeated = (size, bands, band_rows), shared, repeated

    def __call__(self, batch: pa.RecordBatch, seen: set[int] | None = None):
        """(classes, shingle counts, band keys) of stretches of lines; each class once while ``seen`` holds it."""
        for _, _, data, offsets in pieces(batch.column("text"), _PIECE):
            start, stop, _, _ = line_spans(data, offsets)
            classes = _digests(data, start, stop)
            place = (mix(classes.view(np.uint64).copy()) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
            mine = bitfilter.contains(self.shared.value, place) == self.repeated
            if seen is not None:
                if len(seen) > _SEEN:
                    seen.clear()
                for i in np.flatnonzero(mine).tolist():
                    c = int(classes[i])
                    mine[i] = c not in seen
                    seen.add(c)
            if mine.any():
                keys, counts = line_bands(data, start[mine], stop[mine], *self.shape)
                yield classes[mine], counts, keys

    def keys(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, keys in self(batch):
            yield keys.ravel()

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for classes, counts, keys in self(batch, seen):
                cuts = np.arange(len(classes) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes), pa.array(counts), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.ravel().view(np.int64)))],
                    ["node", "n", "bands"],
                )

    def entries(self, table):
        """(key, node, n) of keys that may be met by another class."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for classes, counts, keys in self(batch):
                    yield _entries(classes, counts, keys, table.value)

        return run


def _entries(classes: np.ndarray, counts: np.ndarray, keys: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    may = bitfilter.contains(table, (keys >> np.uint64(64 - _BAND_BITS)).astype(np.int64))
    rows = np.nonzero(may)[0]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[may].view(np.int64)), pa.array(classes[rows]), pa.array(counts[rows])], ["key", "node", "n"]
    )


def _stored_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column("bands").flatten().to_numpy().view(np.uint64)


def _stored_entries(bands: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("bands").flatten().to_numpy().view(np.uint64).reshape(-1, bands)
            yield _entries(batch.column("node").to_numpy(), batch.column("n").to_numpy(), keys, table.value)

    return run


def _class_texts(shared):
    """(node, line) of lines whose class may be wanted, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                start, stop, _, _ = line_spans(data, offsets)
                classes = _digests(data, start, stop)
                place = (mix(classes.view(np.uint64).copy()) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
                nodes, texts = [], []
                raw = _FOLD[1][data].tobytes()
                if len(seen) > _SEEN:
                    seen.clear()
                for i in np.flatnonzero(bitfilter.contains(shared.value, place)).tolist():
                    if (c := int(classes[i])) not in seen:
                        seen.add(c)
                        nodes.append(c)
                        texts.append(raw[start[i] : stop[i]])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.binary())], ["node", "line"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = mix(batch.column("node").to_numpy().view(np.uint64).copy()) >> np.uint64(64 - _FILTER_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64))], ["place"])


def _shingles(line: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(line, np.uint8)
    _, a, b = shingle_spans(data, np.array([0]), np.array([len(data)]), size)
    return distinct_sorted(span_hash(prefix_sums(data, _FOLD[1]), a, b))


def _distinct_lines(column: pa.Array, size: int):
    """(number of each row's line, offsets, shortened shingle hashes, lines) of the different lines of a column.

    The hashes of a line are sorted and distinct; _LINE_BITS of them are cut off.
    """
    coded = column.dictionary_encode()
    lines = coded.dictionary.to_pylist()
    ends = np.cumsum([len(x) for x in lines], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    data = np.frombuffer(b"".join(lines), np.uint8)
    line, a, b = shingle_spans(data, starts, ends, size)
    packed = packed_shingles(line, span_hash(prefix_sums(data, _FOLD[1]), a, b))
    upto = np.searchsorted(packed >> np.uint64(64 - _LINE_BITS), np.arange(len(lines) + 1, dtype=np.uint64))
    return coded.indices.to_numpy(), upto, packed << np.uint64(_LINE_BITS), lines


def _expanded(rows: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Shingles of each row's line, with the row's number in the low bits, which are free."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    at = np.repeat(offsets[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return hashes[at] | np.repeat(np.arange(len(rows), dtype=np.uint64), lengths)


def _confirmed(size: int, percent: int):
    """Pairs of lines that reach the similarity: counted for a whole batch at once, then held against the full hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _PAIRS):
                own = batch.slice(first, _PAIRS)
                n = own.num_rows
                number, offsets, hashes, lines = _distinct_lines(
                    pa.concat_arrays([own.column("left_line"), own.column("right_line")]), size
                )
                counts, x, y = np.diff(offsets), number[:n], number[n:]
                keys = np.concatenate((_expanded(x, offsets, hashes), _expanded(y, offsets, hashes)))
                keys.sort()
                twice = keys[1:][keys[1:] == keys[:-1]] & np.uint64((1 << _LINE_BITS) - 1)
                shared = np.bincount(twice.astype(np.int64), minlength=n)
                # Shortened hashes err by one or two at most, and very rarely: whole hashes decide near and above the limit.
                keep = 100 * (shared + 2) >= percent * (counts[x] + counts[y] - shared - 2)
                for i in np.flatnonzero(keep).tolist():
                    one, two = _shingles(lines[x[i]], size), _shingles(lines[y[i]], size)
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(one) + len(two) - common)
                yield own.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _item_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingles(line, size).tobytes() for line in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("part"), pa.array(sets, pa.binary())], ["node", "part", "items"]
            )

    return run


def fuzzy_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 7, percent: int = 80,
    bands: int = 24, band_rows: int = 6,
) -> DataFrame:
    """(doc_id, line_no, component_doc, component_line, kept) for every line that is not blank.

    ``line_no`` counts the lines of a text from 0, blank ones too; blank lines, and null and
    empty texts, give no row and stay as they are. A line's component is named by its first
    line, the one that is kept. Null ids come last; rows that repeat an id are separate texts.
    A pair at the threshold itself shares a bucket with probability 0.9993, at 0.85 with 0.99998
    (lines of few shingles somewhat less). A text of any length is handled in pieces of whole texts. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
        F.col(text_column).cast("string").alias("text"),
    )
    lines = cut_lineage(source.mapInArrow(_lines, "doc_id long, _row long, line_no long, class long"))
    # Bands are computed where the texts are, twice, and never stored, but for lines that repeat as they are: those
    # are made one row first.
    texts_only = source.select("text")
    repeated = spark.sparkContext.broadcast(bitfilter.build_repeated((lines.select("class"), _class_arrays), bits=_FILTER_BITS))
    single = _Bands(size, bands, band_rows, repeated, False)
    common = cut_lineage(
        texts_only.mapInArrow(_Bands(size, bands, band_rows, repeated, True).rows, "node long, n long, bands array<long>").dropDuplicates(["node"])
    )
    table = spark.sparkContext.broadcast(
        bitfilter.build_repeated((texts_only, single.keys), (common.select("bands"), _stored_keys), bits=_BAND_BITS)
    )
    shape = "key long, node long, n long"
    entries = texts_only.mapInArrow(single.entries(table), shape).unionByName(common.mapInArrow(_stored_entries(bands, table), shape))
    entries = cut_lineage(entries)
    dealt = entries.repartition("key").groupBy("key", "node").agg(F.min("n").alias("n"))
    several = dealt.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = cut_lineage(dealt.join(several.select("key"), "key"))
    release(common)
    release(entries)

    # The texts of all lines that share a bucket with another, fetched in one further pass.
    ends = cut_lineage(buckets.select("node").distinct())
    table = bitfilter.build(ends.mapInArrow(_places, "place long"), "place", _FILTER_BITS)
    shared = spark.sparkContext.broadcast(table)  # 2^24 bits
    texts = source.select("text").mapInArrow(_class_texts(shared), "node long, line binary")
    texts = cut_lineage(texts.join(ends, "node", "left_semi").dropDuplicates(["node"]))

    def confirm(edges: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("left_line"))
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("right_line"))
        return edges.join(left, "a").join(right, "b").select("a", "b", "left_line", "right_line").mapInArrow(
            _confirmed(size, percent), "a long, b long"
        )

    def finish(rest: DataFrame) -> DataFrame:
        sets = cut_lineage(
            texts.join(rest, "node").select("node", "part", "line").mapInArrow(
                _item_sets(size), "node long, part long, items binary"
            )
        )
        pairs = candidate_pairs(sets, percent)
        release(sets)
        return confirm(pairs)

    labels = confirmed_components(buckets, confirm, finish, percent, centres=_CENTRES)
    for stage in (buckets, ends, texts):
        release(stage)
    named = lines.select("doc_id", "_row", "line_no", F.col("class").alias("node"))
    if labels is not None:
        named = named.join(labels, "node", "left")
    else:
        named = named.withColumn("component", F.lit(None).cast("long"))
    named = named.withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "line_no")
    firsts = named.groupBy("component").agg(F.min(order).alias("f"))
    return named.join(firsts, "component").select(
        "doc_id", "line_no", F.col("f.doc_id").alias("component_doc"), F.col("f.line_no").alias("component_line"),
        ((F.col("_row") == F.col("f._row")) & (F.col("line_no") == F.col("f.line_no"))).alias("kept"),
    )


def without_lines(docs: DataFrame, decisions: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the lines dropped that ``decisions`` (of ``fuzzy_lines``) do not keep; ids must be unique.

    Everything else of a text stays as it is, blank lines included; documents without a dropped line are untouched.
    """
    dropped = decisions.where(~F.col("kept")).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    # The row goes through whole, in one column, so that its columns may have any names.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col(id_column).alias("_own"))
    own = F.col("_doc").getField(text_column)
    rest = F.filter(F.transform(F.split(own, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))),
                    lambda p: ~F.array_contains("_gone", p["i"]))
    text = F.when(F.col("_gone").isNull(), own).otherwise(F.array_join(F.transform(rest, lambda p: p["x"]), "\n"))
    joined = whole.join(dropped, F.col("_own") == F.col("_id"), "left")
    return joined.select(F.col("_doc").withField(text_column, text).alias("_doc")).select("_doc.*")
