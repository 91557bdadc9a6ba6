"""Bytes covered by long strings that occur earlier in the corpus, by sorted suffixes.

1. The anchor of a string of ``length`` bytes is the gram in it with the smallest hash. Equal
   strings have equal anchors, so only stretches whose anchor occurs twice in the corpus can hold
   repeats. Stretches are runs of starts with one anchor, cut out with the bytes they need.
2. Equal stretches are merged, in each task before anything is shuffled: all but the first are
   repeats from start to end. A passage in a third of all documents thus is one row a task.
3. The different stretches of an anchor meet in one task. Their suffixes are put in order
   (``deep_shallow``); of equal strings all but the first are repeats. An anchor with too many
   different stretches for a task has its strings compared by 128-bit digests instead, dealt over
   all tasks.
4. Marked starts are joined to their texts, and the bytes they cover are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm import bitfilter
from quarterdeck.llm.deep_shallow import deep_shallow_order
from quarterdeck.llm.tables import prepare, stored_with_row
from quarterdeck.llm.textbytes import mix, pieces, prefix_sums, span_hash
from quarterdeck.session import cut_lineage, release

_GRAM = 32
_BYTES = np.arange(256, dtype=np.uint8)
_FILTER_BITS = 25
_DOC_BITS = 24
_BLOCK = 1 << 18
_HELD_REGIONS = 100_000
_SORTED_STARTS = 200_000
#: Different stretches of one anchor that a task sorts together.
TASK_REGIONS = 10_000
_LAST_ID = 2**63 - 1

_REGION = "key long, d1 long, d2 long, doc long, row long, at long, n long, region binary"
_NAMES = ["key", "d1", "d2", "doc", "row", "at", "n", "region"]


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(first start, number of starts, anchor hash) of runs of strings with one anchor, in texts laid end to end."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none.view(np.uint64)
    at = np.arange(n - gram + 1)
    hashes = span_hash(prefix_sums(data, _BYTES), at, at + gram)
    bits = np.uint64(n.bit_length())
    packed = (hashes >> bits << bits) | at.astype(np.uint64)  # ties to the left
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if size < width:
        packed = np.minimum(packed[: size - width], packed[width - size :])
    anchor = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    for end in offsets[1:-1].tolist():
        inside[max(end - length + 1, 0) : end] = False
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    start = np.flatnonzero(first)
    # Smallest hashes crowd at the low end; mixed anew they fill the whole range.
    return start, np.flatnonzero(last) + 1 - start, mix(hashes[anchor[start]])


def _blocks(column: pa.Array, length: int):
    """(first row, bytes, offsets, place of the first byte) of whole texts, or of overlapping parts of a very long one."""
    for first, _, data, offsets in pieces(column, _BLOCK):
        if len(offsets) > 2 or len(data) <= 2 * _BLOCK:
            yield first, data, offsets, 0
            continue
        for at in range(0, len(data) - length + 1, _BLOCK):
            part = data[at : at + _BLOCK + length - 1]
            yield first, part, np.array([0, len(part)]), at


def _anchors(length: int, gram: int):
    def arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets, _ in _blocks(batch.column("text"), length):
            yield anchored_runs(data, offsets, length, gram)[2]

    return arrays


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _spans(doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Runs of starts (doc, row, at, n) sorted and merged where they touch or overlap inside a document."""
    order = np.lexsort((at, row, doc))
    doc, row, at, n = doc[order], row[order], at[order], n[order]
    if not len(doc):
        return doc, row, at, n
    owner = np.ones(len(doc), bool)
    owner[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    # Within a document the furthest end so far decides; documents are kept apart by a large step.
    step = np.cumsum(owner) * np.int64(1 << 40)
    reach = np.maximum.accumulate(at + n + step)
    first = owner.copy()
    first[1:] |= (at + step)[1:] > reach[:-1]
    heads = np.flatnonzero(first)
    ends = reach[np.append(heads[1:] - 1, len(doc) - 1)] - step[heads]
    return doc[heads], row[heads], at[heads], ends - at[heads]


def _mark_batch(doc, row, at, n) -> pa.RecordBatch:
    doc, row, at, n = _spans(doc, row, at, n)
    void = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays(
        [void, void, void, pa.array(doc), pa.array(row), pa.array(at), pa.array(n), pa.nulls(len(doc), pa.binary())], _NAMES
    )


class _Regions:
    """Stretches gathered in a task; equal ones are merged before they leave it."""

    def __init__(self):
        self.parts, self.raw = [], []

    def add(self, keys, doc, row, at, n, raw: list[bytes]) -> None:
        digests = np.frombuffer(b"".join(map(_digest, raw)), np.int64).reshape(-1, 2)
        self.parts.append(np.stack([keys, digests[:, 0], digests[:, 1], doc, row, at, n]))
        self.raw.extend(raw)

    def flush(self, with_bytes: bool = True) -> Iterator[pa.RecordBatch]:
        if not self.raw:
            return
        columns = np.concatenate(self.parts, axis=1)
        order = np.lexsort(columns[[5, 4, 3, 2, 1, 0]])
        columns = columns[:, order]
        first = np.ones(columns.shape[1], bool)
        first[1:] = (columns[:3, 1:] != columns[:3, :-1]).any(axis=0)
        yield _mark_batch(*columns[3:, ~first])
        raw = [self.raw[i] if with_bytes else None for i in order[first].tolist()]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns[:, first]], pa.array(raw, pa.binary())], _NAMES)
        self.parts, self.raw = [], []


def _candidate_regions(length: int, gram: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Regions()
        for batch in batches:
            docs, rows = (batch.column(c).to_numpy() for c in ("doc", "row"))
            for first, data, offsets, place in _blocks(batch.column("text"), length):
                start, n, keys = anchored_runs(data, offsets, length, gram)
                may = bitfilter.contains(shared.value, (keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64))
                start, n, keys = start[may], n[may], keys[may]
                if not len(start):
                    continue
                owner = np.searchsorted(offsets, start, "right") - 1
                raw = data.tobytes()
                cut = [raw[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                held.add(keys.view(np.int64), docs[first + owner], rows[first + owner], start - offsets[owner] + place, n, cut)
                if len(held.raw) > _HELD_REGIONS:
                    yield from held.flush()
        yield from held.flush()

    return run


def _sorted_repeats(doc, row, at, n, raw: list[bytes], length: int) -> pa.RecordBatch:
    """Marks of the strings of some stretches that equal an earlier one among them."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    region = np.repeat(np.arange(len(raw)), n)
    inner = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(sizes) - sizes)[region] + inner
    order, same = deep_shallow_order(data, starts, length)
    group = np.cumsum(~same)
    several = same.copy()
    several[:-1] |= same[1:]
    order, group = order[several], group[several]
    doc, row, at = doc[region[order]], row[region[order]], at[region[order]] + inner[order]
    by_age = np.lexsort((at, row, doc, group))
    group = group[by_age]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    keep = by_age[later]
    return _mark_batch(doc[keep], row[keep], at[keep], np.ones(len(keep), np.int64))


def _settled(length: int, most: int):
    """Marks of repeats among rows sorted by (key, digest, document, start); stretches of too frequent anchors as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # stretches of complete keys
        starts = 0
        own: list[tuple] = []  # different stretches of the current key
        key = digest = None
        crowded = False

        def done():
            nonlocal waiting, starts
            columns = [np.array([w[i] for w in waiting], np.int64) for i in range(4)]
            out = _sorted_repeats(*columns, [w[4] for w in waiting], length)
            waiting, starts = [], 0
            return out

        def as_they_are(rows):
            return pa.RecordBatch.from_arrays(
                [*[pa.nulls(len(rows), pa.int64())] * 3, *[pa.array([r[i] for r in rows], pa.int64()) for i in range(4)],
                 pa.array([r[4] for r in rows], pa.binary())], _NAMES,
            )

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in _NAMES[:7]]
            first = np.ones(len(columns[0]), bool)
            for_key = [c[1:] != c[:-1] for c in columns[:3]]
            first[1:] = for_key[0] | for_key[1] | for_key[2]
            if len(first):
                first[0] = digest != tuple(int(c[0]) for c in columns[:3])
                digest = tuple(int(c[-1]) for c in columns[:3])
            yield _mark_batch(*[c[~first] for c in columns[3:]])
            regions, crowd = batch.column("region"), []
            for i in np.flatnonzero(first).tolist():
                if columns[0][i] != key:
                    if len(own) > 1:
                        waiting.extend(own)
                        starts += sum(r[3] for r in own)
                        if starts > _SORTED_STARTS:
                            yield done()
                    own, key, crowded = [], columns[0][i], False
                item = (*[int(c[i]) for c in columns[3:]], regions[i].as_py())
                if crowded:
                    crowd.append(item)
                    continue
                own.append(item)
                if len(own) > most:
                    crowd.extend(own)
                    own, crowded = [], True
            if crowd:
                yield as_they_are(crowd)
        if len(own) > 1:
            waiting.extend(own)
        if waiting:
            yield done()

    return run


def _single_strings(length: int):
    """Every string of the stretches as a stretch of its own, without its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Regions()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in _NAMES[3:]]
            for doc, row, at, n, raw in zip(*columns, strict=True):
                ones = np.ones(n, np.int64)
                strings = [raw[i : i + length] for i in range(n)]
                held.add(ones * 0, doc * ones, row * ones, at + np.arange(n), ones, strings)
                if len(held.raw) > _HELD_REGIONS:
                    yield from held.flush(with_bytes=False)
        yield from held.flush(with_bytes=False)

    return run


def _later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of all but the first of rows sorted by (digest, document, start)."""
    last = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in _NAMES[:7]]
        if not len(columns[0]):
            continue
        later = np.zeros(len(columns[0]), bool)
        later[1:] = (columns[1][1:] == columns[1][:-1]) & (columns[2][1:] == columns[2][:-1])
        later[0] = last == (columns[1][0], columns[2][0])
        last = (columns[1][-1], columns[2][-1])
        yield _mark_batch(*[c[later] for c in columns[3:]])


def numbered_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, doc, row, text): ``doc`` and ``row`` order the documents, null ids last.

    Unique ids need no row number; otherwise the rows are stored with one, which orders those of an id.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    doc = F.coalesce("doc_id", F.lit(_LAST_ID)).alias("doc")
    if plain.select(doc).groupBy("doc").count().where("count > 1").isEmpty():
        return plain.select("doc_id", doc, F.lit(0).cast("long").alias("row"), "text")
    return stored_with_row(plain, "row").select("doc_id", doc, "row", "text")


def repeated_starts(
    source: DataFrame, length: int = 100, gram: int = _GRAM, task_regions: int = TASK_REGIONS
) -> DataFrame:
    """(doc, row, at, n): runs of n starts from byte ``at`` on whose strings occur earlier, stored; runs may touch.

    ``source`` comes from ``numbered_documents``. Strings have ``length`` bytes and lie inside one
    text; texts shorter than that, null and empty ones give no rows.
    """
    gram = min(gram, length)
    spark = source.sparkSession
    table = bitfilter.build_repeated((source.select("text"), _anchors(length, gram)), bits=_FILTER_BITS)
    shared = spark.sparkContext.broadcast(table)  # 2^25 bits: places of anchors that occur at least twice
    regions = cut_lineage(source.select("doc", "row", "text").mapInArrow(_candidate_regions(length, gram, shared), _REGION), codec="zstd")
    known = regions.where("key IS NULL")
    order = ["key", "d1", "d2", "doc", "row", "at"]
    dealt = regions.where("key IS NOT NULL").repartition("key").sortWithinPartitions(*order)
    settled = cut_lineage(dealt.mapInArrow(_settled(length, task_regions), _REGION))
    marks = known.unionByName(settled.where("region IS NULL")).select("doc", "row", "at", "n")
    crowded = settled.where("region IS NOT NULL")
    if not crowded.isEmpty():
        strings = cut_lineage(crowded.mapInArrow(_single_strings(length), _REGION))
        later = strings.where("key IS NOT NULL").repartition("d1").sortWithinPartitions("d1", "d2", "doc", "row", "at")
        marks = marks.unionByName(strings.where("key IS NULL").select("doc", "row", "at", "n")).unionByName(
            later.mapInArrow(_later_ones, _REGION).select("doc", "row", "at", "n")
        )
    stored = cut_lineage(marks)
    release(regions)
    release(settled)
    return stored


def _place(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc", "row"), 64 - bits)


def _kept(raw: bytes, marks: list[dict] | None, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Removed byte ranges (maximal) and the bytes that stay."""
    if not marks:
        return [], raw
    at, n = (np.array([m[c] for m in marks], np.int64) for c in ("at", "n"))
    zero = np.zeros(len(at), np.int64)
    _, _, start, size = _spans(zero, zero, at, n + length - 1)
    spans = list(zip(start.tolist(), (start + size).tolist(), strict=True))
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return spans, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


_OUT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(batch: pa.RecordBatch, length: int, digest: bool) -> pa.RecordBatch:
    marks = batch.column("marks").to_pylist() if "marks" in batch.schema.names else [None] * batch.num_rows
    sizes, spans, kept = [], [], []
    for text, own in zip(batch.column("text").cast(pa.large_binary()), marks, strict=True):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        cut, rest = _kept(raw, own, length)
        sizes.append(len(raw))
        spans.append(cut)
        kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
    ids, sizes = batch.column("doc_id"), pa.array(sizes, pa.int64())
    if digest:
        removed = pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())
        counts = pa.array([len(s) for s in spans], pa.int64())
        return pa.RecordBatch.from_arrays(
            [ids, sizes, removed, counts, pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )
    listed = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.RecordBatch.from_arrays([ids, sizes, listed, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def _cut(source: DataFrame, starts: DataFrame, length: int, digest: bool) -> DataFrame:
    shape = _DIGEST if digest else _OUT
    table = bitfilter.build(starts.select(_place(_DOC_BITS).alias("place")), "place", _DOC_BITS)
    shared = source.sparkSession.sparkContext.broadcast(table)  # 2^24 bits
    placed = source.withColumn("place", _place(_DOC_BITS))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bitfilter.contains(shared.value, batch.column("place").to_numpy())
            yield _result(batch.filter(pa.array(~hit)), length, digest)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bitfilter.contains(shared.value, batch.column("place").to_numpy())
            yield batch.filter(pa.array(hit)).drop_columns(["place"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch, length, digest)

    marks = starts.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    texts = placed.mapInArrow(touched, "doc_id long, doc long, row long, text string")
    cut = texts.join(marks, ["doc", "row"], "left").select("doc_id", "text", "marks").mapInArrow(finish, shape)
    return placed.mapInArrow(untouched, shape).unionByName(cut)


def without_repeats(
    docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text", task_regions: int = TASK_REGIONS
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: removed byte ranges and the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document
    with a smaller id or further left in its own. Strings are judged on the texts as they came and
    never cross texts. Null and empty texts have no bytes. Rows that repeat an id are documents of
    their own, in the order they are stored in; null ids come last. ``kept`` may start or end
    inside a character. Other columns of ``docs`` are not read.
    """
    source = numbered_documents(docs, id_column, text_column)
    return _cut(source, repeated_starts(source, length, task_regions=task_regions), length, digest=False)


def repeat_digests(
    docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text", task_regions: int = TASK_REGIONS
) -> DataFrame:
    """``without_repeats`` as (doc_id, n_bytes, n_removed, n_spans, kept_sha256), without moving what stays."""
    source = numbered_documents(docs, id_column, text_column)
    return _cut(source, repeated_starts(source, length, task_regions=task_regions), length, digest=True)
