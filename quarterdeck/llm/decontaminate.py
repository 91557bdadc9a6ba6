"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of each window of w consecutive k-grams. Any
span of k + w - 1 words that two texts share contains one window of either, and equal windows
keep the same k-gram; so with k + w - 1 equal to the wanted span no shared span is missed.
Fingerprints of documents and benchmark are joined, and each hit is extended word by word in
both directions over the carried context. Benchmark items shorter than the span are looked up
as one gram of all their words. A bit table of fixed size, built from the benchmark, keeps
fingerprints that no item has out of the shuffle; what passes it is decided by the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm import bitfilter
from quarterdeck.llm.textbytes import ALNUM, gram_hashes, mix, pieces, word_hashes
from quarterdeck.session import cut_lineage

_PRINTS = "array<struct<hash: long, place: int, words: array<string>, offset: int>>"
_PRINT_TYPE = pa.list_(
    pa.struct([("hash", pa.int64()), ("place", pa.int32()), ("words", pa.list_(pa.string())), ("offset", pa.int32())])
)


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes.view(np.uint64).copy()) >> np.uint64(64 - bits)).astype(np.int64)


def _passes(table: np.ndarray | None, bits: int, hashes: np.ndarray) -> np.ndarray:
    return np.ones(len(hashes), bool) if table is None else bitfilter.contains(table, bit_places(hashes, bits))


def _fingerprints(span: int, gram: int, lengths: list[int] | None, shared, bits: int):
    """Word counts and fingerprints of each text.

    ``lengths`` None: the texts are items, and one of fewer words than ``span`` is a single
    gram. Otherwise the texts are documents, and grams of each of ``lengths`` words are looked
    up besides the winnowed ones. ``shared`` is the broadcast bit table.
    """
    window = span - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shared is None else shared.value
        for batch in batches:
            counts, rows = [], []
            for first, end, data, offsets in pieces(batch.column("text")):
                words, start, stop, at = word_hashes(data, offsets, ALNUM)
                counts.append(np.diff(at))
                grams = gram_hashes(words, gram)
                wanted = [(gram, _winnowed(grams, at, gram, window))]
                if lengths is None:
                    short = np.flatnonzero((np.diff(at) < span) & (np.diff(at) > 0))
                    wanted += [(int(at[d + 1] - at[d]), at[d : d + 1]) for d in short]
                else:
                    wanted += [(size, _all_grams(at, size)) for size in lengths]
                found = [[] for _ in range(end - first)]
                for turn, (size, places) in enumerate(wanted):
                    if not len(places):
                        continue
                    # Whole short items have hashes of their own kind.
                    values = grams[places] if turn == 0 else ~gram_hashes(words, size)[places]
                    values = values.view(np.int64)
                    hit = np.flatnonzero(_passes(table, bits, values))
                    owner = np.searchsorted(at, places[hit], "right") - 1
                    for i, d in zip(hit, owner, strict=True):
                        p = int(places[i])
                        low, high = max(int(at[d]), p - span + 1), min(int(at[d + 1]), p + size + span - 1)
                        context = [
                            data[start[j] : stop[j]].tobytes().lower().decode("utf-8", "replace") for j in range(low, high)
                        ]
                        found[d].append(
                            {"hash": int(values[i]), "place": p - int(at[d]), "words": context, "offset": p - low}
                        )
                rows += found
            out = batch.select([c for c in batch.schema.names if c != "text"])
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(total, pa.int64()), pa.array(rows, _PRINT_TYPE)],
                [*out.schema.names, "n_words", "prints"],
            )

    return run


def _winnowed(grams: np.ndarray, at: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places of each window's rightmost smallest gram; windows across two texts are left out."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    span = gram + window - 1
    least, where = grams[:n].copy(), np.arange(n)
    for step in range(1, window):
        later = grams[step : step + n]
        better = later <= least
        np.copyto(least, later, where=better)
        where[better] = np.flatnonzero(better) + step
    inside = np.zeros(n, bool)
    inside[_all_grams(at, span)] = True
    return np.unique(where[inside])


def _all_grams(at: np.ndarray, size: int) -> np.ndarray:
    """Places of all runs of ``size`` words within one text."""
    starts, lengths = at[:-1], np.diff(at) - size + 1
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def _extended(span: int):
    """Runs of equal words around a joined fingerprint, if long enough.

    ``size`` is the least length: ``span``, or all words of a shorter item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, start, stop = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("words", "offset", "item_words", "item_offset", "size", "place")]
            for words, offset, other, shift, size, place in zip(*columns, strict=True):
                low = 0
                while offset - low > 0 and shift - low > 0 and words[offset - low - 1] == other[shift - low - 1]:
                    low += 1
                high = 0
                while offset + high < len(words) and shift + high < len(other) and words[offset + high] == other[shift + high]:
                    high += 1
                keep.append(low + high >= size)
                start.append(place - low)
                stop.append(place + high)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row").filter(kept), batch.column("item").filter(kept),
                    pa.array(start, pa.int32()).filter(kept), pa.array(stop, pa.int32()).filter(kept),
                ],
                ["_row", "item", "start", "stop"],
            )

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", span: int = 10, gram: int = 5, bits: int = 23,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    Words are runs of ASCII letters (lowered), digits and non-ASCII characters. Every run of
    ``span`` words of an item, or a shorter item as a whole, is a window; document words inside
    any occurrence of a window are hit. Null and wordless texts have no words and no hits; items
    without id or words take no part; repeated items count once. Repeated documents and null
    ids keep a row each. Other columns are not read.
    """
    spark = docs.sparkSession
    # Neutral names first, so that clashing columns of the inputs play no part.
    items = benchmark.select(
        F.col(item_column).cast("string").alias("item"), F.col(item_text_column).cast("string").alias("text")
    ).where("item IS NOT NULL")
    prints = cut_lineage(
        items.mapInArrow(_fingerprints(span, gram, None, None, bits), f"item string, n_words long, prints {_PRINTS}")
        .where("n_words > 0").select("item", "n_words", F.explode("prints").alias("p"))
        .select(
            "item", F.least(F.col("n_words"), F.lit(span)).cast("int").alias("size"), "p.hash",
            F.col("p.words").alias("item_words"), F.col("p.offset").alias("item_offset"),
        )
    )
    lengths = sorted(r["size"] for r in prints.where(F.col("size") < span).select("size").distinct().collect())
    table = _bit_table(prints, bits)
    shared = spark.sparkContext.broadcast(table)  # 2^bits bits, whatever the benchmark's size
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scanned = source.mapInArrow(
        _fingerprints(span, gram, lengths, shared, bits), f"doc_id {kind}, n_words long, prints {_PRINTS}"
    )
    scanned = cut_lineage(scanned.withColumn("_row", F.monotonically_increasing_id()))
    hits = scanned.select("_row", F.explode("prints").alias("p")).select("_row", "p.*").join(prints, "hash").select(
        "_row", "place", "words", "offset", "item", "item_words", "item_offset", "size"
    )
    runs = cut_lineage(hits.mapInArrow(_extended(span), "_row long, item string, start int, stop int").distinct())
    # Union of the runs of a document: words up to the farthest end so far are counted already.
    spans = runs.select("_row", "start", "stop").distinct()
    by_start = spans.selectExpr(
        "_row", "start", "stop",
        "max(stop) OVER (PARTITION BY _row ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen",
    )
    hit = by_start.groupBy("_row").agg(
        F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("seen", F.lit(0))))).alias("n_hit")
    )
    found = runs.select("_row", "item").distinct().groupBy("_row").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("items")
    )
    none = F.array().cast("array<string>")
    return scanned.select("_row", "doc_id", "n_words").join(hit.join(found, "_row"), "_row", "left").select(
        "doc_id", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _bit_table(prints: DataFrame, bits: int) -> np.ndarray:
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = bit_places(batch.column("hash").to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])

    return bitfilter.build(prints.select("hash").mapInArrow(places, "place long"), "place", bits)
