"""Phrases of two and three words that occur together more often than their parts suggest.

1. Each task counts the words and pairs of a stretch of texts, sorts them and builds weighted
   acyclic automata of them, one for each prefix range (slices of the first two words' symbols).
2. A range's automata meet in one task, which unions them and sums their counts as they arrive.
3. A second pass does the same for triples. A triple that occurs often has two pairs that do, so
   windows with another pair are left out; a bit table of fixed size says which pairs may.
4. The parts of all candidates are asked for by range, and the questions composed with the
   range's automaton give their counts.

A word's symbol is a 64-bit hash of its lower-cased bytes; among n different words two share one
with probability n^2 / 2^65. A language's most frequent first words are split by the second word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.llm import bitfilter
from quarterdeck.llm.count_automaton import CountAutomaton, empty_table, summed
from quarterdeck.llm.tables import prepare
from quarterdeck.llm.textbytes import lookup, mix, pieces, word_hashes
from quarterdeck.session import cut_lineage, release

_BREAKS = frozenset(b".,;:!?\n\x0b\x0c\r")
_WORD = lookup(lambda b: b not in _BREAKS and b not in (0x20, 0x09))
_IS_BREAK = np.array([b in _BREAKS for b in range(256)])
_SECOND_BITS = 2
_FILTER_BITS = 25
#: Words whose phrases a task sorts together, and arcs that a union gathers before it is built.
STRETCH_WORDS = 3_000_000
_UNION_ARCS = 2_000_000
_PAIR = np.uint64(0x9FB21C651E98DF25)


def _pair_place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(first * _PAIR + second) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _range_of(columns: list[np.ndarray], first_bits: int) -> np.ndarray:
    out = (columns[0] >> np.uint64(64 - first_bits)).astype(np.int64) << _SECOND_BITS
    if len(columns) > 1:
        out |= (columns[1] >> np.uint64(64 - _SECOND_BITS)).astype(np.int64)
    return out


def _range_column(first: Column, second: Column, sized: Column, first_bits: int) -> Column:
    """``_range_of`` as a column expression."""
    low = F.when(sized > 1, F.shiftrightunsigned(second, 64 - _SECOND_BITS)).otherwise(F.lit(0).cast("long"))
    return F.shiftleft(F.shiftrightunsigned(first, 64 - first_bits), _SECOND_BITS).bitwiseOR(low)


def _stretches(batches: Iterator[pa.RecordBatch], with_words: bool):
    """(lang, symbols, whether a word and the next one are neighbours in a piece, words or None) of bounded stretches."""
    held: dict[str, list] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            yield (
                lang, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [p[2] for p in parts]
            )

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, _, data, offsets in pieces(batch.column("text")):
            symbols, start, end, at = word_hashes(data, offsets, _WORD)
            if not len(symbols):
                continue
            piece = np.cumsum(_IS_BREAK[data], dtype=np.int32)
            near = np.zeros(len(symbols), bool)
            near[:-1] = piece[end[:-1] - 1] == piece[start[1:]]
            cuts = at[1:-1]
            near[cuts[(cuts > 0)] - 1] = False
            raw = (_WORD[1][data].tobytes(), start, end) if with_words else None
            own = langs[first : first + len(offsets) - 1]
            for lang in sorted(set(own)):
                if len(set(own)) == 1:
                    part = (symbols, near, (raw, None))
                else:
                    mine = np.repeat(np.array([x == lang for x in own]), np.diff(at))
                    part = (symbols[mine], near[mine], (raw, np.flatnonzero(mine)))
                held.setdefault(lang, []).append(part)
                size += len(part[0])
            if size >= STRETCH_WORDS:
                yield from out()
                held, size = {}, 0
    yield from out()


def _rows(lang: str, tables: list, first_bits: int, n_words: int) -> pa.RecordBatch:
    """One automaton per prefix range of sorted phrases."""
    split = []
    for columns, counts in tables:
        where = _range_of(columns, first_bits)
        order = np.argsort(where, kind="stable")
        split.append(([c[order] for c in columns], counts[order], where[order]))
    ranges = np.unique(np.concatenate([s[2] for s in split]))
    edges = [(np.searchsorted(w, ranges), np.searchsorted(w, ranges, "right")) for _, _, w in split]
    blobs = []
    for r in range(len(ranges)):
        own = [
            ([c[a[r] : b[r]] for c in columns], counts[a[r] : b[r]])
            for (columns, counts, _), (a, b) in zip(split, edges, strict=True)
        ]
        blobs.append(CountAutomaton.build(own).to_bytes())
    words = np.zeros(len(ranges), np.int64)
    if len(words):
        words[0] = n_words
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(ranges), pa.string()), pa.array(ranges, pa.int64()), pa.array(words), pa.array(blobs, pa.binary())],
        ["lang", "range", "n", "automaton"],
    )


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_inverse=True)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _words_and_pairs(first_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, symbols, near, _ in _stretches(batches, False):
            known, number = _numbered(symbols)
            at = np.flatnonzero(near)
            keys, counts = _counted(number[at] * np.int64(len(known)) + number[at + 1])
            pairs = ([known[keys // len(known)], known[keys % len(known)]], counts)
            words = ([known], np.bincount(number, minlength=len(known)))
            yield _rows(lang, [words, pairs, empty_table(3)], first_bits, len(symbols))

    return run


def _triples(first_bits: int, shared):
    """Automata of triples whose pairs may be frequent, and the texts of the words in such pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: set[int] = set()
        for lang, symbols, near, parts in _stretches(batches, True):
            may = near.copy()
            at = np.flatnonzero(near)
            may[at] = bitfilter.contains(shared.value, _pair_place(symbols[at], symbols[at + 1]))
            used = may.copy()
            used[1:] |= may[:-1]
            yield _named_words(symbols, used, parts, named)
            at = np.flatnonzero(may[:-1] & may[1:])
            if not len(at):
                continue
            known, number = _numbered(np.concatenate([symbols[at + j] for j in range(3)]))
            number, v = number.reshape(3, -1), len(known)
            if v < 1 << 21:
                keys, counts = _counted((number[0] * np.int64(v) + number[1]) * np.int64(v) + number[2])
                columns = [known[keys // (v * v)], known[keys // v % v], known[keys % v]]
            else:
                columns, counts = summed([known[x] for x in number], np.ones(len(at), np.int64))
            yield _rows(lang, [empty_table(1), empty_table(2), (columns, counts)], first_bits, 0)

    return run


def _named_words(symbols: np.ndarray, used: np.ndarray, parts: list, named: set[int]) -> pa.RecordBatch:
    """(range = symbol, automaton = word) of words not yet named by this task."""
    if len(named) > STRETCH_WORDS:
        named.clear()
    at = np.flatnonzero(used)
    distinct, first = np.unique(symbols[at], return_index=True)
    new = [i for i, s in enumerate(distinct.tolist()) if s not in named]
    named.update(distinct[new].tolist())
    starts = np.concatenate(([0], np.cumsum([len(p[0][1]) if p[1] is None else len(p[1]) for p in parts])))
    words = []
    for place in at[first[new]].tolist():
        p = int(np.searchsorted(starts, place, "right")) - 1
        (raw, start, end), mine = parts[p]
        i = place - int(starts[p])
        i = i if mine is None else int(mine[i])
        words.append(raw[start[i] : end[i]])
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(new), pa.string()), pa.array(distinct[new].view(np.int64)), pa.array(np.zeros(len(new), np.int64)),
            pa.array(words, pa.binary()),
        ],
        ["lang", "range", "n", "automaton"],
    )


def _unions(least: int):
    """One automaton per (lang, range) of sorted rows; at most _UNION_ARCS arcs wait to be merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, arcs, n = None, [], 0, 0

        def out():
            whole = CountAutomaton.union(held).pruned(least)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([whole.to_bytes()])],
                ["lang", "range", "n", "automaton"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "range", "n")]
            for lang, range_, words, raw in zip(*columns, batch.column("automaton"), strict=True):
                if key != (lang, range_):
                    if key is not None:
                        yield out()
                    key, held, arcs, n = (lang, range_), [], 0, 0
                held.append(CountAutomaton.from_bytes(raw.as_buffer()))
                arcs += held[-1].arcs()
                n += words
                if arcs > _UNION_ARCS and len(held) > 1:
                    held = [CountAutomaton.union(held)]
                    # A union as large as the bound waits for as much again before the next one.
                    arcs = 0 if held[0].arcs() > _UNION_ARCS // 2 else held[0].arcs()
        if key is not None:
            yield out()

    return run


def _phrases(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("automaton"), strict=True):
                columns, counts = CountAutomaton.from_bytes(raw.as_buffer()).tables()[size - 1]
                columns = columns + [np.zeros(len(counts), np.uint64)] * (3 - size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), *[pa.array(c.view(np.int64)) for c in columns], pa.array(counts)],
                    ["lang", "w1", "w2", "w3", "a"],
                )

    return run


def _pair_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("automaton"):
            columns, _ = CountAutomaton.from_bytes(raw.as_buffer()).tables()[1]
            yield pa.RecordBatch.from_arrays([pa.array(_pair_place(*columns))], ["place"])


def _composed(asked: pd.DataFrame, automata: pd.DataFrame) -> pd.DataFrame:
    words = [asked[c].to_numpy(np.int64).view(np.uint64) for c in ("p1", "p2")]
    found = np.zeros(len(asked), np.int64)
    for raw in automata["automaton"]:
        found += CountAutomaton.from_bytes(raw).compose(words, asked["size"].to_numpy(np.int64))
    return asked[["lang", "p1", "p2", "size"]].assign(f=found)


def _first_bits(docs: DataFrame, ranges: int | None) -> int:
    wanted = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, (wanted - 1).bit_length() - _SECOND_BITS)


_ROW = "lang string, range long, n long, automaton binary"


def collocations(
    docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = 10, limit: int = 2000,
    covered_percent: int = 50, ranges: int | None = None,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 and 3 words.

    Only A-Z are lower-cased. Texts are cut at ``.,;:!?`` and line breaks; words are runs of
    anything but blanks and tabs; phrases do not cross cuts or documents. A phrase needs ``least``
    occurrences and no longer candidate around it with ``covered_percent`` of them. Null languages
    are ``und``; null and empty texts have no words. A text of any length is one run of words.
    ``ranges`` (default: the session's shuffle partitions) is the number of prefix ranges; it
    changes no result. Ties are settled by count, then by the phrase's bytes.
    """
    spark = docs.sparkSession
    prepare(spark)
    first_bits = _first_bits(docs, ranges)
    source = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text")
    )

    def united(rows: DataFrame) -> DataFrame:
        return cut_lineage(
            rows.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(_unions(least), _ROW)
        )

    short = united(source.mapInArrow(_words_and_pairs(first_bits), _ROW))
    table = bitfilter.build(short.mapInArrow(_pair_places, "place long"), "place", _FILTER_BITS)
    shared = spark.sparkContext.broadcast(table)  # 2^25 bits
    shards = cut_lineage(source.mapInArrow(_triples(first_bits, shared), _ROW))
    words = shards.where("lang IS NULL").groupBy(F.col("range").alias("symbol")).agg(
        F.min("automaton").cast("string").alias("word")
    )
    long_ = united(shards.where("lang IS NOT NULL"))
    fields = "lang string, w1 long, w2 long, w3 long, a long"
    pairs, triples = short.mapInArrow(_phrases(2), fields), long_.mapInArrow(_phrases(3), fields)

    inside = triples.select("lang", "w1", "w2", "a").unionByName(
        triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")
    ).groupBy("lang", "w1", "w2").agg(F.max("a").alias("around"))
    pairs = pairs.join(inside, ["lang", "w1", "w2"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < covered_percent * F.col("a"))
    ).drop("around")
    kept = cut_lineage(pairs.withColumn("size", F.lit(2)).unionByName(triples.withColumn("size", F.lit(3))))

    none = F.lit(0).cast("long")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "w1", "w2", "w3", "a", "size", "k",
        F.col("w1").alias("l1"), F.when(F.col("k") == 2, F.col("w2")).otherwise(none).alias("l2"),
        F.when(F.col("k") == 2, F.col("w3")).otherwise(F.col("w2")).alias("r1"),
        F.when((F.col("k") == 1) & (F.col("size") == 3), F.col("w3")).otherwise(none).alias("r2"),
        F.col("k").alias("l_size"), (F.col("size") - F.col("k")).alias("r_size"),
    )
    asked = cuts.select("lang", F.col("l1").alias("p1"), F.col("l2").alias("p2"), F.col("l_size").alias("size")).unionByName(
        cuts.select("lang", F.col("r1").alias("p1"), F.col("r2").alias("p2"), F.col("r_size").alias("size"))
    ).distinct()
    asked = asked.withColumn("range", _range_column(F.col("p1"), F.col("p2"), F.col("size"), first_bits))
    counts = cut_lineage(
        asked.groupBy("lang", "range").cogroup(short.select("lang", "range", "automaton").groupBy("lang", "range")).applyInPandas(
            _composed, "lang string, p1 long, p2 long, size int, f long"
        )
    )

    def part(side: str, out: str) -> DataFrame:
        return counts.select(
            "lang", F.col("p1").alias(f"{side}1"), F.col("p2").alias(f"{side}2"), F.col("size").alias(f"{side}_size"),
            F.col("f").alias(out),
        )

    scored = cuts.join(part("l", "l"), ["lang", "l1", "l2", "l_size"]).join(part("r", "r"), ["lang", "r1", "r2", "r_size"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    scored = scored.withColumn("top", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"))
    scored = scored.withColumn("bottom", wide["l"] * wide["r"]).withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "w1", "w2", "w3", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    totals = short.groupBy("lang").agg(F.sum("n").alias("n"))
    for c in ("w1", "w2", "w3"):
        best = best.join(words.select(F.col("symbol").alias(c), F.col("word").alias(f"t{c}")), c, "left")
    phrase = F.when(F.col("size") == 2, F.concat_ws(" ", "tw1", "tw2")).otherwise(F.concat_ws(" ", "tw1", "tw2", "tw3"))
    listed = best.select("lang", phrase.alias("phrase"), "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = listed.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    out = cut_lineage(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for stage in (short, shards, long_, kept, counts):
        release(stage)
    return out

