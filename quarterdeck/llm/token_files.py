"""Token-id files with a minimal perfect hash index.

Format of a token file set, a folder that any Spark storage can hold:

* ``payload``: rows (shard, segment, first, ids). ``ids`` are the raw little-endian ids of
  consecutive documents in ascending id order, two bytes each if the vocabulary allows, else
  four; ``first`` is the number of ids of the shard before the segment. A document lies in one
  segment; a segment closes once it holds ``segment_ids`` ids.
* ``entries``: rows (doc_id, shard, segment, offset, n), one per document.
* ``index``: rows (bucket, keys, groups, shifts, slots). A key (document id, occurrence) has two
  64-bit hashes. The first picks the bucket and the group in it; the group's shift sends the
  second hash to the key's slot, different for every key and without gaps (hash and displace).
  A slot holds a 32-bit fingerprint and shard, segment, offset and number of ids: one probe,
  one comparison and one slice give a document's ids, whatever the number of documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarterdeck.llm.textbytes import lookup, mix, pieces, prefix_sums, span_hash, word_spans
from quarterdeck.session import scratch_path

_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("segment", "<u4"), ("offset", "<u8"), ("n", "<u8")])
_SPACE = lookup(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D), fold=False)
_STEP = np.uint64(0x9FB21C651E98DF25)
_CACHED_CHUNKS = 1_000_000
_TRIES = 1 << 16


class ChunkEncoder:
    """Encodes texts chunk by chunk with a cache of chunks already encoded.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    white-space separated chunks in a row; a full stop or comma that ends a chunk after a letter
    is a piece of its own. Each distinct chunk is encoded by the tokenizer once while cached.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        ends = [t for token, t in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.word_end = np.zeros(size, bool)
        self.word_end[ends] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _add(self, hashes: list[int], chunks: list[str]) -> None:
        ids, lengths = self._encoded(chunks)
        count, base = len(self.known), self.used
        while base + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while count + len(chunks) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        self.pool[base : base + len(ids)] = ids
        self.used += len(ids)
        self.start[count : count + len(chunks)] = base + np.cumsum(lengths) - lengths
        self.length[count : count + len(chunks)] = lengths
        self.known.update(zip(hashes, range(count, count + len(chunks)), strict=True))

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and their number per chunk."""
        plain = [c.isalpha() for c in chunks]
        # A chunk of letters is one word, whose last id alone is a word end.
        words = [c for c, p in zip(chunks, plain, strict=True) if p]
        found = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(part):
                found += np.split(ids, ends[:-1])
            else:
                found += self._one_by_one(part)
        others = self._one_by_one([c for c, p in zip(chunks, plain, strict=True) if not p])
        one, two = iter(found), iter(others)
        merged = [next(one) if p else next(two) for p in plain]
        lengths = np.array([len(x) for x in merged], np.int64)
        return (np.concatenate(merged) if merged else np.zeros(0, np.uint32)), lengths

    def _one_by_one(self, chunks: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False) if chunks else []
        return [np.array(e.ids, np.uint32) for e in encoded]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for first, end, data, offsets in pieces(texts):
            start, stop, at = word_spans(data, offsets, _SPACE[0])
            # Split off a last full stop or comma after an ASCII letter.
            last = data[stop - 1] if len(stop) else data[:0]
            before = data[np.maximum(stop - 2, 0)] if len(stop) else data[:0]
            letter = (before | 32) - np.uint8(97) < 26
            split = ((last == 46) | (last == 44)) & (stop - start > 1) & letter
            order = np.arange(len(start)) + np.concatenate(([0], np.cumsum(split)))[:-1] if len(start) else np.zeros(0, np.int64)
            extra = order[split] + 1
            size = len(start) + int(split.sum())
            begin, finish = np.zeros(size, np.int64), np.zeros(size, np.int64)
            begin[order], finish[order] = start, stop - split
            begin[extra], finish[extra] = stop[split] - 1, stop[split]
            at = np.concatenate((order, [size]))[at]
            hashes = span_hash(prefix_sums(data, _SPACE[1]), begin, finish).view(np.int64)
            codes, distinct = pd.factorize(hashes)
            if len(self.known) > _CACHED_CHUNKS:
                self.clear()
            values = distinct.tolist()
            missing = [i for i, h in enumerate(values) if h not in self.known]
            if missing:
                seen = np.zeros(len(values), np.int64)
                seen[codes[::-1]] = np.arange(len(codes))[::-1]
                raw = data.tobytes()
                where = seen[missing]
                chunks = [raw[a:b].decode() for a, b in zip(begin[where].tolist(), finish[where].tolist(), strict=True)]
                self._add([values[i] for i in missing], chunks)
            slot = np.array([self.known[h] for h in values], np.int64)[codes] if values else np.zeros(0, np.int64)
            length = self.length[slot]
            upto = np.concatenate(([0], np.cumsum(length)))
            ids = self.pool[np.arange(upto[-1]) + np.repeat(self.start[slot] - upto[:-1], length)]
            bounds = upto[at]
            for d in range(end - first):
                yield ids[bounds[d] : bounds[d + 1]]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _packed(path: str, end_id: int, width: int, segment_ids: int):
    """Payload rows and entry rows of one partition, whose documents come in ascending order."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        segment, first, parts, held, rows = 0, 0, [], 0, []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts).astype(kind).tobytes()
            columns = [
                pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()),
                pa.array([ids], pa.binary()),
                pa.array([[{"doc_id": d, "offset": o, "n": n} for d, o, n in rows]], _ENTRY_TYPE),
            ]
            return pa.RecordBatch.from_arrays(columns, ["segment", "first", "n", "ids", "entries"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                rows.append((doc, held, len(ids) + 1))
                parts += [ids, np.array([end_id], np.uint32)]
                held += len(ids) + 1
                if held >= segment_ids:
                    yield closed()
                    segment, first, parts, held, rows = segment + 1, first + held, [], 0, []
        if held:
            yield closed()

    return run


_ENTRY_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("n", pa.int64())]))


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    segment_ids: int = 1 << 20, bucket_keys: int = 50_000,
) -> None:
    """Encode all texts and write payload, entries and index below ``path``.

    Null and empty texts hold the end id alone. Null ids come first. Rows that repeat an id are
    separate documents, told apart by their occurrence number. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    ordered = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    ).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_tie"))
    packed = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").select("doc_id", "text").mapInArrow(
        _packed(tokenizer_path, end_id, width, segment_ids),
        "segment int, first long, n long, ids binary, entries array<struct<doc_id: long, offset: long, n: long>>",
    )
    packed.withColumns({"shard": F.spark_partition_id(), "width": F.lit(width)}).write.parquet(f"{path}/payload")
    entries = spark.read.parquet(f"{path}/payload").select("shard", "segment", F.explode("entries").alias("e")).select(
        "e.*", "shard", "segment"
    )
    entries.write.parquet(f"{path}/entries")
    write_index(spark, path, bucket_keys)


def keyed(frame: DataFrame, buckets: int) -> DataFrame:
    """Add the two hashes of a key (doc_id, occurrence) and its bucket."""

    def hashed(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("occurrence").cast("long"))

    return frame.withColumns({"h1": hashed(1), "h2": hashed(2)}).withColumn("bucket", F.pmod("h1", F.lit(buckets)))


def displaced(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shift per group, slot per key) of a minimal perfect hash; all keys must differ.

    Groups are placed from the largest on, each with the first shift that sends its keys to
    free slots. Groups of one key come last and store the free slot itself, as ``-slot - 1``.
    """
    n = len(first)
    groups = max(1, n // 4)
    group = (mix(first.copy()) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    shifts, slots, taken = np.zeros(groups, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    single = []
    for g in np.argsort(-np.diff(bounds), kind="stable"):
        keys = order[bounds[g] : bounds[g + 1]]
        if len(keys) == 0:
            break
        if len(keys) == 1:
            single.append((g, keys[0]))
            continue
        for low in range(0, _TRIES * 64, 64):
            tries = np.arange(low, low + 64, dtype=np.uint64)
            places = (mix(second[keys][None, :] + tries[:, None] * _STEP) % np.uint64(n)).astype(np.int64)
            free = ~taken[places].any(axis=1)
            ranked = np.sort(places, axis=1)
            free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if free.any():
                choice = int(free.argmax())
                shifts[g], slots[keys] = low + choice, places[choice]
                taken[places[choice]] = True
                break
        else:
            raise ValueError("two keys have the same hashes")
    free_slots = np.flatnonzero(~taken)
    for (g, key), slot in zip(single, free_slots, strict=True):
        shifts[g], slots[key] = -slot - 1, slot
    return shifts, slots


def probed(first: np.ndarray, second: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key in an index of ``n`` keys."""
    shift = shifts[(mix(first.copy()) % np.uint64(len(shifts))).astype(np.int64)]
    moved = (mix(second + shift.astype(np.uint64) * _STEP) % np.uint64(n)).astype(np.int64)
    return np.where(shift < 0, -shift - 1, moved)


def _indexed(group: pd.DataFrame) -> pd.DataFrame:
    first, second = group["h1"].to_numpy().view(np.uint64), group["h2"].to_numpy().view(np.uint64)
    shifts, slots = displaced(first, second)
    table = np.zeros(len(group), _SLOT)
    table["print"][slots] = second >> np.uint64(32)
    for name in ("shard", "segment", "offset", "n"):
        table[name][slots] = group[name].to_numpy()
    return pd.DataFrame(
        {"bucket": [int(group["bucket"].iloc[0])], "keys": [len(group)], "shifts": [shifts.tobytes()], "slots": [table.tobytes()]}
    )


def write_index(spark: SparkSession, path: str, bucket_keys: int) -> None:
    entries = spark.read.parquet(f"{path}/entries")
    buckets = max(1, -(-entries.count() // bucket_keys))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("shard", "segment", "offset")) - 1
    keys = keyed(entries.withColumn("occurrence", turn), buckets)
    keys.groupBy("bucket").applyInPandas(_indexed, "bucket long, keys long, shifts binary, slots binary").withColumn(
        "buckets", F.lit(buckets)
    ).write.parquet(f"{path}/index")


def _located(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Location of each key, by one probe; keys the index does not hold are left out."""
    columns = ["doc_id", "occurrence", "shard", "segment", "offset", "n"]
    if not len(index) or not len(keys):
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
    table = np.frombuffer(index["slots"].iloc[0], _SLOT)
    shifts = np.frombuffer(index["shifts"].iloc[0], np.int64)
    first, second = keys["h1"].to_numpy().view(np.uint64), keys["h2"].to_numpy().view(np.uint64)
    found = table[probed(first, second, shifts, len(table))]
    known = found["print"] == (second >> np.uint64(32))
    out = pd.DataFrame({"doc_id": keys["doc_id"], "occurrence": keys["occurrence"]})
    for name in ("shard", "segment", "offset", "n"):
        out[name] = found[name].astype(np.int64)
    return out[known]


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Shard, segment, offset and number of ids of each key (doc_id, occurrence)."""
    index = spark.read.parquet(f"{path}/index")
    head = index.select("buckets").first()
    hashed = keyed(keys, head["buckets"] if head else 1)
    # A bucket holds about ``bucket_keys`` keys, whatever the number of documents.
    return hashed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        _located, "doc_id long, occurrence long, shard long, segment long, offset long, n long"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted documents out of each segment and sum their ids as 32-bit integers."""
    for batch in batches:
        for ids, width, first, wanted in zip(
            batch.column("ids"), batch.column("width").to_pylist(), batch.column("first").to_pylist(),
            batch.column("wanted").to_pylist(), strict=True,
        ):
            payload = np.frombuffer(ids.as_buffer(), np.dtype(f"<u{width}"))
            out = {"doc_id": [], "shard": [], "inside": [], "n_tokens": [], "ids_crc32": []}
            for w in wanted:
                own = payload[w["offset"] : w["offset"] + w["n"]].astype("<u4")
                out["doc_id"].append(w["doc_id"])
                out["shard"].append(w["shard"])
                out["inside"].append(first + w["offset"])
                out["n_tokens"].append(len(own))
                out["ids_crc32"].append(zlib.crc32(own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


def read_checksums(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each key, found by the index and read from the payload.

    ``start`` is the number of ids of all documents before it.
    """
    payload = spark.read.parquet(f"{path}/payload")
    wanted = locate(spark, path, keys).groupBy("shard", "segment").agg(
        F.collect_list(F.struct("doc_id", "shard", "offset", "n")).alias("wanted")  # at most a segment's documents
    )
    read = payload.select("shard", "segment", "first", "width", "ids").join(wanted, ["shard", "segment"]).mapInArrow(
        _checksums, "doc_id long, shard long, inside long, n_tokens long, ids_crc32 long"
    )
    shards = payload.groupBy("shard").agg(F.sum("n").alias("n"))  # one row per shuffle partition
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def document_keys(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One key per row: the id and how many rows with that id come before."""
    counted = docs.select(F.col(id_column).cast("long").alias("doc_id")).groupBy("doc_id").count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("occurrence"))


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` to a fresh shared folder and read every document back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_checksums(spark, path, document_keys(docs))
