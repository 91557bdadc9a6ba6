import random
import re
import zlib
from collections import defaultdict

from quarterdeck.llm.mixing import mix_to_targets, mixed
from quarterdeck.llm.sharding import byte_shards, measured
from tests.llm.helpers import SHAPE, awkward_documents, documents


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rows = [r for r in awkward_documents() if r[0] != 105] * 4
    found = byte_shards(measured(documents(spark, rows)), 7).collect()
    assert len(found) == len(rows)
    expected = sorted((-1 if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    ordered = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    bytes_of, slots = defaultdict(int), defaultdict(list)
    for r in ordered:
        bytes_of[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(own == list(range(len(own))) for own in slots.values())
    target = sum(bytes_of.values()) / 7
    largest = max(r["size"] for r in found)
    assert set(bytes_of) == set(range(7)) and all(abs(b - target) <= largest for b in bytes_of.values())


def test_sharding_one_huge_row_and_no_row(spark):
    found = byte_shards(measured(documents(spark, awkward_documents())), 5)
    assert found.count() == len(awkward_documents())
    assert byte_shards(measured(spark.createDataFrame([], SHAPE)), 5).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return {**target, **{s: most * sizes[s] for s in capped}}
        capped |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_targets(spark):
    draw = random.Random(2)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "b", "b", "b", "c", "d", "é", None])) for i in range(3000)]
    rows += [(5000 + i, "x y", "tiny") for i in range(3)] + [(6000, "", "empty"), (6001, None, "empty")]
    found = mix_to_targets(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    targets, source = plain_targets(sizes), {d: (t, s) for d, t, s in rows}
    taken = defaultdict(int)
    for r in found:
        text, s = source[r["doc_id"]]
        assert r["size"] == words(text) and r["source_size"] == sizes[s]
        assert abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mix_to_targets(documents(spark, rows)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in found}


def test_mixed_rows_are_those_of_the_plan(spark):
    rows = [r for r in awkward_documents() if r[0] is not None]
    docs = documents(spark, rows)
    copies = {r["doc_id"]: r["count"] for r in mixed(docs).groupBy("doc_id").count().collect()}
    for r in mix_to_targets(docs).where("size > 0 AND doc_id != 106").collect():
        assert copies.get(r["doc_id"], 0) == r["taken"] // r["size"]
    assert mixed(docs).columns == docs.columns


def test_mix_of_awkward_and_empty_tables(spark):
    assert mix_to_targets(documents(spark)).count() == len(awkward_documents())
    assert mix_to_targets(spark.createDataFrame([], SHAPE)).count() == 0
