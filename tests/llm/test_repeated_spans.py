"""Repeated spans against a plain search, and the order of suffixes against sorted()."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import bitfilter
from quarterdeck.llm import repeated_spans as module
from quarterdeck.llm.deep_shallow import deep_shallow_order
from quarterdeck.llm.repeated_spans import repeat_digests, without_repeats

SHAPE = "doc_id long, text string"


def _text(draw, n, letters="abcdefgh ij日é"):
    return "".join(draw.choice(letters) for _ in range(n))


def _rows():
    draw = random.Random(4)
    passage, boiler = _text(draw, 260), _text(draw, 100, "xyz")
    rows = [(i, _text(draw, draw.randint(0, 400))) for i in range(40)]
    rows += [(i, _text(draw, draw.randint(0, 90)) + passage[draw.randint(0, 60) :] + _text(draw, 50)) for i in range(40, 70)]
    rows += [(i, boiler + _text(draw, 30) + boiler) for i in range(70, 80)]
    rows += [(i, passage) for i in range(80, 90)] + [(90, "q" * 5000), (91, "q" * 250), (92, "pq" * 700)]
    rows += [(93, "日本語" * 60), (94, _text(draw, 99)), (95, None), (96, ""), (97, _text(draw, 60_000) + passage)]
    rows.append((98, rows[-1][1][30_000:]))
    draw.shuffle(rows)
    return rows


def _plain(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            gone[i : i + length] |= s in seen
            seen.add(s)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("held, block, task_regions", [(300_000, 1 << 20, 50_000), (40, 4096, 50_000), (300_000, 1 << 20, 3)])
def test_equals_a_plain_search(spark, monkeypatch, held, block, task_regions):
    monkeypatch.setattr(module, "_HELD_REGIONS", held)
    monkeypatch.setattr(bitfilter, "HELD_KEYS", held)
    monkeypatch.setattr(module, "_BLOCK", block)
    rows = _rows()
    frame = spark.createDataFrame(rows, SHAPE).repartition(4).select("*", *[F.lit(1).alias(c) for c in ("row", "doc", "place", "key", "at", "n")])
    want = _plain(rows)
    got = sorted(tuple(r) for r in repeat_digests(frame, task_regions=task_regions).collect())
    assert got == [w[:5] for w in want]
    if task_regions == 3:
        spans = {r["doc_id"]: r for r in without_repeats(frame, task_regions=task_regions).collect()}
        for doc, n, removed, count, _, kept in want:
            assert bytes(spans[doc]["kept"]) == kept and len(spans[doc]["spans"]) == count
            assert sum(s["stop"] - s["start"] for s in spans[doc]["spans"]) == removed


def test_repeated_and_null_ids(spark):
    text = "".join(map(str, range(200)))
    rows = [(1, text), (1, text), (None, text), (None, text + "end"), (2, "short"), (2, "short"), (None, None)]
    got = repeat_digests(spark.createDataFrame(rows, SHAPE).repartition(2)).collect()
    n = len(text)
    kept = sorted((r["n_bytes"], r["n_removed"]) for r in got)
    # One of the two rows of id 1 stays whole; rows with a null id come after all others.
    assert kept == sorted([(n, 0), (n, n), (n, n), (n + 3, n), (5, 0), (5, 0), (0, 0)])
    assert all(r["n_removed"] > 0 for r in got if r["doc_id"] is None and r["n_bytes"])


def test_empty_table(spark):
    assert repeat_digests(spark.createDataFrame([], SHAPE)).collect() == []


@pytest.mark.parametrize("length, shallow", [(100, 32), (100, 8), (100, 0), (13, 32), (8, 8), (5, 0), (100, 100)])
def test_order_of_suffixes(length, shallow):
    draw = random.Random(length + shallow)
    base = bytes(draw.choice(b"ab") for _ in range(300))
    data = b"".join(
        base[draw.randrange(100) :][: draw.randrange(110, 200)] + bytes([draw.randrange(256)]) * draw.randrange(120) for _ in range(40)
    )
    starts = list(range(len(data) - length + 1))
    draw.shuffle(starts)
    order, same = deep_shallow_order(np.frombuffer(data, np.uint8), np.array(starts), length, shallow)
    strings = [data[starts[i] : starts[i] + length] for i in order.tolist()]
    assert strings == sorted(strings)
    assert same.tolist() == [i > 0 and strings[i] == strings[i - 1] for i in range(len(strings))]
