"""Collocations against a plain count, and the count automata against counters."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import collocations as module
from quarterdeck.llm.collocations import collocations
from quarterdeck.llm.count_automaton import CountAutomaton, summed
from tests.llm.helpers import lowered

SHAPE = "doc_id long, text string, lang string"


def _rows():
    draw = random.Random(11)
    vocabulary = ["alpha", "Beta", "of", "the", "é", "日本", "x\x00y", "no break", "-", "end"]
    rows = [
        (i, "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(draw.randint(0, 60))),
         draw.choice(["en", "en", "en", "fr", None, ""]))
        for i in range(150)
    ]
    rows += [(i, "new york city is the New York City.\nhot dog, hot dog stand", "en") for i in range(12)]
    rows += [(1, None, "en"), (2, "", None), (2, " \t\n", "de"), (None, "of the of the " * 4000, "fr"), (None, None, None)]
    draw.shuffle(rows)
    return rows


def _plain(rows, least=10, limit=2000, covered=50):
    counts = {}
    for _, text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            around = [c for h, c in f.items() if len(h) == 3 and c >= least and len(g) == 2 and g in (h[:2], h[1:])]
            if any(100 * c >= covered * a for c in around):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("ranges, stretch, limit", [(4, 3_000_000, 2000), (64, 500, 2000), (None, 3_000_000, 7)])
def test_equals_a_plain_count(spark, monkeypatch, ranges, stretch, limit):
    monkeypatch.setattr(module, "STRETCH_WORDS", stretch)
    rows = _rows()
    frame = spark.createDataFrame(rows, SHAPE).repartition(3).select("*", *[F.lit(1).alias(c) for c in ("range", "n", "w1", "a", "automaton")])
    assert sorted(tuple(r) for r in collocations(frame, limit=limit, ranges=ranges).collect()) == _plain(rows, limit=limit)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SHAPE)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 20, 400])
def test_automata(n):
    draw = random.Random(n)

    def drawn():
        return Counter({tuple(draw.randrange(8) * 2**61 for _ in range(draw.choice([1, 2, 3, 3]))): draw.randrange(1, 300) for _ in range(n)})

    def build(counter):
        tables = []
        for size in (1, 2, 3):
            keys = [k for k in counter if len(k) == size]
            columns = [np.array([k[i] for k in keys], np.uint64) for i in range(size)]
            tables.append(summed(columns, np.array([counter[k] for k in keys], np.int64)))
        return CountAutomaton.build(tables)

    def content(automaton):
        return {tuple(int(c[i]) for c in cols): int(m[i]) for cols, m in automaton.tables() for i in range(len(m))}

    one, two = drawn(), drawn()
    union = CountAutomaton.union([CountAutomaton.from_bytes(build(one).to_bytes()), build(two)])
    both = one + two
    assert content(union) == dict(both)
    assert content(union.pruned(100)) == {k: c for k, c in both.items() if c >= 100}
    asked = [*both, (7 * 2**61,), (1, 2), (3, 4, 5)]
    columns = [np.array([k[i] if i < len(k) else 0 for k in asked], np.uint64) for i in range(3)]
    assert union.compose(columns, np.array([len(k) for k in asked])).tolist() == [both[k] for k in asked]


def test_states_with_equal_arcs_are_one():
    counter = {(w, 2): 5 for w in range(100)} | {(w, 2, x): 1 for w in range(100) for x in (3, 4)}
    tables = [([np.zeros(0, np.uint64)], np.zeros(0, np.int64))]
    for size in (2, 3):
        keys = sorted(k for k in counter if len(k) == size)
        tables.append(([np.array([k[i] for k in keys], np.uint64) for i in range(size)], np.array([counter[k] for k in keys])))
    assert CountAutomaton.build(tables).arcs() == 100 + 1 + 2
