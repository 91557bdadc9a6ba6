"""Small tables with awkward rows, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

#: Names that operators use inside; inputs may have columns of these names.
CLASHING = (
    "_row _tie _range _place node key n hash place size shard slot item words component kept cut target times class line "
    "bands digest n_words prints start stop entries bucket h1 h2 occurrence vector asked block p_toxic features"
).split()


def with_clashes(frame):
    return frame.select("*", *[F.lit(1).alias(c) for c in CLASHING if c not in frame.columns])


def prose(draw: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


def awkward_documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text, source): nulls, empty, blank and very long texts, ties, repeated rows, copies and near copies."""
    draw = random.Random(seed)
    rows = [(i, prose(draw, draw.randint(1, 80)), f"s{i % 4}") for i in range(60)]
    base = prose(draw, 120)
    changed = base.split()
    for i in range(60, 90):  # near copies of one text
        own = list(changed)
        own[draw.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own), "s0"))
    rows += [(i, base.upper(), "s1") for i in range(90, 100)]
    rows += [(100, None, "s2"), (101, "", None), (102, " \n\t ", "s3"), (103, "one", "s3"), (104, "two words", None)]
    rows += [(105, prose(draw, 30_000), "s2"), (106, "é ñ 日本 語 ß", "s2"), (106, "é ñ 日本 語 ß", "s2"), (107, "a b c d e", "s0")]
    rows += [(108, "a b c d e f", "s0"), (109, "A\nB\nC\nD\nE\n", "s0"), (None, "a b c d e", "s1"), (None, None, None)]
    draw.shuffle(rows)
    return rows


SHAPE = "doc_id long, text string, source string"


def documents(spark, rows=None):
    return with_clashes(spark.createDataFrame(awkward_documents() if rows is None else rows, SHAPE).repartition(3))


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(nodes, links) -> dict:
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
