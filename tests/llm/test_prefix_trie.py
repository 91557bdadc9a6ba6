"""Prefix trie: rebuilt conversations, nodes and subtree totals against a plain trie."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarterdeck.llm.prefix_trie import centroid_rollup, ordered_turns, prefix_trie, share_openings, with_length
from quarterdeck.session import cut_lineage

SHAPE = "conv_id long, turn long, role string, text string"


def _rows():
    draw = random.Random(5)
    rows = []
    for c in [*range(60), 100, 101, 350, 351, 399]:
        rows += [(c, t, ("user", "assistant")[t % 2], f"t{draw.randrange(2)}") for t in range(draw.randint(1, 7))]
    rows += [(200, t, "user", "same") for t in range(150)] + [(201, t, "user", "same") for t in range(150)]  # long, alike
    rows += [(7, None, "user", None), (8, None, None, ""), (9, 1, "user", "tie"), (9, 1, "user", "tie"), (9, 1, "a", "tie")]
    rows += [(None, 1, "user", "nobody"), (500, 0, "user", "é日本 " * 20_000)]
    draw.shuffle(rows)
    return rows


def _plain(rows, rebuild=True):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = own
    if rebuild:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ends, out = {}, {}, []
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    saved = {n: (len(m) - 1) * len(n[-1][1]) if n else 0 for n, m in members.items()}
    leaves = {n: int(n not in kids) for n in members}
    for node in sorted(members, key=len, reverse=True):
        if node:
            saved[node[:-1]] += saved[node]
            leaves[node[:-1]] += leaves[node]
    for node, m in members.items():
        listed = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node],
            saved[node], hashlib.sha256(listed.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def _got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("task_nodes", [120, 4096])
def test_rebuilt_conversations_equal_a_plain_trie(spark, task_nodes):
    rows = _rows()
    frame = spark.createDataFrame(rows, SHAPE).repartition(5)
    frame = frame.select("*", *[F.lit(1).alias(c) for c in ("place", "digest", "node", "part", "line", "top", "length")])
    assert _got(prefix_trie(share_openings(ordered_turns(frame)), task_nodes)) == _plain(rows)


def test_conversations_as_they_are(spark):
    rows = [r for r in _rows() if r[0] is None or r[0] < 60]
    got = prefix_trie(with_length(ordered_turns(spark.createDataFrame(rows, SHAPE))))
    assert _got(got) == _plain(rows, rebuild=False)


def test_empty_table(spark):
    got = prefix_trie(share_openings(ordered_turns(spark.createDataFrame([], SHAPE))))
    assert got.count() == 0 and got.columns[0] == "conv_id"


def test_rollup_of_random_forests_and_long_chains(spark):
    draw, nodes, parent = random.Random(3), [], {}
    for v in range(400):
        parent[v] = None if v in (0, 200) else (v - 1 if 200 < v < 330 else draw.randrange(200 * (v >= 200), v))
    depth, size, total, values = {}, dict.fromkeys(parent, 1), {}, {v: draw.randrange(10) for v in parent}
    for v, p in parent.items():
        depth[v] = 0 if p is None else depth[p] + 1
    total = dict(values)
    for v in sorted(parent, reverse=True):
        if parent[v] is not None:
            size[parent[v]] += size[v]
            total[parent[v]] += total[v]
    paths = []
    for v in parent:  # each node stands for itself: its own way from the root
        u = v
        while u is not None:
            paths.append((v, depth[u], u, parent[u]))
            u = parent[u]
    nodes = [(v, parent[v], depth[v], v, size[v], values[v]) for v in parent]
    got = centroid_rollup(
        cut_lineage(spark.createDataFrame(nodes, "node long, parent long, depth long, rep long, mass long, x long")),
        cut_lineage(spark.createDataFrame(paths, "conv_id long, place long, node long, parent long")), ["x"], task_nodes=50,
    )
    assert {r["node"]: r["x"] for r in got.collect()} == total
