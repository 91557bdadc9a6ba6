import itertools
import random
import re

import numpy as np
import pyarrow as pa

from quarterdeck.llm.near_dup import near_duplicates, shingle_sets, signature
from quarterdeck.session import cut_lineage
from tests.llm.helpers import SHAPE, awkward_documents, components, documents, lowered, prose


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows, percent):
    sets = {}
    for doc, text, *_ in rows:
        if doc is not None:
            sets.setdefault(doc, []).append(plain_set(text))
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])
    ]
    return components(sets, links)


def check(spark, rows, percent=85):
    found = near_duplicates(documents(spark, rows), percent=percent).collect()
    assert len(found) == len(rows)
    expected = plain(rows, percent)
    for r in found:
        assert r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None)
    sizes = sorted((-1 if d is None else d, len(plain_set(t))) for d, t, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"]) for r in found) == sizes


def test_matches_brute_force_on_awkward_rows(spark):
    check(spark, awkward_documents())


def test_chains_of_near_copies(spark):
    """Each text is a near copy of the next; the ends are not alike, but one component."""
    draw = random.Random(4)
    rows, words = [], prose(draw, 150).split()
    for i in range(60):
        rows.append((i * 7 % 61, " ".join(words), "s"))
        words = list(words)
        words[draw.randrange(150)] = f"y{i}"
        words[draw.randrange(150)] = f"z{i}"
    rows += [(1000 + i, prose(draw, 40), "t") for i in range(40)]
    check(spark, rows, percent=80)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    shared, one, two = (draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (800, 100, 100))
    a, b = signature(np.unique(np.append(shared, one)), 160), signature(np.unique(np.append(shared, two)), 160)
    assert abs((a == b).mean() - 0.8) < 0.12
    small = signature(np.array([5, 2**63 + 9], np.uint64), 160)
    assert set(small.tolist()) == {5, 2**63 + 9}


def test_shingle_sets_have_plain_sizes():
    texts = [t for _, t, _ in awkward_documents()]
    assert [len(s) for s in shingle_sets(pa.array(texts), 5)] == [len(plain_set(t)) for t in texts]


def test_a_hidden_pair_among_mid_similar_documents(spark):
    """The pair shares its buckets with hundreds of documents that are like neither, and has the largest ids."""
    draw = random.Random(8)
    template = [f"t{i}" for i in range(400)]

    def changed(doc, places, length):
        words = list(template)
        for at in places:
            words[at : at + length] = [f"d{doc}x{at + i}" for i in range(length)]
        return doc, " ".join(words), "s"

    rows = [changed(i, draw.sample(range(5, 390, 8), 5), 2) for i in range(500)]
    rows += [changed(900, [100], 6), changed(901, [250], 6)]
    check(spark, rows)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows)).collect()}
    assert found[901] == 900 and sum(i != c for i, c in found.items()) == 1


def test_second_round_follows_where_first_centres_have_no_candidates(spark):
    """The smallest node of a bucket is far too small for the others, which are one pair."""
    from quarterdeck.llm.stars import confirmed_components

    rows = [(1, 0, 3), (1, 5, 100), (1, 6, 100), (1, 7, 100)]
    buckets = cut_lineage(spark.createDataFrame(rows, "key long, node long, n long"))
    labels = confirmed_components(
        buckets, lambda edges: edges.where("a = 5 AND b = 6"), lambda rest: rest.selectExpr("node a", "node b").limit(0), 80, centres=8
    )
    assert {r["node"]: r["component"] for r in labels.collect()} == {5: 5, 6: 5}
