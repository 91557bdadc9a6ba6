import numpy as np
from pyspark.sql import functions as F

from quarterdeck.llm.neighbors import nearest
from tests.llm.helpers import with_clashes


def table(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))


def brute(ids, vectors, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_and_scores_on_vectors_of_many_lengths(spark):
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((30, 24))
    vectors = centres[draw.integers(0, 30, 4000)] + draw.standard_normal((4000, 24)) * 0.7
    vectors *= draw.uniform(0.2, 2.0, (4000, 1))
    ids = draw.permutation(9000)[:4000]
    found = nearest(table(spark, list(zip(ids.tolist(), vectors.tolist()))), F.col("vec_id") % 20 == 0, block_rows=900, query_rows=70).collect()
    expected = brute(ids, vectors, 20)
    got = {}
    at = {int(i): v for i, v in zip(ids, vectors)}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r
        assert abs(r["score"] - float(at[r["query_id"]] @ at[r["vec_id"]])) < 1e-9 and r["vec_id"] != r["query_id"]
    assert set(got) == set(expected)
    for own in got.values():
        assert sorted(own) == list(range(1, 21))
        ranked = [(-own[i]["score"], own[i]["vec_id"]) for i in range(1, 21)]
        assert ranked == sorted(ranked)
    hits = sum(len({r["vec_id"] for r in got[q].values()} & set(expected[q])) for q in expected)
    assert hits >= 0.9 * 20 * len(expected)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i), 2.0]) for i in range(1, 8)] + [(20, [1.0, 1.0, 1.0]), (40, [1.0, 1.0, 1.0]), (41, [1.0, 1.0, 1.0])]
    rows += [(60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [nan, 1.0, 1.0]), (140, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(160, [1.0, 2.0]), (180, []), (20, [1.0, 1.0, 1.0])]
    found = nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    assert {r["query_id"] for r in found} == {20, 40}
    # All other vectors, as there are fewer than k; equal scores go to the smaller id.
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 20] == [7, 6, 5, 4, 3, 2, 1, 40, 41][:0] + sorted(
        [1, 2, 3, 4, 5, 6, 7, 40, 41], key=lambda i: (-(3.0 if i > 7 else 3.0 + i), i)
    )


def test_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.5]) for i in range(400)] + [(1000 + i, [0.1 * i, -0.2]) for i in range(1, 30)]
    found = nearest(table(spark, rows), F.col("vec_id") == 0, k=20).where("vec_id < 1000").collect()
    own = sorted(r["vec_id"] for r in found)
    assert own == list(range(1, 1 + len(own)))


def test_no_rows(spark):
    assert nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(table(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(table(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
