from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import graph
from quarterdeck.plans import network as nw
from quarterdeck.session import shared_folder

Q = date(2020, 3, 31)


def test_small_network_measures(spark):
    rows = [(Q, date(2020, 5, 15), 1, 10, 60, 0.6), (Q, date(2020, 5, 15), 1, 20, 40, 0.4), (Q, date(2020, 5, 15), 2, 10, 50, 1.0)]
    h = spark.createDataFrame(rows, "report_period date, information_date date, manager long, permno int, position_value long, portfolio_weight double")
    managers = {r["manager"]: r for r in nw.manager_nodes(h).collect()}
    assert managers[1]["portfolio_hhi"] == pytest.approx(0.52) and managers[2]["portfolio_hhi"] == 1.0
    holders = {r["permno"]: r["institutional_holder_count"] for r in nw.security_nodes(h).collect()}
    assert holders == {10: 2, 20: 1}
    row = nw.network_summary(h).first()
    assert row["bipartite_density"] == 0.75 and row["connected_components"] == 1
    assert row["largest_component_share"] == 1.0


def brute_neighbors(matrix, k):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    similar = np.round(unit @ unit.T, 12)
    out = set()
    for i in range(len(matrix)):
        best = sorted((-similar[i, j], j) for j in range(len(matrix)) if j != i and similar[i, j] > 0)[:k]
        out |= {(i, j, rank) for rank, (_, j) in enumerate(best, start=1)}
    return out


@pytest.mark.parametrize(("tile_rows", "blocks"), [(7, 3), (1000, 1)])
def test_tiled_neighbors_equal_brute_force(spark, tile_rows, blocks):
    rng = np.random.default_rng(3)
    matrix = rng.random((40, 25)) * (rng.random((40, 25)) < 0.3)
    matrix[:, 0] = 0.5  # one item held by everybody
    rows = [(1, i, j, float(matrix[i, j])) for i in range(40) for j in range(25) if matrix[i, j]]
    weights = spark.createDataFrame(rows, "g int, s long, i int, w double")
    got = graph.cosine_neighbors(weights, "g", "s", "i", "w", 6, tile_rows=tile_rows, column_blocks=blocks)
    assert {(r["source"], r["target"], r["neighbor_rank"]) for r in got.collect()} == brute_neighbors(matrix, 6)


def test_components_of_a_path_and_a_star(spark):
    edges = [(1, i, i + 1) for i in range(1, 20)] + [(1, 100, 100 + i) for i in range(1, 6)] + [(2, 1, 2)]
    frame = spark.createDataFrame(edges, "g int, a long, b long")
    got = {(r["g"], r["node"]): r["component"] for r in graph.connected_components(frame, "g", "a", "b").collect()}
    assert all(got[1, i] == 1 for i in range(1, 21))
    assert all(got[1, 100 + i] == 100 for i in range(6))
    assert got[2, 2] == 1


def test_two_blocks_become_two_communities(spark):
    edges = [(1, a, b, 1.0) for block in (range(0, 8), range(8, 16)) for a in block for b in block if a < b] + [(1, 0, 8, 0.1)]
    frame = spark.createDataFrame(edges, "g int, a long, b long, w double")
    nodes = spark.createDataFrame([(1, i) for i in range(17)], "g int, n long")  # node 16 is isolated
    labels = graph.modularity_communities(nodes, frame, "g", "n", "a", "b", "w")
    got = {r["node"]: r["community_id"] for r in labels.collect()}
    assert len({got[i] for i in range(8)}) == 1 and len({got[i] for i in range(8, 16)}) == 1
    assert got[0] == 1 and got[8] == 2 and got[16] == 3
    score = graph.modularity(frame, labels.withColumnRenamed("community_id", "community"), "g", "a", "b", "w").first()["modularity"]
    assert score > 0.45


def test_linked_pairs_do_not_depend_on_edge_direction(spark):
    h = spark.createDataFrame([(1, 1, s) for s in range(5)] + [(1, 2, s) for s in range(3, 30)], "p int, m long, s int")
    for a, b in ((1, 2), (2, 1)):
        e = spark.createDataFrame([(1, a, b, 0.5)], "p int, a long, b long, w double")
        from quarterdeck.operators.joins import linked_pairs

        got = {r["s"]: r["linked_weight"] for r in linked_pairs(e, h, "p", "a", "b", "m", "s", "w").collect()}
        assert got == {3: 0.5, 4: 0.5}


def test_state_resets_after_a_gap(spark):
    rows = [("x", 1, 1.0), ("x", 2, 1.0), ("x", 4, 1.0)]
    frame = spark.createDataFrame(rows, "e string, n int, v double")
    got = [r["state"] for r in graph.carried_state(frame, "e", F.col("n"), "v", 0.5).orderBy("n").collect()]
    assert got == [0.5, 0.75, 0.5]


def test_tiles_are_multiplied_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("q", 0, 0, s, i, float(rng.random()), True, True, i % 5) for s in range(12) for i in range(30)]
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["g", "a", "b", "s", "i", "w", "in_a", "in_b", "block"]).sort_values("block")
    whole = pd.concat(graph._TileMultiplier(3, 12)(iter([frame])))
    monkeypatch.setattr(graph, "_ROWS_PER_PRODUCT", 20)
    pieces = [frame.iloc[i : i + 17] for i in range(0, len(frame), 17)]
    split = pd.concat(graph._TileMultiplier(3, 12)(iter(pieces)))
    keys = ["s", "t"]
    pd.testing.assert_frame_equal(
        whole.sort_values(keys).reset_index(drop=True), split.sort_values(keys).reset_index(drop=True)
    )


def test_communities_of_a_period_do_not_depend_on_others(spark):
    import random

    draw = random.Random(5)
    nodes = [(g, i) for g in (1, 2, 3) for i in range(24)]
    edges = []
    for g in (1, 2, 3):
        for a in range(24):
            for b in range(a + 1, 24):
                if draw.random() < (0.6 if a // 8 == b // 8 else 0.05 * g):
                    edges.append((g, a, b, 1.0 + draw.random()))

    def labels(groups):
        found = graph.modularity_communities(
            spark.createDataFrame([n for n in nodes if n[0] in groups], "g int, n long"),
            spark.createDataFrame([e for e in edges if e[0] in groups], "g int, a long, b long, w double"),
            "g", "n", "a", "b", "w",
        )
        return {(r["g"], r["node"]): r["community_id"] for r in found.collect()}

    together = labels({1, 2, 3})
    alone = labels({2})
    assert alone == {k: v for k, v in together.items() if k[0] == 2}
    assert len({v for (g, _), v in together.items() if g == 1}) == 3


def test_carried_state_is_reset_after_a_gap(spark):
    rows = [("a", 1, 2.0), ("a", 2, 4.0), ("a", 5, 8.0), ("b", 3, 1.0)]
    frame = spark.createDataFrame(rows, "entity string, period int, value double")
    found = graph.carried_state(frame, "entity", F.col("period"), "value", 0.5).collect()
    got = {(r["entity"], r["period"]): r["state"] for r in found}
    assert got == {("a", 1): 1.0, ("a", 2): 2.5, ("a", 5): 4.0, ("b", 3): 0.5}


def test_bounds_leave_out_tiles_that_cannot_hold_neighbours(spark):
    """Sectors hardly share items: sources meet few other tiles, and results stay those of a full search."""
    rng = np.random.default_rng(8)
    matrix = np.zeros((160, 60))
    for i in range(160):
        own = i % 4 * 15
        matrix[i, own : own + 15] = rng.random(15) * (rng.random(15) < 0.7)
        matrix[i, (own + 17) % 60] = 0.02
        matrix[i, own] = 1.5 + rng.random()
    rows = [(1, i, f"item {j}", float(matrix[i, j])) for i in range(160) for j in range(60) if matrix[i, j]]
    weights = spark.createDataFrame(rows, "g int, s long, i string, w double")
    got = graph.cosine_neighbors(weights, "g", "s", "i", "w", 5, tile_rows=20)
    assert {(r["source"], r["target"], r["neighbor_rank"]) for r in got.collect()} == brute_neighbors(matrix, 5)
    unit, tiles = graph._tiled_unit_rows(weights, "g", "s", "i", "w", 20, 4)
    own = [F.lit(True).alias("in_a"), F.lit(True).alias("in_b")]
    placed = unit.select("g", "s", "i", "w", F.col("tile").alias("a"), F.col("tile").alias("b"), *own, "block")
    found = placed.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "block").mapInPandas(
        graph._TileMultiplier(5, 12), "g int, s long, t long, similarity double"
    )
    queries, bases = graph._allowed_meetings(unit, found, 5, 12)
    meetings = queries.select("s", "b").distinct().count()
    assert tiles == 8 and 0 < meetings < 160 * (tiles - 1) / 2
    assert bases.select("a", "b").distinct().count() < tiles * (tiles - 1) / 2


def test_neighbours_with_negative_weights_and_many_tiles(spark):
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((70, 6)).round(3)
    rows = [(1, i, j, float(matrix[i, j])) for i in range(70) for j in range(6) if matrix[i, j]]
    weights = spark.createDataFrame(rows, "g int, s long, i int, w double")
    got = graph.cosine_neighbors(weights, "g", "s", "i", "w", 4, tile_rows=9, column_blocks=2)
    assert {(r["source"], r["target"], r["neighbor_rank"]) for r in got.collect()} == brute_neighbors(matrix, 4)
    assert graph.cosine_neighbors(weights.limit(0), "g", "s", "i", "w", 4).collect() == []


def _random_graph(draw, n, groups=(1,)):
    edges = []
    for g in groups:
        for a in range(n):
            for b in range(a + 1, n):
                if draw.random() < (0.5 if a // 10 == b // 10 else 0.04):
                    edges.append((g, a, b, 0.5 + draw.random()))
    return edges


def test_every_round_of_moves_raises_modularity(spark, monkeypatch):
    import random

    frame = spark.createDataFrame(_random_graph(random.Random(2), 40), "g int, u long, v long, w double")
    seen = []
    plain = graph._moves_that_add_up

    def watched(wanting, arcs, group):
        moving = plain(wanting, arcs, group)
        seen.append((wanting.count(), moving.count()))
        return moving

    monkeypatch.setattr(graph, "_moves_that_add_up", watched)
    monkeypatch.setattr(graph, "_MAX_MOVES", 60)
    stored, scores = graph.cut_lineage, []

    def kept(frame_, *args):
        table = stored(frame_, *args)
        if table.columns == ["g", "node", "community"]:
            scores.append(graph.modularity(frame, table, "g", "u", "v", "w").first()["modularity"])
        return table

    monkeypatch.setattr(graph, "cut_lineage", kept)
    graph._local_moving(frame, "g", 1.0, 0)
    assert all(later > before for before, later in zip(scores, scores[1:])) and len(scores) >= 2
    assert all(moved >= 1 for _, moved in seen) and max(moved for _, moved in seen) > 5


def test_communities_are_connected_and_beat_trivial_ones(spark):
    import random

    edges = _random_graph(random.Random(6), 30, (1, 2))
    frame = spark.createDataFrame(edges, "g int, u long, v long, w double")
    nodes = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(30)], "g int, n long")
    labels = graph.modularity_communities(nodes, frame, "g", "n", "u", "v", "w").withColumnRenamed("community_id", "community")
    got = {(r["g"], r["node"]): r["community"] for r in labels.collect()}
    for g in (1, 2):
        for c in {v for (x, _), v in got.items() if x == g}:
            inside = {n for (x, n), v in got.items() if x == g and v == c}
            reached, open_ = set(), [min(inside)]
            while open_:
                n = open_.pop()
                reached.add(n)
                open_ += [m for x, a, b, _ in edges if x == g and n in (a, b) for m in (a, b) if m in inside - reached]
            assert reached == inside
    scores = {r["g"]: r["modularity"] for r in graph.modularity(frame, labels, "g", "u", "v", "w").collect()}
    alone = {r["g"]: r["modularity"] for r in graph.modularity(frame, labels.withColumn("community", F.col("node")), "g", "u", "v", "w").collect()}
    assert all(scores[g] > max(alone[g], 0.3) for g in (1, 2))  # one community has modularity 0


def test_parts_without_a_path_are_split(spark):
    frame = spark.createDataFrame([(1, 1, 2, 1.0), (1, 3, 4, 1.0)], "g int, u long, v long, w double")
    one = spark.createDataFrame([(1, n, 9) for n in (1, 2, 3, 4, 5)], "g int, node long, community long")
    got = {r["node"]: r["community"] for r in graph.connected_parts(one, frame, "g").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


@pytest.mark.parametrize("tile_rows", [4, 1000])
def test_copies_of_a_portfolio_are_compared_once_and_are_all_neighbours(spark, tile_rows):
    """Groups of 1 to 9 copies, more and fewer than the neighbours wanted, with ties between groups."""
    rng = np.random.default_rng(4)
    distinct = (rng.integers(1, 4, (12, 6)) * (rng.random((12, 6)) < 0.6)).astype(float)
    distinct[:, 0] = 1.0
    matrix = rng.permutation(np.concatenate([np.repeat(distinct[i : i + 1], 1 + i % 3 * 4, axis=0) for i in range(12)]))
    rows = [(1, i, j, float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row) if x]
    weights = spark.createDataFrame(rows, "g int, s long, i int, w double")
    got = graph.cosine_neighbors(weights, "g", "s", "i", "w", 5, tile_rows=tile_rows, digits=9, strip_tiles=1)
    assert {(r["source"], r["target"], r["neighbor_rank"]) for r in got.collect()} == brute_neighbors(matrix.round(9), 5)


def test_a_class_is_sent_once_for_each_strip(spark):
    rows = [(g, s, i, 1.0 + (s * i) % 7) for g in (1, 2) for s in range(30 * g) for i in range(s % 5, 9)]
    weights = spark.createDataFrame(rows, "g int, s long, i int, w double")
    classes = graph._portfolios(weights, "g", "s", "i", "w")
    sent = graph._strips(classes, 20).groupBy("g", "strip").agg(F.sum(F.expr("int(distance < 0)")).alias("held"), F.count("s").alias("n"))
    got = {(r["g"], r["strip"]): (r["held"], r["n"] - r["held"]) for r in sent.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)}
    assert all(passing == 30 * g for (g, _), (_, passing) in got.items())
    assert sum(held for (g, _), (held, _) in got.items() if g == 2) == 60


def test_a_group_of_one_strip_is_sent_once_and_meets_itself(spark):
    rng = np.random.default_rng(9)
    matrices = {g: (rng.integers(1, 5, (n, 7)) * (rng.random((n, 7)) < 0.5)).astype(float) for g, n in ((1, 18), (2, 47))}
    rows = [(g, s, i, float(x)) for g, m in matrices.items() for s, row in enumerate(m) for i, x in enumerate(row) if x]
    weights = spark.createDataFrame(rows, "g int, s long, i int, w double")
    classes = graph._portfolios(weights, "g", "s", "i", "w")
    sent = graph._strips(classes, 1000)
    assert sent.count() == classes.count() and sent.where("distance >= 0").isEmpty()
    found = sent.mapInArrow(graph._StripMultiplier(100, 9, 8), "g int, s long, t long, similarity double").collect()
    for g, matrix in matrices.items():
        got = {(r["s"], r["t"]): r["similarity"] for r in found if r["g"] == g}
        norm = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
        unit = matrix / np.where(norm, norm, 1.0)
        want = (unit @ unit.T).round(9)
        assert set(got) == {(a, b) for a, b in zip(*np.nonzero(want)) if a != b}
        assert all(abs(x - want[k]) < 1e-8 for k, x in got.items())


def test_portfolios_are_moved_for_classes_only_if_some_are_alike(spark):
    rows = [(1, s, i, 1.0 + s * i) for s in range(6) for i in (1, 2)]
    portfolios = graph._portfolios(spark.createDataFrame(rows, "g int, s long, i int, w double"), "g", "s", "i", "w")
    classes, copies = graph._classes(portfolios)
    assert not copies and {r["s"] for r in classes.collect()} == set(range(6))
    again = portfolios.unionByName(portfolios.where("s = 2 or s = 5").withColumn("s", F.col("s") + 10))
    classes, copies = graph._classes(again)
    assert copies and {r["s"] for r in classes.collect()} == set(range(6))


def test_shuffle_files_of_a_stored_table_are_deleted(spark):
    from quarterdeck.session import _DROP_SHUFFLES_KEY, cut_lineage

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle")}

    before = shuffles()
    table = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffles() - before
    assert table.count() == 7 and spark.conf.get(_DROP_SHUFFLES_KEY, None) is None


def test_snapshots_compute_holdings_and_security_nodes_once(spark, monkeypatch):
    from pathlib import Path

    from workload import composites

    calls = []
    for module, name in ((composites.R, "holdings"), (composites.nw, "security_nodes")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _real=real, _name=name, **k: (calls.append(_name), _real(*a, **k))[1])
    found = composites.snapshots(spark, str(Path("/root/testdata/sf0.001")))
    assert sorted(calls) == ["holdings", "security_nodes"]
    audited = {tuple(r) for r in found["snapshot_audit"].select("report_period", "graph_split").collect()}
    assert {tuple(r) for r in found["periods"].select("report_period", "graph_split").collect()} == audited


def _stages(spark):
    return {p.name for p in Path(shared_folder(spark)).glob("stage-*")}


@pytest.mark.parametrize("tile_rows", [8, 1000])
def test_neighbours_keep_no_portfolios_on_disk(spark, tile_rows):
    """With copies among the sources and without, only tables of neighbours and members stay stored."""
    rng = np.random.default_rng(12)
    matrix = rng.random((30, 9)).round(2) + 0.01
    for again in (0, 4):
        matrix[30 - again :] = matrix[:again]
        rows = [(1, s, i, float(matrix[s, i])) for s in range(30) for i in range(9)]
        weights = spark.createDataFrame(rows, "g int, s long, i int, w double")
        before = _stages(spark)
        got = graph.cosine_neighbors(weights, "g", "s", "i", "w", 3, tile_rows=tile_rows, digits=9)
        kept = [set(spark.read.parquet(f"{shared_folder(spark)}/{x}").columns) for x in _stages(spark) - before]
        assert kept and not any(c & {"items", "w", "h"} for c in kept)
        assert {(r["source"], r["target"], r["neighbor_rank"]) for r in got.collect()} == brute_neighbors(matrix.round(9), 3)


def test_only_neighbours_of_copies_are_dealt_again(spark):
    found = spark.createDataFrame(
        [(1, 1, 2, 0.9, 1), (1, 2, 1, 0.9, 1), (1, 3, 5, 0.8, 1), (1, 5, 3, 0.8, 1), (1, 3, 1, 0.7, 2)],
        "g int, s long, t long, similarity double, neighbor_rank int",
    )
    members = spark.createDataFrame([(1, 5, 5), (1, 6, 5)], "g int, s long, c long")
    got = {(r["s"], r["neighbor_rank"]): r["t"] for r in graph._dealt_to_members(found, members, 2).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 5, (3, 2): 6, (5, 1): 6, (5, 2): 3, (6, 1): 5, (6, 2): 3}


def test_audit_stores_a_pair_once_for_all_counts(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s in range(20):
        others = rng.permutation([t for t in range(20) if t != s])[:6]
        # The two directions of a pair may differ, as of roundings.
        rows += [(Q, s, int(t), r, float(0.05 + (s * t % 17) / 20 + (s < t) * 1e-9)) for r, t in enumerate(others, start=1)]
    directed = spark.createDataFrame(rows, "report_period date, source long, target long, neighbor_rank int, cosine_similarity double")
    counts, k = (2, 4, 6), ["report_period", "k_neighbors"]
    pairs = graph.neighbor_pairs(directed, "report_period")
    columns = [*k, "cosine_similarity", "is_mutual_neighbor"]
    want = graph.undirected_union(directed, "report_period", counts).select(*columns).collect()
    assert sorted(graph.pairs_by_count(pairs, "report_period", counts).select(*columns).collect()) == sorted(want)
    before = _stages(spark)
    managers = spark.createDataFrame([(Q, s) for s in range(21)], "report_period date, manager long")
    got = {r["k_neighbors"]: r for r in nw.similarity_audit(directed, managers, counts).collect()}
    stored = [spark.read.parquet(f"{shared_folder(spark)}/{x}").count() for x in _stages(spark) - before]
    assert max(stored) == pairs.count() < len(want)
    for n in counts:
        own = [r["cosine_similarity"] for r in want if r["k_neighbors"] == n]
        assert got[n]["undirected_edges"] == len(own) and got[n]["median_similarity"] == pytest.approx(np.median(own), abs=1e-12)
        assert got[n]["connected_managers"] == 20 and got[n]["isolated_managers"] == 1


def test_linked_pairs_move_an_edge_once_whatever_its_portfolios(spark):
    from quarterdeck.operators.joins import linked_pairs

    holdings = spark.createDataFrame([(1, m, s) for m in range(4) for s in range(m, 40 + m)], "p int, m long, s int")
    edges = spark.createDataFrame([(1, 0, 1, 0.5), (1, 2, 1, 0.25), (1, 3, 9, 1.0)], "p int, a long, b long, w double")
    found = linked_pairs(edges, holdings, "p", "a", "b", "m", "s", "w")
    got = {r["s"]: (r["linked_weight"], r["linked_pairs"]) for r in found.collect()}
    assert got == {s: (0.5 * (1 <= s < 40) + 0.25 * (2 <= s < 41), (1 <= s < 40) + (2 <= s < 41)) for s in range(1, 41)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # securities are listed after all joins


def test_arcs_are_moved_twice_a_round(spark, monkeypatch):
    """By their ends for the labels and by node for the choice; only arcs to earlier turns are held against moves."""
    import random

    frame = graph.cut_lineage(spark.createDataFrame(_random_graph(random.Random(3), 30), "g int, u long, v long, w double"))
    plans, sent = [], []
    stored, plain = graph.cut_lineage, graph._moves_that_add_up

    def watched(frame_, *args):
        if "turn" in frame_.columns:
            plans.append(frame_._jdf.queryExecution().executedPlan().toString())
        return stored(frame_, *args)

    def moves(wanting, arcs, group):
        sent.append(arcs.count())
        return plain(wanting, arcs, group)

    monkeypatch.setattr(graph, "cut_lineage", watched)
    monkeypatch.setattr(graph, "_moves_that_add_up", moves)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph._local_moving(frame, "g", 1.0, 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Arcs by their ends, options by node, and the labels for each of the two.
    assert plans and all(p.count("Exchange") <= 5 for p in plans)
    assert sent and set(sent) == {frame.count()}


def test_communities_of_small_groups_are_found_in_tasks_and_are_those_of_rounds(spark, monkeypatch):
    """Groups of more edges than a task takes go round by round; the labels are the same, whatever the way."""
    import random

    edges = _random_graph(random.Random(8), 20) + [(3, 0, 1, 1.0), (3, 1, 2, 1.0), (3, 5, 6, 0.5)]
    frame = spark.createDataFrame(edges, "g int, u int, v int, w double")
    nodes = spark.createDataFrame([(g, i) for g in (1, 3, 4) for i in range(21)], "g int, n int")  # group 4 has no edge
    plain, moved = graph._local_moving, []
    monkeypatch.setattr(graph, "_local_moving", lambda *a: (moved.append(a), plain(*a))[1])
    found = []
    for task_edges in (1000, 10):
        moved.clear()
        labels = graph.modularity_communities(nodes, frame, "g", "n", "u", "v", "w", task_edges=task_edges)
        found.append(sorted(map(tuple, labels.collect())))
        assert bool(moved) == (task_edges < 1000)
    assert found[0] == found[1] and len(found[0]) == 3 * 21
    assert len({c for g, _, c in found[0] if g == 3}) == 21 - 3 and len({c for g, _, c in found[0] if g == 1}) <= 8


def test_turns_are_those_of_the_tables(spark):
    from quarterdeck.operators.communities import turns

    ids = np.array([0, 1, -5, 2**40, 123456789])
    table = spark.createDataFrame([(int(i),) for i in ids], "i long").select(F.xxhash64("i", F.lit(1007)).alias("h"))
    assert [r["h"] for r in table.collect()] == turns(ids, 1007).tolist()


def test_classes_move_digests_and_unique_rows_are_not_summed(spark, monkeypatch):
    """No portfolio is dealt to find its copies, and rows said to be unique go straight into portfolios."""
    rng = np.random.default_rng(4)
    matrix = rng.integers(1, 50, (12, 5)).astype(float)
    matrix[8:] = matrix[:4]
    rows = [(1, s, i, float(matrix[s, i])) for s in range(12) for i in range(5)]
    weights = spark.createDataFrame(rows, "g int, s long, i int, w double")
    stored, seen = graph.cut_lineage, []
    monkeypatch.setattr(graph, "cut_lineage", lambda f, *a: (seen.append(f.columns), stored(f, *a))[1])
    found = [
        sorted(map(tuple, graph.cosine_neighbors(f, "g", "s", "i", "w", 4, digits=9, unique=unique).collect()))
        for f, unique in ((weights, False), (weights, True), (weights.withColumn("w", F.col("w") / 64), True))
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 48
    assert not any({"c", "items"} <= set(columns) for columns in seen)
    plans = [
        graph._portfolios(weights, "g", "s", "i", "w", unique)._jdf.queryExecution().optimizedPlan().toString() for unique in (False, True)
    ]
    assert [p.count("Aggregate") for p in plans] == [2, 1]


def test_securities_are_numbered_before_parts_meet_lines(spark):
    from workload import recipes

    plan = recipes.lines(spark, "/root/testdata/sf0.001").select("permno", "cents")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_position")


def test_holdings_are_computed_once_for_edges_and_what_is_told_of_them(spark, monkeypatch):
    from workload import CASES, recipes

    plain, calls = recipes.lines, []
    monkeypatch.setattr(recipes, "lines", lambda *a: (calls.append(a), plain(*a))[1])
    for name in ("c9_neighbor_count_sensitivity", "c12_community_summary", "q15_edge_invariants", "c20_ranked_network_sample"):
        calls.clear()
        CASES[name].build(spark, "/root/testdata/sf0.001")
        assert len(calls) == 1
