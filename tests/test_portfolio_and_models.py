from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators.regression import hac_regression
from quarterdeck.plans import evaluation as ev
from quarterdeck.plans.audits import edge_invariants, weight_profile
from quarterdeck.plans import boosting
from quarterdeck.plans import models as md
from quarterdeck.plans import panel as pn
from quarterdeck.plans import portfolio as pf

Q = date(2024, 3, 31)
DAYS = [date(2024, 5, 20) + timedelta(days=i) for i in range(5)]


def setup(spark, returns):
    members = spark.createDataFrame([(Q, p, p, 1.0) for p in range(1, 11)], "report_period date, permno int, decile int, market_cap double")
    calendar = spark.createDataFrame([(Q, d) for d in DAYS], "report_period date, day date")
    rows = [(p, d, returns(p, i)) for p in range(1, 11) for i, d in enumerate(DAYS) if returns(p, i) is not None]
    daily = spark.createDataFrame(rows, "permno int, day date, ret double")
    return members, pf.security_paths(pf.dense_returns(members, calendar, daily))


def test_missing_tail_stays_in_cash(spark):
    members, grown = setup(spark, lambda p, i: 0.05 if i == 0 else None)
    weights = pf.formation_weights(pf.portfolio_members(members, [("all", 1, 10)]))
    row = pf.event_metrics(pf.portfolio_paths(weights, grown)).first()
    assert row["cumulative_return"] == pytest.approx(0.05) and row["maximum_drawdown"] == pytest.approx(0.0)
    assert row["days"] == 5


def test_long_short_direction(spark):
    members, grown = setup(spark, lambda p, i: 0.02 if p == 1 else 0.0)
    legs = pf.portfolio_members(members, [("low", 1, 1), ("high", 10, 10)])
    path = pf.portfolio_paths(pf.formation_weights(legs), grown)
    got = [r["factor_return"] for r in pf.long_short(path, [("f", "low", "high")]).collect()]
    assert got == pytest.approx([0.02] * 5)


def test_first_formation_turns_over_once(spark):
    members, grown = setup(spark, lambda p, i: 0.0)
    weights = pf.formation_weights(pf.portfolio_members(members, [("all", 1, 10)]))
    row = pf.one_way_turnover(weights, pf.ending_weights(weights, grown), members).first()
    assert row["one_way_turnover"] == 1.0 and row["stocks"] == 10


def test_hac_matches_direct_computation(spark):
    rng = np.random.default_rng(11)
    n, lag = 60, 4
    x = rng.normal(size=(n, 2))
    y = 0.3 + x @ [1.0, -0.5] + np.convolve(rng.normal(size=n + 2), [1, 0.6, 0.3], "valid")
    rows = [(date(2024, 1, 1) + timedelta(days=i), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    frame = spark.createDataFrame(rows, "day date, y double, a double, b double")
    got = hac_regression(frame, "y", ["a", "b"], [0, lag], "day")[1]
    design = np.column_stack([np.ones(n), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    scores = design * (y - design @ beta)[:, None]
    middle = scores.T @ scores
    for step in range(1, lag + 1):
        gamma = scores[step:].T @ scores[:-step]
        middle += (1 - step / (lag + 1)) * (gamma + gamma.T)
    inverse = np.linalg.inv(design.T @ design)
    error = np.sqrt((inverse @ middle @ inverse)[0, 0])
    assert got["daily_alpha"] == pytest.approx(beta[0])
    assert got["alpha_standard_error"] == pytest.approx(error)
    assert got["market_beta"] == pytest.approx(beta[1])


def test_ridge_and_complexity_match_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = 0.5 + x @ [0.05, -0.02, 0.0] + rng.normal(0, 0.02, 80)
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, t double")
    alpha = 10.0
    beta = md.fit_ridge(frame, ["a", "b", "c"], "t", alpha)
    centred, mean = x - x.mean(0), y.mean()
    expected = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - mean))
    np.testing.assert_allclose(beta[1:], expected)
    row = md.ridge_complexity(frame, ["a", "b", "c"], "t", [alpha]).first()
    values = np.linalg.eigvalsh(centred.T @ centred)
    assert row["effective_degrees"] == pytest.approx(np.sum(values / (values + alpha)))
    table = md.tune_ridge(frame, frame, ["a", "b", "c"], "t")
    assert table.where("selected").count() == 1


def _curved(spark, n=400):
    rng = np.random.default_rng(4)
    rows = []
    for i, (v, w) in enumerate(rng.random((n, 2))):
        t = 0.3 + 0.25 * (v > 0.5) + 0.2 * (w > 0.3) + 0.03 * rng.standard_normal()
        split = ("train", "train", "validation", "test")[i % 4]
        rows.append((date(2020, 3 * (1 + i % 4), 28), date(2021, 1, 1), i, float(v), float(w), float(t), split))
    return spark.createDataFrame(
        rows, "report_period date, information_date date, permno int, a double, b double, t double, sample_split string"
    )


def test_boosted_trees_follow_their_history(spark):
    frame = _curved(spark)
    table, history, fits = md.tune_boosted_trees(frame, ["a", "b"], "t")
    rows = {r["candidate"]: r for r in table.collect()}
    assert len(rows) == 12 and sum(r["selected"] for r in rows.values()) == 1
    history.createOrReplaceTempView("rounds")
    # The chosen round follows from the history alone: the first of the smallest errors, 30 rounds from the end or at it.
    chosen = spark.sql(
        "SELECT candidate, min_by(boosting_round, struct(validation_mae, boosting_round)) AS best, max(boosting_round) AS last "
        "FROM rounds GROUP BY candidate"
    ).collect()
    for r in chosen:
        assert rows[r["candidate"]]["rounds"] == r["best"] and r["last"] == min(r["best"] + 30, 1000)
    best = next(r for r in rows.values() if r["selected"])
    assert best["mae"] == min(r["mae"] for r in rows.values()) < 0.06
    at_best = {(r["candidate"], r["boosting_round"]): r["validation_mae"] for r in history.collect()}
    for name, r in rows.items():  # targets lie in 0..1, so bounding predictions changes little
        assert r["mae"] == pytest.approx(at_best[name, r["rounds"]], abs=2e-3)
    again = md.tune_boosted_trees(frame.repartition(7), ["a", "b"], "t", grid=[(2, 1, 0.8)])[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, history.where("candidate = 'trees_01'").collect()))


def test_one_tree_splits_like_a_search_over_all_bounds():
    rng = np.random.default_rng(9)
    x, y = rng.random((60, 2)).round(2), rng.random(60)
    spec = boosting.Specification("one", ("a", "b"), depth=1, child=5, subsample=1.0, rounds=1, patience=None)
    trees, rounds, history = boosting._boost(spec, x, y, x[:0], y[:0], 1)
    slope = y.mean() - y
    used = trees.column[0, 0]
    gains = []
    for bound in np.unique(x[:, used]):
        left = x[:, used] <= bound
        if min(left.sum(), (~left).sum()) >= 5:
            gains.append((sum(slope[s].sum() ** 2 / (s.sum() + 1) for s in (left, ~left)), bound))
    left = x[:, used] <= max(gains)[1]
    want = np.where(left, -0.05 * slope[left].sum() / (left.sum() + 1), -0.05 * slope[~left].sum() / ((~left).sum() + 1))
    assert rounds == 1 and len(history) == 1
    assert trees.predict(x) == pytest.approx(y.mean() + want)


def test_refits_and_stages(spark):
    frame = _curved(spark).withColumn("prediction", F.lit(0.5))
    groups = {"one": ["a"], "two": ["a", "b"]}
    for model in ("ridge", "trees"):
        out = md.refit_feature_groups(frame, groups, "t", model_class=model, trees={"depth": 3, "rounds": 60})
        assert out.count() == 2 * frame.where("sample_split = 'test'").count()
        error = {r["feature_group"]: r["e"] for r in out.groupBy("feature_group").agg(F.avg(F.abs(F.col("t") - F.col("prediction"))).alias("e")).collect()}
        assert error["two"] < error["one"]
    stages = md.staged_selection(frame, groups, "t", rival=("constant", "prediction"), grid=[(3, 1, 0.8), (2, 1, 1.0)]).collect()
    chosen = {r["stage"]: r for r in stages if r["selected"]}
    assert set(chosen) == {"model_class", "feature_set", "tuning", "overall"} and chosen["feature_set"]["feature_group"] == "two"
    assert chosen["overall"]["mae"] == chosen["tuning"]["mae"] <= min(r["mae"] for r in stages if r["stage"] == "overall")
    assert sum(r["stage"] == "tuning" for r in stages) == (2 if chosen["model_class"]["model_class"] == "trees" else 5)


def test_fits_read_at_most_the_stated_sample(spark):
    frame = _curved(spark)
    assert boosting.bounded_sample(frame, ["permno"], 400) is frame
    assert 50 < boosting.bounded_sample(frame, ["permno"], 100).count() < 160


def test_fits_over_blocks_read_all_rows_and_equal_fits_in_one_task(spark, monkeypatch):
    """Above ``max_rows`` no row is left out: trees, rounds and errors are those of one task that holds all rows."""
    monkeypatch.setattr(boosting, "_BLOCK_ROWS", 40)
    monkeypatch.setattr(boosting, "_BLOCKS_PER_PART", 2)
    monkeypatch.setattr(boosting, "_ROUNDS_PER_CHECKPOINT", 3)
    frame = _curved(spark).repartition(3).cache()
    train, validation = (frame.where(F.col("sample_split") == s) for s in ("train", "validation"))
    specs = [
        boosting.Specification(f"{depth}-{child}", features, depth, child, 1.0, 9, patience)
        for depth, child, features, patience in ((2, 1, ("a", "b"), 2), (2, 5, ("a", "b"), 30), (3, 1, ("b",), None))
    ]
    for gathered in (16, 1):  # sums by the driver, and by tasks
        monkeypatch.setattr(boosting, "_GATHERED_PARTS", gathered)
        whole, dealt = (
            {r["candidate"]: r for r in boosting.fit_boosted(train, validation, "t", specs, max_rows=n).collect()} for n in (1000, 10)
        )
        for name, r in whole.items():
            assert dealt[name]["best_round"] == r["best_round"] and len(dealt[name]["history"]) == len(r["history"])
            assert [x for h in dealt[name]["history"] for x in h] == pytest.approx([x for h in r["history"] for x in h])
            mine, theirs = (boosting.pickle.loads(x["model"]) for x in (dealt[name], r))
            assert (mine.column == theirs.column).all() and (mine.bound == theirs.bound).all()
            assert mine.leaf == pytest.approx(theirs.leaf) and mine.base == pytest.approx(theirs.base)
    drawn = [boosting.Specification("half", ("a", "b"), 2, 1, 0.5, 4, None)]
    again = [boosting.fit_boosted(f, None, "t", drawn, max_rows=10).first() for f in (train, train.repartition(5))]
    assert again[0] == again[1] and all(h["validation_mae"] is None for h in again[0]["history"])


def test_refits_of_more_rows_than_a_task_holds_use_all_of_them(spark, monkeypatch):
    frame, found = _curved(spark), []
    for rows in (200_000, 10):
        monkeypatch.setattr(boosting.fit_boosted, "__defaults__", (("report_period", "permno"), rows, 13))
        out = md.refit_feature_groups(frame, {"one": ["a"]}, "t", model_class="trees", trees={"depth": 2, "rounds": 4, "subsample": 1.0})
        found.append({r["permno"]: r["prediction"] for r in out.collect()})
    assert len(set(found[0].values())) > 2 and found[1] == pytest.approx(found[0])


def test_split_ranges_and_chronology(spark):
    ranges = {"train": ("2020-03-31", "2020-06-30"), "validation": ("2020-12-31", "2020-12-31"), "test": ("2021-06-30", "2021-06-30")}
    periods = ["2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31", "2021-03-31", "2021-06-30"]
    rows = [(date.fromisoformat(p), date.fromisoformat(p) + timedelta(45), date.fromisoformat(p) + timedelta(130), 1, True) for p in periods]
    panel = spark.createDataFrame(rows, "report_period date, information_date date, target_window_end date, permno int, model_eligible boolean")
    sample = pn.assign_splits(panel, ranges)
    assert sample.count() == 4 and pn.purged_periods(panel, ranges).count() == 2
    pn.check_split_chronology(pn.split_audit(sample))
    tight = {**ranges, "validation": ("2020-09-30", "2020-12-31")}
    with pytest.raises(ValueError):
        pn.check_split_chronology(pn.split_audit(pn.assign_splits(panel.withColumn("target_window_end", F.date_add("target_window_end", 60)), tight)))
    with pytest.raises(ValueError):
        pn.assign_splits(panel, {"train": ("2020-03-30", "2020-06-30")})


def test_rows_crossing_the_next_split_are_dropped(spark):
    d = date.fromisoformat
    rows = [
        (d("2020-03-31"), d("2020-05-15"), 1, "train", d("2020-08-14"), 0.1, -0.2),
        (d("2020-06-30"), d("2020-08-14"), 1, "train", d("2021-02-20"), 0.1, -0.2),
        (d("2020-12-31"), d("2021-02-16"), 1, "validation", d("2021-05-17"), 0.1, 0.3),
        (d("2021-06-30"), d("2021-08-16"), 1, "test", d("2021-11-15"), None, -0.1),
    ]
    sample = spark.createDataFrame(
        rows, "report_period date, information_date date, permno int, sample_split string, target_window_end date, "
        "future_downside_volatility double, future_worst_rolling_return double",
    )
    other = spark.createDataFrame([], "report_period date, information_date date, permno int, horizon_market_days int, target_usable boolean, future_max_drawdown double, target_window_end date")
    got = ev.alternative_samples(sample, other).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in got} == {"future_downside_volatility": 2, "future_worst_five_day_loss": 3}


def test_rows_with_a_null_feature_take_no_part_in_fits(spark):
    rows = [(float(i), 1.0 + 2.0 * i) for i in range(10)] + [(None, 50.0), (3.0, None)]
    gram, cross, _, n = md.gram_sums(spark.createDataFrame(rows, "x double, y double"), ["x"], "y")
    fit = md.solve_ridge(gram, cross, 0.0)
    assert n == 10 and abs(fit[0] - 1.0) < 1e-9 and abs(fit[1] - 2.0) < 1e-9


def test_long_whole_numbers_keep_all_digits(spark):
    from quarterdeck.functions.scalars import lenient_long

    rows = [("9007199254740993",), ("12.6",), ("x",), (None,)]
    found = spark.createDataFrame(rows, "t string").select(lenient_long(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in found] == [9007199254740993, 13, None, None]


def test_stored_frames_are_computed_once(spark):
    from quarterdeck.functions.order import with_percentile_rank
    from quarterdeck.session import stored

    frame = stored(spark.range(100).selectExpr("id % 7 AS g", "CAST(id AS DOUBLE) AS v"))
    assert stored(frame) is frame
    ranked = with_percentile_rank(frame, ["g"], "v")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3 and "Range (" not in plan


def test_profiles_and_alternative_targets_compute_their_input_once(spark):
    def counted(columns):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return columns.mapInPandas(count, columns.schema), seen

    edges, seen = counted(spark.range(20).selectExpr("id % 4 AS node", "CAST(id AS DOUBLE) AS w"))
    weight_profile(edges, ["node"], "w").collect()
    assert seen.value == 20
    links, seen = counted(spark.range(5).selectExpr(
        "1 AS report_period", "id AS manager_a", "id + 1 AS manager_b", "0.5D AS cosine_similarity", "1L AS directional_links"
    ))
    nodes = spark.range(5).selectExpr("1 AS report_period", "id AS manager")
    assert edge_invariants(links, nodes).first()["unknown_endpoints"] == 1
    assert seen.value == 5
    day = date(2020, 3, 31)
    columns = "report_period date, information_date date, permno int, sample_split string, target_window_end date, " \
        "future_downside_volatility double, future_worst_rolling_return double"
    sample, seen = counted(spark.createDataFrame([(day, day, 1, "train", day, 0.1, 0.1), (day, day, 2, "test", day, 0.1, 0.1)], columns))
    other = spark.createDataFrame([(day, day, 1, 21, True, 0.2, day)], "report_period date, information_date date, permno int, "
                                  "horizon_market_days int, target_usable boolean, future_max_drawdown double, target_window_end date")
    assert ev.alternative_samples(sample, other).count() == 5
    assert seen.value == 2


def test_candidates_are_measured_as_one_by_one(spark):
    """Ties, a constant candidate and a quarter of one row; ranks by prediction give the same correlation."""
    import random

    from quarterdeck.functions import order
    from quarterdeck.plans.evaluation import candidate_performance, performance

    rng = random.Random(3)
    rows = [(q, round(rng.random(), 1)) for q in (1, 2) for _ in range(40)] + [(3, 0.5)]
    base = spark.createDataFrame([(i, q, y) for i, (q, y) in enumerate(rows)], "id int, report_period int, y double")
    ranked = order.with_percentile_rank(base, ["report_period"], "y", "r")
    scored = ranked.selectExpr(
        "*", "inline(array(struct('a' AS candidate, round(y * 0.3 + (id % 7) / 9, 2) AS p), struct('b' AS candidate, 0.25D AS p), struct('c' AS candidate, (id % 3) / 4.0D AS p)))"
    )
    got = {r["candidate"]: r.asDict() for r in candidate_performance(scored, "y", "p", "r").collect()}
    want = {r["candidate"]: r.asDict() for r in performance(scored, "y", "p", by=["candidate"]).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["mean_quarterly_spearman"] is None
    for name, row in want.items():
        assert set(row) == set(got[name])
        assert all(row[k] == got[name][k] or abs(row[k] - got[name][k]) < 1e-12 for k in row if k != "candidate")


def test_ranks_of_several_columns_are_not_combined_before_they_are_dealt(spark):
    from quarterdeck.functions import order

    frame = spark.createDataFrame([(i, i % 3, float(i)) for i in range(9)], "id int, a int, b double")
    plan = order.with_percentile_ranks(frame, [], ["id"], ["a", "b"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text
    assert {r["id"]: r["b_rank"] for r in plan.collect()} == {i: i / 8 for i in range(9)}
