import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarterdeck.functions import order
from quarterdeck.functions.aggregates import guarded_corr, sample_skewness
from quarterdeck.plans import evaluation as ev


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "hot"], size=600, p=[0.2, 0.1, 0.7]),
            "id": np.arange(600),
            "x": np.round(rng.normal(0, 3, 600), 1),
        }
    )
    frame.loc[frame["id"] % 11 == 0, "x"] = np.nan
    frame.loc[frame["id"] % 4 == 1, "x"] = 0.0
    frame.loc[len(frame)] = ["single", 600, -7.5]
    rows = [(g, int(i), None if np.isnan(x) else float(x)) for g, i, x in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "g string, id long, x double")


def test_percentile_rank_matches_pandas(table):
    frame, data = table
    got = order.with_percentile_rank(data, ["g"], "x", "p", "r").toPandas().sort_values("id")
    ranks = frame.groupby("g")["x"].rank(method="average")
    counts = frame.groupby("g")["x"].transform("count")
    expected = ((ranks - 1) / (counts - 1)).where(counts != 1, 0.5).where(frame["x"].notna())
    np.testing.assert_allclose(got["p"].to_numpy(float), expected.to_numpy(float))
    np.testing.assert_allclose(got["r"].to_numpy(float), ranks.to_numpy(float))


def test_several_columns_are_ranked_together(table):
    frame, data = table
    wide = data.withColumn("y", -F.col("x"))
    got = order.with_percentile_ranks(wide, ["g"], ["g", "id"], ["x", "y"], averages=True).toPandas().sort_values("id")
    ranks = frame.groupby("g")["x"].rank(method="average")
    np.testing.assert_allclose(got["x_rank"].to_numpy(float), ranks.to_numpy(float))
    np.testing.assert_allclose(got["y_rank"].to_numpy(float), (-frame["x"]).groupby(frame["g"]).rank().to_numpy(float))


def test_exact_quantiles_match_pandas(table):
    frame, data = table
    got = order.exact_quantiles(data, ["g"], "x", {"q1": 0.01, "m": 0.5, "q9": 0.9}).toPandas().set_index("g")
    for name, q in (("q1", 0.01), ("m", 0.5), ("q9", 0.9)):
        expected = frame.groupby("g")["x"].quantile(q)
        np.testing.assert_allclose(got[name].sort_index(), expected.sort_index())


def test_first_rank_and_bins(table):
    frame, data = table
    got = order.with_first_rank(data.where("x is not null"), ["g"], "x", "id").toPandas().sort_values("id")
    known = frame.dropna()
    expected = known.sort_values(["x", "id"]).groupby("g").cumcount() + 1
    assert got["first_rank"].tolist() == expected.sort_index().tolist()


def test_single_row_scores_fifty_and_extremes_take_outer_deciles(spark):
    rows = [(1, i, float(i)) for i in range(10)] + [(2, 0, 3.0)]
    data = spark.createDataFrame(rows, "report_period int, permno int, prediction double")
    got = {(r["report_period"], r["permno"]): r for r in ev.with_scores(data).collect()}
    assert got[1, 0]["decile"] == 1 and got[1, 9]["decile"] == 10
    assert got[2, 0]["score"] == 50.0


def test_value_band_keeps_order(spark):
    values = [-1e300, -5.0, -4.99, -1e-300, 0.0, 5e-324, 1e-10, 1.0, 1.0000001, 2.0, 1e18, 1.7e308]
    data = spark.createDataFrame([(v,) for v in values], "v double")
    bands = [r["b"] for r in data.select("v", order.value_band(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bands == sorted(bands)


def test_skewness_and_guarded_correlation(spark):
    data = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (9.0, 5.0), (4.0, 5.0)], "a double, b double")
    row = data.agg(sample_skewness(F.col("a")).alias("s"), guarded_corr(F.col("a"), F.col("b")).alias("c")).first()
    assert row["s"] == pytest.approx(pd.Series([1.0, 2.0, 9.0, 4.0]).skew())
    assert row["c"] is None
