"""Evaluation queries on the scored sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarterdeck.functions import order
from quarterdeck.functions.aggregates import guarded_corr, sample_skewness
from quarterdeck.functions.scalars import loss_magnitude
from quarterdeck.plans import evaluation as ev
from quarterdeck.plans import models as md
from quarterdeck.session import cut_lineage
from workload import recipes as R
from workload.registry import case

KEY = ["report_period", "permno"]


def pct_sql(column: str, keys: str, table: str, extra: str = "") -> str:
    """Average-tie percentile rank, written with plain window functions."""
    return (
        f"CASE WHEN {column} IS NULL THEN NULL WHEN count({column}) OVER (PARTITION BY {keys}) = 1 THEN 0.5 ELSE "
        f"(rank() OVER (PARTITION BY {keys}, {column} IS NULL ORDER BY {column}) + (count(*) OVER (PARTITION BY {keys}, {column}) - 1) / 2.0 - 1) "
        f"/ (count({column}) OVER (PARTITION BY {keys}) - 1) END"
    )


R.cte(
    "scored",
    f"""SELECT *, CAST(greatest(1, least(floor(score / 10.0) + 1, 10)) AS INTEGER) AS decile
    FROM (SELECT *, 100.0 * ({pct_sql('prediction', 'report_period', 'sample')}) AS score FROM sample)""",
    "sample",
)


def scored(spark, sf):
    return ev.with_scores(R.sample(spark, sf))


# ------------------------------------------------------------------ ranks, scores, bins
@case(
    "w10_percentile_rank",
    f"SELECT report_period, permno, {pct_sql('f_sparse', 'report_period', 'sample')} AS f_sparse_rank FROM sample",
    uses="sample", doubles="f_sparse_rank",
)
def _(spark, sf):
    frame = R.sample(spark, sf).select(*KEY, "f_sparse")
    return order.with_percentile_rank(frame, ["report_period"], "f_sparse", "f_sparse_rank").drop("f_sparse")


@case("w11_score", "SELECT report_period, permno, score FROM scored", uses="scored", doubles="score")
def _(spark, sf):
    return scored(spark, sf).select(*KEY, "score")


@case("w12_score_decile", "SELECT report_period, permno, decile FROM scored", uses="scored")
def _(spark, sf):
    return scored(spark, sf).select(*KEY, "decile")


R.cte(
    "binned",
    """SELECT *, CAST(greatest(1, least(ceil(10.0 * row_number() OVER (PARTITION BY report_period ORDER BY target, permno) / count(*) OVER (PARTITION BY report_period)), 10)) AS INTEGER) AS realised_decile,
        CAST(greatest(1, least(ceil(5.0 * row_number() OVER (PARTITION BY report_period ORDER BY f_value, permno) / count(*) OVER (PARTITION BY report_period)), 5)) AS INTEGER) AS size_quintile
    FROM scored""",
    "scored",
)


@case("w13_equal_count_bins", "SELECT report_period, permno, realised_decile, size_quintile FROM binned", uses="binned")
def _(spark, sf):
    frame = R.sample(spark, sf).select(*KEY, "target", "f_value")
    frame = ev.with_equal_bins(frame, "target", 10, "realised_decile")
    return ev.with_equal_bins(frame, "f_value", 5, "size_quintile").select(*KEY, "realised_decile", "size_quintile")


@case(
    "w14_quantile_bins",
    """SELECT s.report_period, s.permno, CAST(len(list_filter(e.edges, lambda x: s.f_discount > x)) + 1 AS INTEGER) AS bin
    FROM sample s, (SELECT list_distinct(quantile_cont(f_discount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM sample) e""",
    uses="sample",
)
def _(spark, sf):
    frame = R.sample(spark, sf).select(*KEY, "f_discount")
    return ev.with_quantile_bins(frame, "f_discount", 10, "bin").select(*KEY, "bin")


@case(
    "w18_dense_index",
    "SELECT report_period, permno, CAST(row_number() OVER (PARTITION BY report_period ORDER BY permno) - 1 AS INTEGER) AS node_index FROM sample",
    uses="sample",
)
def _(spark, sf):
    return order.with_dense_index(R.sample(spark, sf).select(*KEY), ["report_period"], "permno")


@case(
    "w9_share_of_total",
    "SELECT report_period, permno, f_value / sum(f_value) OVER (PARTITION BY report_period) AS share FROM sample",
    uses="sample", doubles="share",
)
def _(spark, sf):
    from quarterdeck.operators.aggregates import with_share_of_total

    return with_share_of_total(R.sample(spark, sf).select(*KEY, "f_value"), ["report_period"], "f_value").select(*KEY, "share")


# ------------------------------------------------------------------ preprocessing
LOGGED = ("f_value",)
PREPROCESSED = ("f_value", "f_size", "f_discount", "f_sparse")
R.cte("train", "SELECT * FROM sample WHERE sample_split = 'train'", "sample")
R.cte(
    "logged",
    "SELECT report_period, permno, sample_split, target, ln(1 + f_value) AS f_value, f_size, f_discount, f_sparse FROM sample",
    "sample",
)
R.cte(
    "bounds",
    "SELECT "
    + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lower, quantile_cont({c}, 0.99) AS {c}_upper" for c in PREPROCESSED)
    + " FROM logged WHERE sample_split = 'train'",
    "logged",
)
R.cte(
    "clipped",
    "SELECT report_period, permno, sample_split, target, "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lower), {c}_upper) END AS {c}" for c in PREPROCESSED)
    + " FROM logged, bounds",
    "logged bounds",
)
R.cte("medians", "SELECT " + ", ".join(f"median({c}) AS {c}_median" for c in PREPROCESSED) + " FROM clipped WHERE sample_split = 'train'", "clipped")
R.cte(
    "fitted",
    "SELECT bounds.*, medians.*, "
    + ", ".join(
        f"(SELECT avg(coalesce({c}, {c}_median)) FROM clipped, medians WHERE sample_split = 'train') AS {c}_mean, "
        f"(SELECT CASE WHEN stddev_pop(coalesce({c}, {c}_median)) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, {c}_median)) END FROM clipped, medians WHERE sample_split = 'train') AS {c}_deviation"
        for c in PREPROCESSED
    )
    + " FROM bounds, medians",
    "bounds medians clipped",
)
FITTED = " ".join(f"{c}_{k}" for c in PREPROCESSED for k in ("lower", "upper", "median", "mean", "deviation"))


@case("m1_fit_preprocessing", "SELECT * FROM fitted", uses="fitted", doubles=FITTED)
def _(spark, sf):
    train = R.sample(spark, sf).where("sample_split = 'train'")
    return md.fit_preprocessing(train, PREPROCESSED, LOGGED)


@case(
    "m2_apply_preprocessing",
    "SELECT report_period, permno, "
    + ", ".join(f"(coalesce(c.{c}, f.{c}_median) - f.{c}_mean) / f.{c}_deviation AS {c}" for c in PREPROCESSED)
    + " FROM clipped c, fitted f",
    uses="clipped fitted", doubles=" ".join(PREPROCESSED),
)
def _(spark, sf):
    sample = R.sample(spark, sf)
    parameters = md.fit_preprocessing(sample.where("sample_split = 'train'"), PREPROCESSED, LOGGED)
    return md.apply_preprocessing(sample, parameters, PREPROCESSED, LOGGED).select(*KEY, *PREPROCESSED)


# ------------------------------------------------------------------ errors and rank agreement
R.cte(
    "qspear",
    f"""SELECT report_period, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS spearman
    FROM (SELECT report_period, {pct_sql('prediction', 'report_period', 's')} AS a, {pct_sql('target', 'report_period', 's')} AS b FROM sample)
    GROUP BY report_period""",
    "sample",
)
PERFORMANCE = "mae rmse r2 mean_quarterly_spearman"


@case(
    "m8_performance",
    """SELECT count(*) AS observations, count(DISTINCT report_period) AS quarters, avg(abs(target - prediction)) AS mae,
        sqrt(avg((target - prediction) * (target - prediction))) AS rmse,
        1 - sum((target - prediction) * (target - prediction)) / (count(*) * var_pop(target)) AS r2,
        (SELECT avg(spearman) FROM qspear) AS mean_quarterly_spearman FROM sample""",
    uses="sample qspear", doubles=PERFORMANCE,
)
def _(spark, sf):
    return ev.performance(R.sample(spark, sf))


@case(
    "m7_mean_forecast",
    """SELECT sample_split, count(*) AS observations, avg(abs(target - m)) AS mae
    FROM sample, (SELECT avg(target) AS m FROM train) GROUP BY sample_split""",
    uses="sample train", doubles="mae",
)
def _(spark, sf):
    sample = R.sample(spark, sf)
    forecast = ev.mean_forecast(sample.where("sample_split = 'train'"), sample, output="naive")
    return forecast.groupBy("sample_split").agg(
        F.count(F.lit(1)).alias("observations"), F.avg(F.abs(F.col("target") - F.col("naive"))).alias("mae")
    )


@case("m10_quarterly_spearman", "SELECT * FROM qspear", uses="qspear", doubles="spearman")
def _(spark, sf):
    return ev.grouped_spearman(R.sample(spark, sf), ["report_period"], "prediction", "target")


FEATS = ["f_size", "f_discount", "f_tax", "f_value", "f_sparse"]
PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1 :]]


def _corr_sql(keys: str, select_keys: str) -> str:
    ranks = ", ".join(f"{pct_sql(c, keys, 's')} AS {c}" for c in FEATS)
    inner = f"SELECT {select_keys}{ranks} FROM sample"
    group = " GROUP BY report_period" if select_keys else ""
    parts = [
        f"SELECT {select_keys}'{a}' AS first_feature, '{b}' AS second_feature, CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 "
        f"AND stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 THEN corr({a}, {b}) END AS correlation FROM r{group}"
        for a, b in PAIRS
    ]
    return f"WITH r AS ({inner}) " + " UNION ALL ".join(parts)


@case("m11_pooled_rank_correlations", _corr_sql("1", ""), uses="sample", doubles="correlation")
def _(spark, sf):
    return ev.rank_correlations(R.sample(spark, sf), FEATS, KEY)


@case(
    "m11_mean_quarterly_correlations",
    f"SELECT first_feature, second_feature, avg(correlation) AS correlation FROM ({_corr_sql('report_period', 'report_period, ')}) GROUP BY ALL",
    uses="sample", doubles="correlation",
)
def _(spark, sf):
    quarterly = ev.rank_correlations(R.sample(spark, sf), FEATS, KEY, ["report_period"])
    return quarterly.groupBy("first_feature", "second_feature").agg(F.avg("correlation").alias("correlation"))


@case(
    "m11_strong_pairs",
    f"SELECT * FROM ({_corr_sql('1', '')}) WHERE abs(correlation) >= 0.2",
    uses="sample", doubles="correlation",
)
def _(spark, sf):
    return ev.rank_correlations(R.sample(spark, sf), FEATS, KEY).where(F.abs("correlation") >= 0.2)


@case(
    "m12_binned_relationship",
    """WITH b AS (SELECT report_period, target, CAST(ceil(10.0 * row_number() OVER (PARTITION BY report_period ORDER BY f_sparse, permno) / count(*) OVER (PARTITION BY report_period)) AS INTEGER) AS bin
        FROM sample WHERE f_sparse IS NOT NULL),
    m AS (SELECT bin, count(*) AS quarters, avg(x) AS mean_target FROM (SELECT report_period, bin, avg(target) AS x FROM b GROUP BY ALL) GROUP BY bin)
    SELECT *, (SELECT mean_target FROM m WHERE bin = 10) - (SELECT mean_target FROM m WHERE bin = 1) AS top_minus_bottom FROM m""",
    uses="sample", doubles="mean_target top_minus_bottom",
)
def _(spark, sf):
    return ev.binned_relationship(R.sample(spark, sf).select(*KEY, "f_sparse", "target"), "f_sparse")


@case(
    "m13_temporal_stability",
    """WITH q AS (SELECT report_period, feature, median(v) AS m FROM (UNPIVOT (SELECT report_period, f_size, f_discount, f_tax FROM sample) ON f_size, f_discount, f_tax INTO NAME feature VALUE v) GROUP BY ALL)
    SELECT feature, count(*) AS quarters, min(m) AS lowest_median, max(m) AS highest_median, arg_min(m, report_period) AS first_median, arg_max(m, report_period) AS last_median
    FROM q GROUP BY feature""",
    uses="sample", doubles="lowest_median highest_median first_median last_median",
)
def _(spark, sf):
    return ev.temporal_stability(R.sample(spark, sf), ["f_size", "f_discount", "f_tax"])


@case(
    "m13_graph_size_correlation",
    """WITH q AS (SELECT report_period, feature, median(v) AS m FROM (UNPIVOT (SELECT report_period, f_size, f_discount, f_tax FROM sample) ON f_size, f_discount, f_tax INTO NAME feature VALUE v) GROUP BY ALL),
    j AS (SELECT feature, m, n FROM q JOIN (SELECT report_period, count(*) AS n FROM holdings GROUP BY 1) USING (report_period)),
    r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY m) + (count(*) OVER (PARTITION BY feature, m) - 1) / 2.0 AS a,
            rank() OVER (PARTITION BY feature ORDER BY n) + (count(*) OVER (PARTITION BY feature, n) - 1) / 2.0 AS b FROM j)
    SELECT feature, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) END AS size_spearman FROM r GROUP BY 1""",
    uses="sample holdings", doubles="size_spearman",
)
def _(spark, sf):
    sizes = R.holdings(spark, sf).groupBy("report_period").agg(F.count(F.lit(1)).alias("size"))
    return ev.graph_size_correlation(R.sample(spark, sf), sizes, ["f_size", "f_discount", "f_tax"])


CAL = "mean_prediction mean_actual bias mae"


def _calibration_sql(column: str) -> str:
    return (
        f"SELECT {column}, count(*) AS observations, avg(prediction) AS mean_prediction, avg(target) AS mean_actual, "
        f"avg(prediction - target) AS bias, avg(abs(prediction - target)) AS mae FROM binned GROUP BY {column}"
    )


@case("m14_calibration_by_predicted_decile", _calibration_sql("decile"), uses="binned", doubles=CAL)
def _(spark, sf):
    return ev.calibration(scored(spark, sf), "decile")


@case("m14_error_by_realised_decile", _calibration_sql("realised_decile"), uses="binned", doubles=CAL)
def _(spark, sf):
    return ev.calibration(ev.with_equal_bins(R.sample(spark, sf), "target", 10, "realised_decile"), "realised_decile")


@case("m14_error_by_size_quintile", _calibration_sql("size_quintile"), uses="binned", doubles=CAL)
def _(spark, sf):
    return ev.calibration(ev.with_equal_bins(R.sample(spark, sf), "f_value", 5, "size_quintile"), "size_quintile")


DECILE_OUT = "mean_prediction mean_target median_target mean_outcome_volatility mean_five_day_loss mean_outcome_return"


@case(
    "m17_decile_outcomes",
    """SELECT report_period, decile, count(*) AS stocks, avg(prediction) AS mean_prediction, avg(target) AS mean_target, median(target) AS median_target,
        avg(outcome_volatility) AS mean_outcome_volatility, avg(greatest(0.0, -outcome_five_day)) AS mean_five_day_loss, avg(outcome_return) AS mean_outcome_return
    FROM scored GROUP BY report_period, decile""",
    uses="scored", doubles=DECILE_OUT,
)
def _(spark, sf):
    frame = scored(spark, sf).withColumn("five_day_loss", loss_magnitude(F.col("outcome_five_day")))
    return ev.decile_outcomes(
        frame, ["prediction", "target", "outcome_volatility", "five_day_loss", "outcome_return"], "target"
    )


R.cte(
    "ranksum",
    f"""SELECT d.report_period, d.stocks, q.stock_spearman, d.decile_spearman, d.top_minus_bottom FROM (
        SELECT report_period, CAST(sum(n) AS BIGINT) AS stocks, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS decile_spearman,
            max(m) FILTER (WHERE decile = 10) - max(m) FILTER (WHERE decile = 1) AS top_minus_bottom
        FROM (SELECT *, {pct_sql('decile', 'report_period', 'd')} AS ra, {pct_sql('m', 'report_period', 'd')} AS rb
              FROM (SELECT report_period, decile, count(*) AS n, avg(target) AS m FROM scored GROUP BY ALL)) GROUP BY report_period) d
    JOIN (SELECT report_period, spearman AS stock_spearman FROM qspear) q USING (report_period)""",
    "scored qspear",
)


@case("m18_rank_summary", "SELECT * FROM ranksum", uses="ranksum", doubles="stock_spearman decile_spearman top_minus_bottom")
def _(spark, sf):
    return ev.rank_summary(scored(spark, sf))


ALT = """
    SELECT report_period, information_date, permno, sample_split, target, target_value FROM (
        SELECT report_period, information_date, permno, sample_split, 'future_downside_volatility' AS target, outcome_volatility AS target_value, target_window_end AS w FROM sample
        UNION ALL SELECT report_period, information_date, permno, sample_split, 'future_worst_five_day_loss', greatest(0.0, -outcome_five_day), target_window_end FROM sample
        UNION ALL SELECT report_period, information_date, permno, sample_split, 'future_max_drawdown_' || h || 'd', target * h / 63.0, CAST(information_date + CAST(h AS INTEGER) AS DATE)
            FROM sample, (VALUES (21), (126)) hs(h) WHERE (permno + h) % 5 <> 0)
    WHERE NOT ((sample_split = 'train' AND w >= (SELECT min(information_date) FROM sample WHERE sample_split = 'validation'))
        OR (sample_split = 'validation' AND w >= (SELECT min(information_date) FROM sample WHERE sample_split = 'test')))
        AND target_value IS NOT NULL
"""
R.cte("altsample", ALT, "sample")


def alternative_sample(spark, sf):
    base = cut_lineage(R.sample(spark, sf).withColumnsRenamed(
        {"outcome_volatility": "future_downside_volatility", "outcome_five_day": "future_worst_rolling_return"}
    ))
    horizon = F.explode(F.array(F.lit(21), F.lit(126))).alias("horizon_market_days")
    other = base.select("report_period", "information_date", "permno", "target", horizon).select(
        "report_period", "information_date", "permno", "horizon_market_days",
        ((F.col("permno") + F.col("horizon_market_days")) % 5 != 0).alias("target_usable"),
        (F.col("target") * F.col("horizon_market_days") / 63.0).alias("future_max_drawdown"),
        F.date_add("information_date", F.col("horizon_market_days")).alias("target_window_end"),
    )
    return ev.alternative_samples(base, other)


@case("m19_alternative_target_samples", "SELECT * FROM altsample", uses="altsample", doubles="target_value")
def _(spark, sf):
    return alternative_sample(spark, sf).select(
        "report_period", "information_date", "permno", "sample_split", "target", "target_value"
    )


R.cte(
    "altscored",
    f"""SELECT *, CAST(greatest(1, least(floor(score / 10.0) + 1, 10)) AS INTEGER) AS decile FROM (
        SELECT *, 100.0 * ({pct_sql('prediction', 'target_name, report_period', 'a')}) AS score FROM (
            SELECT a.report_period, a.permno, a.target AS target_name, a.target_value, s.prediction FROM altsample a JOIN sample s USING (report_period, permno) WHERE a.sample_split = 'test'))""",
    "altsample sample",
)


@case(
    "m20_robustness_report",
    f"""WITH q AS (SELECT target_name, report_period, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ss FROM (
            SELECT target_name, report_period, {pct_sql('score', 'target_name, report_period', 's')} AS a, {pct_sql('target_value', 'target_name, report_period', 's')} AS b FROM altscored) GROUP BY ALL),
    d AS (SELECT target_name, report_period, decile, avg(target_value) AS m FROM altscored GROUP BY ALL),
    e AS (SELECT target_name, report_period, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ds, max(m) FILTER (WHERE decile = 10) - max(m) FILTER (WHERE decile = 1) AS sp FROM (
            SELECT *, {pct_sql('decile', 'target_name, report_period', 's')} AS a, {pct_sql('m', 'target_name, report_period', 's')} AS b FROM d) GROUP BY ALL)
    SELECT target_name, count(*) AS test_observations, count(DISTINCT report_period) AS test_quarters, avg(abs(target_value - prediction)) AS mae,
        sqrt(avg((target_value - prediction) * (target_value - prediction))) AS rmse,
        1 - sum((target_value - prediction) * (target_value - prediction)) / (count(*) * var_pop(target_value)) AS r2,
        (SELECT avg(ss) FROM q WHERE q.target_name = x.target_name) AS mean_quarterly_spearman,
        (SELECT avg(ds) FROM e WHERE e.target_name = x.target_name) AS mean_decile_spearman,
        (SELECT avg(sp) FROM e WHERE e.target_name = x.target_name) AS mean_top_bottom_spread
    FROM altscored x GROUP BY target_name""",
    uses="altscored", doubles="mae rmse r2 mean_quarterly_spearman mean_decile_spearman mean_top_bottom_spread",
)
def _(spark, sf):
    predictions = R.sample(spark, sf).select(*KEY, "prediction")
    frame = alternative_sample(spark, sf).where("sample_split = 'test'").withColumnRenamed("target", "target_name")
    return ev.robustness_report(cut_lineage(frame.join(predictions, KEY)))


MODELS_SQL = """SELECT 'linear' AS model, *, prediction AS p FROM sample UNION ALL SELECT 'tax' AS model, *, outcome_volatility AS p FROM sample
    UNION ALL SELECT 'naive' AS model, *, (SELECT avg(target) FROM sample WHERE sample_split = 'train') AS p FROM sample"""
R.cte("models", MODELS_SQL, "sample")


def model_predictions(spark, sf):
    sample = R.sample(spark, sf)
    naive = sample.where("sample_split = 'train'").agg(F.avg("target").alias("m")).scalar()
    named = F.array(
        F.struct(F.lit("linear").alias("model"), F.col("prediction").alias("p")),
        F.struct(F.lit("tax").alias("model"), F.col("outcome_volatility").alias("p")),
        F.struct(F.lit("naive").alias("model"), F.col("_naive").alias("p")),
    )
    return sample.withColumn("_naive", naive).select(
        *KEY, "sample_split", "target", "information_date", F.inline(named)
    )


@case(
    "m21_generalisation_gap",
    """SELECT model, avg(abs(target - p)) FILTER (WHERE sample_split = 'train') AS train_mae, avg(abs(target - p)) FILTER (WHERE sample_split = 'validation') AS validation_mae,
        avg(abs(target - p)) FILTER (WHERE sample_split = 'test') AS test_mae,
        avg(abs(target - p)) FILTER (WHERE sample_split = 'validation') - avg(abs(target - p)) FILTER (WHERE sample_split = 'train') AS generalization_gap
    FROM models GROUP BY model""",
    uses="models", doubles="train_mae validation_mae test_mae generalization_gap",
)
def _(spark, sf):
    return ev.generalization_gap(model_predictions(spark, sf), prediction="p")


@case(
    "m21_error_by_realised_decile_and_model",
    """SELECT model, realised_decile, count(*) AS observations, avg(abs(target - p)) AS mae FROM models
    JOIN (SELECT report_period, permno, realised_decile FROM binned) USING (report_period, permno) GROUP BY ALL""",
    uses="models binned", doubles="mae",
)
def _(spark, sf):
    bins = ev.with_equal_bins(R.sample(spark, sf).select(*KEY, "target"), "target", 10, "realised_decile").drop("target")
    joined = model_predictions(spark, sf).join(bins, KEY)
    return joined.groupBy("model", "realised_decile").agg(
        F.count(F.lit(1)).alias("observations"), F.avg(F.abs(F.col("target") - F.col("p"))).alias("mae")
    )


@case(
    "m21_quarterly_relative_error",
    """SELECT report_period, avg(abs(target - prediction)) AS mae, avg(abs(target - m)) AS naive_mae, avg(abs(target - prediction)) / avg(abs(target - m)) AS relative_mae
    FROM sample, (SELECT avg(target) AS m FROM train) GROUP BY report_period""",
    uses="sample train", doubles="mae naive_mae relative_mae",
)
def _(spark, sf):
    sample = R.sample(spark, sf)
    naive = sample.where("sample_split = 'train'").agg(F.avg("target").alias("m")).scalar()
    return ev.quarterly_relative_error(sample.withColumn("_naive", naive), F.col("_naive"))


@case(
    "m22_paired_comparison",
    f"""SELECT report_period, avg(abs(target - outcome_volatility)) - avg(abs(target - prediction)) AS mae_difference, corr(b, t) - corr(a, t) AS spearman_difference, corr(a, b) AS prediction_agreement
    FROM (SELECT *, {pct_sql('prediction', 'report_period', 's')} AS a, {pct_sql('outcome_volatility', 'report_period', 's')} AS b, {pct_sql('target', 'report_period', 's')} AS t FROM sample) GROUP BY report_period""",
    uses="sample", doubles="mae_difference spearman_difference prediction_agreement",
)
def _(spark, sf):
    frame = R.sample(spark, sf).select(*KEY, "prediction", "outcome_volatility", "target")
    return ev.paired_comparison(frame, "prediction", "outcome_volatility")


@case(
    "m22_increasing_decile_steps",
    """SELECT report_period, count(*) FILTER (WHERE m > p) AS increasing_steps FROM (
        SELECT *, lag(m) OVER (PARTITION BY report_period ORDER BY decile) AS p FROM (SELECT report_period, decile, avg(target) AS m FROM scored GROUP BY ALL)) GROUP BY 1""",
    uses="scored",
)
def _(spark, sf):
    return ev.increasing_decile_steps(ev.decile_outcomes(scored(spark, sf), ["target"]), "mean_target")


@case(
    "m23_residual_diagnostics",
    """SELECT count(*) AS observations, avg(res) AS bias, avg(abs(res)) FILTER (WHERE decile = 10) AS mae_top_predicted_decile,
        avg(abs(res)) FILTER (WHERE realised_decile = 10) AS mae_top_realised_decile, count(prev) AS consecutive_pairs, corr(res, prev) AS lag_one_correlation
    FROM (SELECT *, CASE WHEN date_diff('quarter', lag(report_period) OVER w, report_period) = 1 THEN lag(res) OVER w END AS prev
          FROM (SELECT *, prediction - target AS res FROM binned) WINDOW w AS (PARTITION BY permno ORDER BY report_period))""",
    uses="binned", doubles="bias mae_top_predicted_decile mae_top_realised_decile lag_one_correlation",
)
def _(spark, sf):
    frame = ev.with_equal_bins(scored(spark, sf), "target", 10, "realised_decile")
    return ev.residual_diagnostics(frame)


@case(
    "m23_quarterly_bias",
    """SELECT report_period, count(*) AS observations, avg(prediction) AS mean_prediction, avg(target) AS mean_actual, avg(prediction - target) AS bias,
        avg(abs(prediction - target)) AS mae FROM sample GROUP BY 1""",
    uses="sample", doubles="mean_prediction mean_actual bias mae",
)
def _(spark, sf):
    return ev.quarterly_bias(R.sample(spark, sf))


@case(
    "m24_target_availability",
    """SELECT h AS horizon_market_days, sample_split, count(*) AS rows, avg(CAST(CAST(information_date + CAST(h AS INTEGER) AS DATE) <= DATE '2001-06-30' AS DOUBLE)) AS complete_share,
        avg(CAST((permno + h) % 5 <> 0 AS DOUBLE)) AS usable_share FROM sample, (VALUES (21), (63), (126)) hs(h) GROUP BY ALL""",
    uses="sample", doubles="complete_share usable_share",
)
def _(spark, sf):
    from quarterdeck.plans.market import target_availability

    base = cut_lineage(R.sample(spark, sf).select(*KEY, "information_date", "sample_split"))
    horizon = F.explode(F.array(F.lit(21), F.lit(63), F.lit(126))).alias("horizon_market_days")
    windows = base.select(*KEY, "information_date", horizon).select(
        *KEY, "horizon_market_days",
        (F.date_add("information_date", F.col("horizon_market_days")) <= F.lit("2001-06-30").cast("date")).alias("target_window_complete"),
        ((F.col("permno") + F.col("horizon_market_days")) % 5 != 0).alias("target_usable"),
    )
    return target_availability(windows, base)


# ------------------------------------------------------------------ attribution
COEF = {"f_size": 0.02, "f_discount": -0.3, "f_tax": 0.15}
R.cte(
    "contrib",
    "SELECT report_period, permno, f_size, f_discount, f_tax, "
    + ", ".join(f"{v} * ({c} - avg({c}) OVER ()) AS c_{c}" for c, v in COEF.items())
    + " FROM sample",
    "sample",
)
VALUES = {f"c_{c}": c for c in COEF}


def contributions(spark, sf):
    return md.linear_contributions(R.sample(spark, sf).select(*KEY, *COEF), COEF)


@case(
    "m16_attribution_summary",
    "WITH a AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs(c_{c})) AS mean_absolute, corr(x, y) AS direction FROM (SELECT c_{c}, {pct_sql('c_' + c, '1', 's')} AS x, {pct_sql(c, '1', 's')} AS y FROM contrib)"
        for c in COEF
    )
    + ") SELECT *, mean_absolute / sum(mean_absolute) OVER () AS share FROM a",
    uses="contrib", doubles="mean_absolute share direction",
)
def _(spark, sf):
    return ev.attribution_summary(contributions(spark, sf), VALUES, KEY)


@case(
    "m16_quarterly_shares",
    "WITH a AS ("
    + " UNION ALL ".join(f"SELECT report_period, '{c}' AS feature, avg(abs(c_{c})) AS m FROM contrib GROUP BY 1" for c in COEF)
    + """) SELECT report_period, feature, m / sum(m) OVER (PARTITION BY report_period) AS share,
        CAST(row_number() OVER (PARTITION BY report_period ORDER BY m DESC, feature) AS INTEGER) AS share_rank FROM a""",
    uses="contrib", doubles="share",
)
def _(spark, sf):
    return ev.quarterly_attribution_shares(contributions(spark, sf), VALUES)


@case(
    "m16_share_rank_stability",
    "WITH a AS ("
    + " UNION ALL ".join(f"SELECT report_period, '{c}' AS feature, avg(abs(c_{c})) AS m FROM contrib GROUP BY 1" for c in COEF)
    + """), r AS (SELECT report_period, feature, row_number() OVER (PARTITION BY report_period ORDER BY m DESC, feature) AS k FROM a),
    p AS (SELECT corr(x.k, y.k) AS c FROM r x JOIN r y ON x.feature = y.feature AND x.report_period < y.report_period GROUP BY x.report_period, y.report_period)
    SELECT count(*) AS quarter_pairs, avg(c) AS mean_rank_correlation, min(c) AS lowest_rank_correlation FROM p""",
    uses="contrib", doubles="mean_rank_correlation lowest_rank_correlation",
)
def _(spark, sf):
    return ev.share_rank_stability(ev.quarterly_attribution_shares(contributions(spark, sf), VALUES))


@case(
    "m16_dependence_bins",
    """SELECT bin, count(*) AS observations, avg(f_size) AS mean_feature, avg(c_f_size) AS mean_contribution FROM (
        SELECT f_size, c_f_size, CAST(ceil(20.0 * row_number() OVER (ORDER BY f_size, rid) / count(*) OVER ()) AS INTEGER) AS bin
        FROM (SELECT *, permno * 100000 + year(report_period) * 10 + quarter(report_period) AS rid FROM contrib)) GROUP BY bin""",
    uses="contrib", doubles="mean_feature mean_contribution",
)
def _(spark, sf):
    rid = F.col("permno") * 100000 + F.year("report_period") * 10 + F.quarter("report_period")
    binned = ev.with_equal_bins(
        contributions(spark, sf).withColumn("rid", rid), "f_size", 20, "bin", keys=(), tie="rid"
    )
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("f_size").alias("mean_feature"),
        F.avg("c_f_size").alias("mean_contribution"),
    )


# ------------------------------------------------------------------ models
MODEL_FEATURES = ["f_value", "f_size", "f_spread", "f_sparse"]


def prepared(spark, sf):
    sample = cut_lineage(R.sample(spark, sf))
    parameters = cut_lineage(md.fit_preprocessing(sample.where("sample_split = 'train'"), MODEL_FEATURES, LOGGED))
    return cut_lineage(md.apply_preprocessing(sample, parameters, MODEL_FEATURES, LOGGED))


def register_standardised(prefix: str, fitting: str) -> None:
    """CTE ``<prefix>z``: model features z1 to z4 after logs, bounds, medians and scaling fitted on some splits."""
    features = MODEL_FEATURES
    R.cte(
        f"{prefix}log", "SELECT report_period, information_date, permno, sample_split, target, ln(1 + f_value) AS f_value, f_size, f_spread, f_sparse FROM sample",
        "sample",
    )
    R.cte(
        f"{prefix}bounds",
        "SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lower, quantile_cont({c}, 0.99) AS {c}_upper, median({c}) AS {c}_middle" for c in features)
        + f" FROM {prefix}log WHERE {fitting}",
        f"{prefix}log",
    )
    R.cte(
        f"{prefix}filled",
        "SELECT report_period, information_date, permno, sample_split, target, "
        + ", ".join(f"least(greatest(coalesce({c}, {c}_middle), {c}_lower), {c}_upper) AS {c}" for c in features)
        + f" FROM {prefix}log, {prefix}bounds",
        f"{prefix}log {prefix}bounds",
    )
    R.cte(
        f"{prefix}scale",
        "SELECT " + ", ".join(f"avg({c}) AS {c}_mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_sd" for c in features)
        + f" FROM {prefix}filled WHERE {fitting}",
        f"{prefix}filled",
    )
    R.cte(
        f"{prefix}z",
        "SELECT report_period, information_date, permno, sample_split, target, "
        + ", ".join(f"({c} - {c}_mean) / {c}_sd AS z{i}" for i, c in enumerate(features, 1)) + f" FROM {prefix}filled, {prefix}scale",
        f"{prefix}filled {prefix}scale",
    )


def elimination_sql(start: str, size: int, right: int, keep: str) -> str:
    """Gauss-Jordan elimination in SQL: rows of ``start`` hold m_i_j, ``size`` equations with ``right`` right-hand sides."""
    steps, columns = [f"e0 AS ({start})"], size + right
    for k in range(size):
        cells = [
            f"m_{i}_{j}" + ("" if i == k or j <= k else f" - m_{i}_{k} * m_{k}_{j} / m_{k}_{k}") + f" AS m_{i}_{j}"
            for i in range(size) for j in range(columns) if j > k or j == i
        ]
        steps.append(f"e{k + 1} AS (SELECT {keep}, {', '.join(cells)} FROM e{k})")
    return ", ".join(steps)


def ridge_sql(table: str, fitting: str, features: int, alphas: str) -> str:
    """CTEs ending in ``beta`` (alpha, b0, b1, ...) by normal equations on z1 to z<features>."""
    names = ["1.0", *[f"z{i}" for i in range(1, features + 1)], "target"]
    sums = ", ".join(f"sum({names[i]} * {names[j]}) AS s_{i}_{j}" for i in range(features + 1) for j in range(features + 2))
    cells = ", ".join(
        f"s_{i}_{j}" + (" + alpha" if i == j and i else "") + f" AS m_{i}_{j}" for i in range(features + 1) for j in range(features + 2)
    )
    solved = elimination_sql(f"SELECT alpha, {cells} FROM gram, (VALUES {alphas}) a(alpha)", features + 1, 1, "alpha")
    betas = ", ".join(f"m_{i}_{features + 1} / m_{i}_{i} AS b{i}" for i in range(features + 1))
    return (
        f"gram AS (SELECT {sums} FROM {table} WHERE ({fitting}) AND target IS NOT NULL), {solved}, "
        f"beta AS (SELECT alpha, {betas} FROM e{features + 1})"
    )


def linear_sql(features: int) -> str:
    return "least(greatest(b0" + "".join(f" + b{i} * z{i}" for i in range(1, features + 1)) + ", 0.0), 1.0)"


register_standardised("m", "sample_split = 'train'")
register_standardised("r", "sample_split IN ('train', 'validation')")
ALPHAS = "(0.01), (0.1), (1.0), (10.0), (100.0)"


@case(
    "m4_ridge_tuning",
    f"""WITH {ridge_sql('mz', "sample_split = 'train'", 4, ALPHAS)},
    p AS (SELECT CAST(alpha AS DOUBLE) AS alpha, report_period, target, {linear_sql(4)} AS p FROM mz, beta WHERE sample_split = 'validation'),
    k AS (SELECT alpha, report_period, rank() OVER (PARTITION BY alpha, report_period ORDER BY target) + (count(*) OVER (PARTITION BY alpha, report_period, target) - 1) / 2.0 AS a,
            rank() OVER (PARTITION BY alpha, report_period ORDER BY p) + (count(*) OVER (PARTITION BY alpha, report_period, p) - 1) / 2.0 AS b FROM p),
    q AS (SELECT alpha, avg(c) AS mean_quarterly_spearman FROM (SELECT alpha, corr(a, b) AS c FROM k GROUP BY alpha, report_period) GROUP BY 1),
    e AS (SELECT alpha, avg(abs(target - p)) AS mae, sqrt(avg((target - p) * (target - p))) AS rmse,
            1 - sum((target - p) * (target - p)) / (count(*) * var_pop(target)) AS r2 FROM p GROUP BY 1)
    SELECT alpha, mae, rmse, r2, mean_quarterly_spearman, alpha = (SELECT arg_min(alpha, mae) FROM e) AS selected FROM e JOIN q USING (alpha)""",
    uses="mz", doubles="alpha mae rmse r2 mean_quarterly_spearman",
)
def _(spark, sf):
    frame = prepared(spark, sf)
    return md.tune_ridge(
        frame.where("sample_split = 'train'"), frame.where("sample_split = 'validation'"), MODEL_FEATURES, "target"
    )


GROUPS = {"market": MODEL_FEATURES[:2], "augmented": MODEL_FEATURES[:3], "network_augmented": MODEL_FEATURES}


def raw_features(spark, sf):
    sample = cut_lineage(R.sample(spark, sf).select(*KEY, "target", "sample_split", *MODEL_FEATURES))
    parameters = cut_lineage(md.fit_preprocessing(sample.where("sample_split = 'train'"), MODEL_FEATURES, LOGGED))
    return md.apply_preprocessing(sample, parameters, MODEL_FEATURES, LOGGED, standardize=False)


@case("m5_boosted_tree_tuning")
def _(spark, sf):
    return md.tune_boosted_trees(raw_features(spark, sf), MODEL_FEATURES, "target")[0]


@case("m5_boosting_history")
def _(spark, sf):
    return md.tune_boosted_trees(raw_features(spark, sf), MODEL_FEATURES, "target")[1]


@case(
    "m6_fixed_specification_refit",
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {ridge_sql('rz', 'sample_split IN (' + chr(39) + 'train' + chr(39) + ', ' + chr(39) + 'validation' + chr(39) + ')', n, '(1.0)')} "
        f"SELECT report_period, information_date, permno, target, '{name}' AS feature_group, {linear_sql(n)} AS prediction "
        "FROM rz, beta WHERE sample_split = 'test')"
        for name, n in (("market", 2), ("augmented", 3), ("network_augmented", 4))
    ),
    uses="rz", doubles="target prediction",
)
def _(spark, sf):
    return md.refit_feature_groups(R.sample(spark, sf), GROUPS, "target", alpha=1.0, logged=LOGGED)


@case("m6_boosted_refit")
def _(spark, sf):
    fixed = {"depth": 3, "child": 1, "subsample": 0.8, "rounds": 400}
    return md.refit_feature_groups(R.sample(spark, sf), GROUPS, "target", trees=fixed, logged=LOGGED, model_class="trees")


@case("m9_staged_selection")
def _(spark, sf):
    return md.staged_selection(R.sample(spark, sf), GROUPS, "target", LOGGED, rival=("score", "prediction"))


# Of the centred cross products c: degrees of freedom are the features less alpha times the trace of the inverse of c + alpha.
CENTRED = (
    "SELECT alpha, " + ", ".join(
        [f"s_{i}_{j} - s_0_{i} * s_0_{j} / s_0_0" + (" + alpha" if i == j else "") + f" AS m_{i - 1}_{j - 1}" for i in range(1, 5) for j in range(1, 5)]
        + [f"{1.0 if i == j else 0.0} AS m_{i}_{4 + j}" for i in range(4) for j in range(4)]
    ) + f" FROM gram, (VALUES {ALPHAS}) a(alpha)"
)
SQUARES = "s_5_5 - 2 * (" + " + ".join(f"b{i} * s_{i}_5" for i in range(5)) + ") + " + " + ".join(
    f"b{i} * b{j} * s_{i}_{j}" for i in range(5) for j in range(5)
)


@case(
    "m15_ridge_complexity",
    f"""WITH {ridge_sql('mz', "sample_split = 'train'", 4, ALPHAS)}, yy AS (SELECT sum(target * target) AS s_5_5 FROM mz WHERE sample_split = 'train' AND target IS NOT NULL),
    f AS (SELECT * FROM (WITH {elimination_sql(CENTRED, 4, 4, 'alpha')} SELECT alpha, 4 - alpha * ({' + '.join(f'm_{i}_{4 + i} / m_{i}_{i}' for i in range(4))}) AS df FROM e4)),
    t AS (SELECT alpha, CAST(s_0_0 AS BIGINT) AS n, df, {SQUARES} AS rss, s_5_5 - s_0_5 * s_0_5 / s_0_0 AS tss FROM beta JOIN f USING (alpha), gram, yy)
    SELECT CAST(alpha AS DOUBLE) AS alpha, n AS observations, df AS effective_degrees, 1 - rss / tss AS r2, 1 - (rss / tss) * (n - 1) / (n - df - 1) AS adjusted_r2,
        n * ln(rss / n) + 2 * (df + 1) AS aic, n * ln(rss / n) + ln(n) * (df + 1) AS bic FROM t""",
    uses="mz", doubles="alpha effective_degrees r2 adjusted_r2 aic bic",
)
def _(spark, sf):
    frame = prepared(spark, sf)
    return md.ridge_complexity(frame.where("sample_split = 'train'"), MODEL_FEATURES, "target")


@case(
    "t5_best_candidate",
    """SELECT model, mae FROM (SELECT model, avg(abs(target - p)) AS mae FROM models WHERE sample_split = 'validation' GROUP BY 1) ORDER BY mae, model LIMIT 1""",
    uses="models", doubles="mae",
)
def _(spark, sf):
    table = model_predictions(spark, sf).where("sample_split = 'validation'").groupBy("model").agg(
        F.avg(F.abs(F.col("target") - F.col("p"))).alias("mae")
    )
    return md.best_candidate(table, "mae", "model")


@case(
    "g24_pair_correlations",
    """SELECT report_period, corr(target, prediction) AS target_prediction, corr(target, f_size) AS target_size, corr(f_sparse, f_value) AS sparse_value FROM sample GROUP BY 1""",
    uses="sample", doubles="target_prediction target_size sparse_value",
)
def _(spark, sf):
    return R.sample(spark, sf).groupBy("report_period").agg(
        guarded_corr(F.col("target"), F.col("prediction")).alias("target_prediction"),
        guarded_corr(F.col("target"), F.col("f_size")).alias("target_size"),
        guarded_corr(F.col("f_sparse"), F.col("f_value")).alias("sparse_value"),
    )


@case(
    "g15_sample_skewness",
    "SELECT report_period, skewness(f_value) AS value_skewness, skewness(f_tax) AS tax_skewness FROM sample GROUP BY 1",
    uses="sample", doubles="value_skewness tax_skewness",
)
def _(spark, sf):
    return R.sample(spark, sf).groupBy("report_period").agg(
        sample_skewness(F.col("f_value")).alias("value_skewness"), sample_skewness(F.col("f_tax")).alias("tax_skewness")
    )
