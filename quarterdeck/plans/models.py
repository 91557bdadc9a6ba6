"""Preprocessing, ridge and boosted-tree models, selection by validation error."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.functions import order
from quarterdeck.functions.scalars import clip
from quarterdeck.plans.boosting import (
    BOOSTED_GRID, MAX_ROUNDS, PATIENCE, Specification, boosting_history, fit_boosted, grid_specifications, score_boosted,
)
from quarterdeck.plans.evaluation import candidate_performance, error_metrics, performance
from quarterdeck.session import cut_lineage, stored_columns

# The regularisation grid and the quantiles used to bound features.
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
LOWER_QUANTILE, UPPER_QUANTILE = 0.01, 0.99


def _logged(name: str, logged: Sequence[str]) -> Column:
    value = F.col(name).cast("double")
    return F.log1p(value) if name in logged else value


def fit_preprocessing(frame: DataFrame, features: Sequence[str], logged: Sequence[str] = ()) -> DataFrame:
    """Bounds, medians, means and deviations of one fitting sample, as a one-row table.

    Quantiles of all features are taken together in long form, exactly and without gathering a
    feature's values in one task; the median of clipped values is the clipped median.
    """
    transformed = frame.select(*[_logged(f, logged).alias(f) for f in features])
    probabilities = {"lower": LOWER_QUANTILE, "median": 0.5, "upper": UPPER_QUANTILE}
    long = order.exact_quantiles_long(transformed, [], features, probabilities, "feature")
    bounds = long.agg(
        *[
            F.max(F.when(F.col("feature") == f, F.col(k))).alias(f"{f}_{k}")
            for f in features
            for k in ("lower", "upper", "median")
        ]
    )
    fit = bounds.select(F.struct("*").alias("b")).scalar()
    marked = transformed.withColumn("_b", fit)

    def filled(f: str) -> Column:
        bounded = clip(F.col(f), F.col(f"_b.{f}_lower"), F.col(f"_b.{f}_upper"))
        return F.coalesce(bounded, F.col(f"_b.{f}_median"))

    deviation = {f: F.stddev_pop(filled(f)) for f in features}
    return marked.agg(
        F.first("_b").alias("_b"),
        *[F.avg(filled(f)).alias(f"{f}_mean") for f in features],
        *[F.when(deviation[f] == 0, 1.0).otherwise(deviation[f]).alias(f"{f}_deviation") for f in features],
    ).select("_b.*", *[f"{f}_mean" for f in features], *[f"{f}_deviation" for f in features])


def apply_preprocessing(
    frame: DataFrame,
    parameters: DataFrame,
    features: Sequence[str],
    logged: Sequence[str] = (),
    standardize: bool = True,
) -> DataFrame:
    """Transform features by fitted parameters, read through a one-row subquery."""
    fit = parameters.select(F.struct("*").alias("p")).scalar()
    marked = frame.withColumn("_p", fit)
    columns = {}
    for f in features:
        bounded = clip(_logged(f, logged), F.col(f"_p.{f}_lower"), F.col(f"_p.{f}_upper"))
        value = F.coalesce(bounded, F.col(f"_p.{f}_median"))
        if standardize:
            value = (value - F.col(f"_p.{f}_mean")) / F.col(f"_p.{f}_deviation")
        columns[f] = value
    return marked.withColumns(columns).drop("_p")


def gram_sums(frame: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Cross products of [1, features] with themselves and the target, in one aggregation.

    Rows with a null feature or target are left out of every sum. Only (features + 2) squared
    numbers reach the driver, whatever the number of rows.
    """
    frame = frame.dropna(subset=[*features, target])
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    size = len(columns)
    sums = [
        F.sum(columns[i] * columns[j]).alias(f"s_{i}_{j}") for i in range(size) for j in range(i, size)
    ]
    row = frame.agg(*sums).first()
    full = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            full[i, j] = full[j, i] = row[f"s_{i}_{j}"] or 0.0
    return full[:-1, :-1], full[:-1, -1], float(full[-1, -1]), int(round(full[0, 0]))


def solve_ridge(gram: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients that minimise squared error plus ``alpha`` times the squared
    norm of the coefficients; the intercept is not penalised."""
    penalty = np.eye(len(gram)) * alpha
    penalty[0, 0] = 0.0
    return np.linalg.solve(gram + penalty, cross)


def linear_prediction(coefficients: Sequence[float], features: Sequence[str], bounded: bool = True) -> Column:
    value = F.lit(float(coefficients[0]))
    for weight, f in zip(coefficients[1:], features, strict=True):
        value = value + F.lit(float(weight)) * F.col(f)
    return clip(value, 0.0, 1.0) if bounded else value


def linear_contributions(frame: DataFrame, coefficients: Mapping[str, float], prefix: str = "c_") -> DataFrame:
    """Per-row contributions ``coefficient * (value - mean)`` of a linear model."""
    means = frame.agg(F.struct(*[F.avg(f).alias(f) for f in coefficients]).alias("m")).scalar()
    marked = frame.withColumn("_m", means)
    return marked.withColumns(
        {f"{prefix}{f}": F.lit(float(w)) * (F.col(f) - F.col(f"_m.{f}")) for f, w in coefficients.items()}
    ).drop("_m")


def tune_ridge(
    train: DataFrame, validation: DataFrame, features: Sequence[str], target: str,
    alphas: Sequence[float] = RIDGE_ALPHAS,
) -> DataFrame:
    """Validation errors of every penalty; the smallest MAE is marked as selected.

    The Gram matrix is aggregated once and solved for each penalty; all candidates are then
    scored together over the validation sample. Rank correlations need a column report_period.
    """
    gram, cross, _, _ = gram_sums(train, features, target)
    structs = [
        F.struct(F.lit(float(alpha)).alias("alpha"), linear_prediction(solve_ridge(gram, cross, alpha), features).alias("_p"))
        for alpha in alphas
    ]
    period = [c for c in ("report_period",) if c in validation.columns]
    rows = validation.select(*period, target, F.inline(F.array(*structs)))
    if period:
        table = performance(rows, target, "_p", by=["alpha"]).select("alpha", "mae", "rmse", "r2", "mean_quarterly_spearman")
    else:
        table = rows.groupBy("alpha").agg(*[c.alias(n) for n, c in error_metrics(F.col(target), F.col("_p")).items()])
    best = table.agg(F.min(F.struct("mae", "alpha")).alias("b")).scalar()
    return table.withColumn("selected", F.col("alpha") == best["alpha"])


def ridge_complexity(
    frame: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = RIDGE_ALPHAS
) -> DataFrame:
    """Effective degrees of freedom, adjusted R2, AIC and BIC per penalty.

    Everything follows from the aggregated cross products: the eigenvalues of the centred Gram
    matrix give the degrees of freedom, the quadratic form the residual sum of squares.
    """
    gram, cross, square, n = gram_sums(frame, features, target)
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    eigenvalues = np.clip(np.linalg.eigvalsh(centred), 0.0, None)
    total = square - cross[0] ** 2 / n
    rows = []
    for alpha in alphas:
        beta = solve_ridge(gram, cross, alpha)
        residual = float(square - 2 * beta @ cross + beta @ gram @ beta)
        freedom = float(np.sum(eigenvalues / (eigenvalues + alpha)))
        r2 = 1 - residual / total
        parameters = freedom + 1
        measures = (
            freedom,
            r2,
            1 - (1 - r2) * (n - 1) / (n - freedom - 1),
            n * math.log(residual / n) + 2 * parameters,
            n * math.log(residual / n) + math.log(n) * parameters,
        )
        rows.append((float(alpha), n, *[float(m) for m in measures]))
    schema = (
        "alpha double, observations long, effective_degrees double, r2 double, adjusted_r2 double, aic double, bic double"
    )
    return frame.sparkSession.createDataFrame(rows, schema)


def best_candidate(table: DataFrame, metric: str, tie: str) -> DataFrame:
    """The candidate with the smallest metric, ties by name."""
    return table.orderBy(F.col(metric), F.col(tie)).limit(1)


def tune_boosted_trees(
    frame: DataFrame, features: Sequence[str], target: str, grid: Sequence[tuple[int, int, float]] = BOOSTED_GRID,
    rounds: int = MAX_ROUNDS, patience: int = PATIENCE, seed: int = 13, max_rows: int = 200_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, history, fits) of the whole grid, fitted on train and stopped by validation.

    A candidate row has its settings, its best round and the errors of the model cut there over all
    validation rows; the smallest MAE is selected, ties by name.
    """
    specs = grid_specifications(features, grid, rounds, patience)
    train, validation = (frame.where(F.col("sample_split") == s) for s in ("train", "validation"))
    fits = fit_boosted(train, validation, target, specs, max_rows=max_rows, seed=seed)
    table = _scored_candidates(validation, fits, target)
    settings = F.map_from_entries(F.array(*[
        F.struct(F.lit(s.name), F.struct(
            F.lit(s.depth).alias("max_depth"), F.lit(s.child).alias("min_child_rows"), F.lit(float(s.subsample)).alias("subsample")
        )) for s in specs
    ]))
    table = table.join(fits.select("candidate", F.col("best_round").alias("rounds")), "candidate").withColumn("_s", settings[F.col("candidate")])
    table = cut_lineage(table.select("candidate", "_s.*", "rounds", "mae", "rmse", "r2", "mean_quarterly_spearman"))
    best = table.agg(F.min(F.struct("mae", "candidate")).alias("b")).scalar()
    return table.withColumn("selected", F.col("candidate") == best["candidate"]), boosting_history(fits), fits


def _scored_candidates(validation: DataFrame, fits: DataFrame, target: str) -> DataFrame:
    rows = validation.where(F.col(target).isNotNull())
    ranked = order.with_percentile_rank(rows, ["report_period"], target, "_actual_rank")
    scored = score_boosted(ranked, fits, "_prediction", ["report_period", target, "_actual_rank"])
    return candidate_performance(scored, target, "_prediction", "_actual_rank")


def fit_ridge(fitting: DataFrame, features: Sequence[str], target: str, alpha: float) -> np.ndarray:
    gram, cross, _, _ = gram_sums(fitting, features, target)
    return solve_ridge(gram, cross, alpha)


def refit_feature_groups(
    frame: DataFrame, groups: Mapping[str, Sequence[str]], target: str, alpha: float = 1.0,
    trees: Mapping[str, float] | None = None, logged: Sequence[str] = (), model_class: str = "ridge", seed: int = 13,
) -> DataFrame:
    """Refit a fixed specification on train plus validation and predict the test rows.

    ``frame`` has raw features: bounds, medians, means and deviations are fitted anew on the fitting
    rows. ``model_class`` is ridge (penalty ``alpha``) or trees (``trees``: depth, child, subsample, rounds).
    """
    union = list(dict.fromkeys(f for features in groups.values() for f in features))
    frame = stored_columns(frame, "report_period", "information_date", "permno", target, "sample_split", *union)
    fitting = frame.where(F.col("sample_split").isin("train", "validation"))
    parameters = cut_lineage(fit_preprocessing(fitting, union, logged))
    ready = apply_preprocessing(
        frame.where(F.col("sample_split").isin("train", "validation", "test")), parameters, union, logged,
        standardize=model_class == "ridge",
    )
    fitting, test = ready.where("sample_split <> 'test'"), ready.where("sample_split = 'test'")
    keys = ["report_period", "information_date", "permno", target]
    if model_class == "trees":
        specs = [Specification(name, tuple(f), patience=None, **(trees or {})) for name, f in groups.items()]
        fits = fit_boosted(fitting, None, target, specs, seed=seed)
        return score_boosted(test.select(*keys, *union), fits).select(
            *keys[:3], target, F.col("candidate").alias("feature_group"), "prediction"
        )
    predictions = [
        F.struct(
            F.lit(name).alias("feature_group"),
            linear_prediction(fit_ridge(fitting, features, target, alpha), features).alias("prediction"),
        )
        for name, features in groups.items()
    ]
    return test.select(*keys, F.inline(F.array(*predictions)))


def staged_selection(
    frame: DataFrame, groups: Mapping[str, Sequence[str]], target: str, logged: Sequence[str] = (),
    rival: tuple[str, str] | None = None, initial: Mapping[str, float] | None = None,
    grid: Sequence[tuple[int, int, float]] = BOOSTED_GRID, alphas: Sequence[float] = RIDGE_ALPHAS,
    rounds: int = MAX_ROUNDS, patience: int = PATIENCE, seed: int = 13,
) -> DataFrame:
    """Validation errors of each stage's candidates: model class, feature set, tuning, overall.

    The model class is decided on the first group with initial settings, the feature set for that
    class, then its tuning grid; overall, the tuned model meets a ``rival`` (name, column of its
    predictions). ``frame`` has raw features; preprocessing is fitted on train, standardised for ridge only.
    """
    union = list(dict.fromkeys(f for features in groups.values() for f in features))
    frame = stored_columns(
        frame, "report_period", "permno", target, "sample_split", *union, *([rival[1]] if rival is not None else [])
    )
    parameters = cut_lineage(fit_preprocessing(frame.where("sample_split = 'train'"), union, logged))
    rows = frame.where(F.col("sample_split").isin("train", "validation"))
    ready = {
        model: apply_preprocessing(rows, parameters, union, logged, standardize=model == "ridge")
        for model in ("ridge", "trees")
    }
    split = {
        (m, s): ready[m].where(F.col("sample_split") == s) for m in ready for s in ("train", "validation")
    }
    first = next(iter(groups))
    initial = {"depth": 3, "child": 1, "subsample": 0.8, "rounds": 400} | dict(initial or {})
    specs = [Specification(name, tuple(f), patience=None, **initial) for name, f in groups.items()]
    fits = fit_boosted(split["trees", "train"], None, target, specs, seed=seed)
    trees = _scored_candidates(split["trees", "validation"], fits, target).withColumnRenamed("candidate", "feature_group")
    ridge = _ridge_groups(split["ridge", "train"], split["ridge", "validation"], groups, target)
    mean = split["ridge", "train"].agg(F.avg(target).alias("m")).first()["m"]
    naive = performance(
        split["ridge", "validation"].select("report_period", target).withColumn("_prediction", F.lit(mean)), target, "_prediction"
    ).withColumn("feature_group", F.lit("none"))
    names = ["feature_group", "mae", "rmse", "r2", "mean_quarterly_spearman"]
    fixed = {m: {r["feature_group"]: tuple(r)[1:] for r in t.select(*names).collect()} for m, t in
             (("naive", naive), ("ridge", ridge), ("trees", trees))}
    out = [("model_class", "naive", "none", "initial", *fixed["naive"]["none"], False)]
    model = min(("ridge", "trees"), key=lambda m: fixed[m][first][0])
    out += [("model_class", m, first, "initial", *fixed[m][first], m == model) for m in ("ridge", "trees")]
    chosen = min(groups, key=lambda g: fixed[model][g][0])
    out += [("feature_set", model, g, "initial", *fixed[model][g], g == chosen) for g in groups]
    if model == "ridge":
        tuned = tune_ridge(split["ridge", "train"], split["ridge", "validation"], groups[chosen], target, alphas)
        tuned = tuned.withColumn("candidate", F.concat(F.lit("alpha_"), F.col("alpha").cast("string")))
    else:
        tuned = tune_boosted_trees(ready["trees"], groups[chosen], target, grid, rounds, patience, seed)[0]
    measured = [r for r in tuned.select("candidate", "mae", "rmse", "r2", "mean_quarterly_spearman", "selected").collect()]
    out += [("tuning", model, chosen, *tuple(r)) for r in measured]
    if rival is not None:
        best = next(tuple(r)[1:5] for r in measured if r["selected"])
        other = performance(
            split["ridge", "validation"].select("report_period", target, rival[1]), target, rival[1]
        ).select(*names[1:]).first()
        wins = best[0] <= other[0]
        out += [("overall", model, chosen, "selected", *best, wins), ("overall", rival[0], "own", "selected", *tuple(other), not wins)]
    return frame.sparkSession.createDataFrame(
        [(*r[:4], *[None if v is None else float(v) for v in r[4:8]], bool(r[8])) for r in out],
        "stage string, model_class string, feature_group string, candidate string, mae double, rmse double, r2 double, "
        "mean_quarterly_spearman double, selected boolean",
    )


def _ridge_groups(train: DataFrame, validation: DataFrame, groups: Mapping[str, Sequence[str]], target: str, alpha: float = 1.0) -> DataFrame:
    predictions = [
        F.struct(F.lit(name).alias("feature_group"), linear_prediction(fit_ridge(train, f, target, alpha), f).alias("_prediction"))
        for name, f in groups.items()
    ]
    rows = validation.select("report_period", target, F.inline(F.array(*predictions)))
    return performance(rows, target, "_prediction", by=["feature_group"])
