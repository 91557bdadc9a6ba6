"""Factor regressions with heteroskedasticity- and autocorrelation-consistent errors."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _symmetric_sums(columns: Sequence[Column], name: str) -> list[Column]:
    n = len(columns)
    return [F.sum(columns[i] * columns[j]).alias(f"{name}_{i}_{j}") for i in range(n) for j in range(i, n)]


def _symmetric(row, name: str, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"{name}_{i}_{j}"]
    return out


def hac_regression(
    frame: DataFrame, dependent: str, regressors: Sequence[str], lags: Sequence[int], order_by: str
) -> list[dict]:
    """Least squares with Bartlett-weighted error covariances, one result per lag.

    Two aggregations do the work: cross products give the coefficients; products of each day's
    scores with the lagged scores give the autocovariances. Only matrices of the number of
    regressors reach the driver. The frame is one daily series, so ordering it is bounded by
    the calendar. Days with a null value take no part, also in the numbering of lags.
    """
    frame = frame.dropna(subset=[dependent, *regressors])
    design = [F.lit(1.0), *[F.col(r).cast("double") for r in regressors]]
    y = F.col(dependent).cast("double")
    size = len(design)
    row = frame.agg(
        *_symmetric_sums(design, "x"), *[F.sum(x * y).alias(f"c_{i}") for i, x in enumerate(design)],
        F.sum(y * y).alias("yy"),
    ).first()
    gram = _symmetric(row, "x", size)
    cross = np.array([row[f"c_{i}"] for i in range(size)])
    n = int(round(gram[0, 0]))
    beta = np.linalg.solve(gram, cross)
    fitted = sum((F.lit(float(b)) * x for b, x in zip(beta, design, strict=True)), F.lit(0.0))
    scores = frame.select(order_by, *[((y - fitted) * x).alias(f"s_{i}") for i, x in enumerate(design)])
    time = Window.partitionBy(F.lit(1)).orderBy(order_by)
    longest = max(lags)
    names = [f"s_{i}" for i in range(size)]
    # Autocovariance l is the sum of products of a day's scores with those l rows earlier.
    lagged = scores.withColumn("_n", F.row_number().over(time))
    pairs = (
        lagged.select("_n", *names, F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("_l"))
        .withColumn("_m", F.col("_n") - F.col("_l"))
        .join(lagged.select(F.col("_n").alias("_m"), *[F.col(s).alias(f"p_{s}") for s in names]), "_m")
    )
    sums = pairs.groupBy("_l").agg(
        *[F.sum(F.col(a) * F.col(f"p_{b}")).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    ).collect()  # one row per lag
    gamma = {
        r["_l"]: np.array([[r[f"g_{i}_{j}"] for j in range(size)] for i in range(size)]) for r in sums
    }
    inverse = np.linalg.inv(gram)
    mean = cross[0] / n
    residual = float(row["yy"] - beta @ cross)
    total = float(row["yy"] - n * mean * mean)
    adjusted = 1 - (residual / (n - size)) / (total / (n - 1))
    results = []
    for lag in lags:
        middle = gamma[0].copy()
        for step in range(1, lag + 1):
            if step in gamma:
                middle += (1 - step / (lag + 1)) * (gamma[step] + gamma[step].T)
        covariance = inverse @ middle @ inverse
        error = math.sqrt(covariance[0, 0])
        t = beta[0] / error
        results.append(
            {
                "hac_lag": int(lag),
                "trading_days": n,
                "daily_alpha": float(beta[0]),
                "annualized_alpha": 252 * float(beta[0]),
                "alpha_standard_error": error,
                "alpha_t_statistic": float(t),
                "alpha_p_value": math.erfc(abs(t) / math.sqrt(2)),
                "adjusted_r_squared": float(adjusted),
                "market_beta": float(beta[1]),
            }
        )
    return results


def alpha_tests(
    frame: DataFrame,
    dependents: Sequence[str],
    models: Mapping[str, Sequence[str]],
    lags: Sequence[int],
    order_by: str,
) -> DataFrame:
    """Alpha and its inference for every return series, factor model and lag."""
    rows = []
    for dependent in dependents:
        for name, regressors in models.items():
            for result in hac_regression(frame, dependent, regressors, lags, order_by):
                rows.append((dependent, name, *result.values()))
    schema = (
        "series string, model string, hac_lag int, trading_days int, daily_alpha double, annualized_alpha double, "
        "alpha_standard_error double, alpha_t_statistic double, alpha_p_value double, adjusted_r_squared double, market_beta double"
    )
    return frame.sparkSession.createDataFrame(rows, schema)
