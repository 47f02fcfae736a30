"""Closed-form regressions and tests as aggregate expressions, and the normal distribution."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.session import ship

#: Euler's constant (fixed value).
EULER_GAMMA = 0.5772156649015329


def hedge(y: str, x: str) -> list[Column]:
    """alpha and beta of y on x."""
    return [F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta")]


def unit_root(change: str = "dy", level: str = "y0") -> list[Column]:
    """Regression of a series' change on its level: gamma, n, tau (Dickey-Fuller), sigma (residual deviation over n)."""
    g, n, sxx, syy, sxy = (f(change, level) for f in (F.regr_slope, F.regr_count, F.regr_sxx, F.regr_syy, F.regr_sxy))
    rss = F.greatest(syy - g * sxy, F.lit(0.0))
    tau = g / F.sqrt(F.nullif(rss / F.nullif(n - 2, F.lit(0)) / F.nullif(sxx, F.lit(0.0)), F.lit(0.0)))
    return [g.alias("gamma"), n.alias("n"), F.when(n > 2, tau).alias("tau"), F.sqrt(rss / F.nullif(n, F.lit(0))).alias("sigma")]


def half_life(gamma: str | Column = "gamma") -> Column:
    """Bars in which a deviation halves; NULL if it doesn't shrink."""
    g = F.col(gamma) if isinstance(gamma, str) else gamma
    return F.when(g < 0, F.lit(math.log(2)) / -g)


def stationary_variance(gamma: str = "gamma", sigma: str = "sigma") -> Column:
    """Variance that a mean-reverting process settles at, of its speed and the deviation of its steps; NULL if it doesn't revert."""
    return F.when(F.col(gamma) < 0, F.col(sigma) * F.col(sigma) / (-2 * F.col(gamma)))


def changes(rows: DataFrame, keys: list[str], value: str, order: str = "i", sess: str | None = "sess") -> DataFrame:
    """Adds y0 (the value before) and dy, only where both rows are of one session (or with sess=None everywhere)."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.lit(True) if sess is None else F.col(sess) == F.lag(sess).over(w)
    y0 = F.lag(value).over(w)
    return rows.withColumn("y0", F.when(same, y0)).withColumn("dy", F.when(same, F.col(value) - y0))


def lags(n: int) -> range:
    return range(2, max(20, n // 10))


def hurst(x: np.ndarray, at: range | None = None) -> float:
    """Half the slope of ln var(x[t + lag] - x[t]) on ln lag."""
    at = [k for k in (at or lags(len(x))) if k < len(x)]
    v = np.array([np.var(x[k:] - x[:-k]) for k in at])
    ok = v > 0
    if ok.sum() < 2:
        return float("nan")
    return float(np.polyfit(np.log(np.array(at)[ok]), np.log(v[ok]), 1)[0] / 2)


def hurst_by(rows: DataFrame, keys: list[str], value: str, order: str = "i", maximum: str | None = None) -> DataFrame:
    """keys and h: one vectorised pass over each series, instead of a row for each point and lag. maximum: column with a lag limit."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        at = range(2, max(3, int(pdf[maximum].iloc[0]))) if maximum else None
        h = hurst(x, at)
        return pd.DataFrame([[*pdf[keys].iloc[0], None if math.isnan(h) else h]], columns=[*keys, "h"])

    ship(rows.sparkSession)
    return rows.select(*keys, order, value, *([maximum] if maximum else [])).groupBy(*keys).applyInPandas(run, f"{kinds}, h double")


def regime(h: str = "h") -> Column:
    return F.when(F.col(h) < 0.4, "mean reverting").when(F.col(h) > 0.6, "trending").otherwise("random walk")


def normal_cdf(x: Column) -> Column:
    """The normal distribution function of a column."""

    def phi(v: pd.Series) -> pd.Series:
        cdf = NormalDist().cdf
        return v.map(lambda y: None if pd.isna(y) else cdf(y))

    return F.pandas_udf(phi, "double")(x)


def expected_max_sharpe(trials: int, deviation: float) -> float:
    """Expected largest of so many independent Sharpe ratios of mean 0."""
    if trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return deviation * ((1 - EULER_GAMMA) * inv(1 - 1 / trials) + EULER_GAMMA * inv(1 - 1 / (trials * math.e)))


def sharpe_error(sharpe: Column, n: Column, skew: float = 0.0, kurtosis: float = 3.0) -> Column:
    """Standard error of a Sharpe ratio for returns with this skewness and kurtosis."""
    return F.sqrt((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1))
