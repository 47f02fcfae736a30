"""Walk forward of the volatility book: each session's regime over the sessions before it, sizing by a forecast, one-sided machines.

The regime tests of a session look at all realised volatilities of the `lookback` sessions before. No window is unfolded: the
unit-root regression is a sum over a session's own changes, so a window is a sum over session rows; the variances behind the Hurst
exponent are kept as running sums of lagged differences and their squares for each lag, so a window is the difference of two of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions import models, stats
from barflow.operators import backtests, indicators, machine, panel, pairs
from barflow.session import ship


@dataclass(frozen=True)
class VolParams:
    """Share of sessions in sample, bars of realised volatility, sessions of a regime window, thresholds of screen and machine."""

    in_sample: float = 0.6
    window: int = 12
    lookback: int = 20
    critical: float = -2.86
    cutoff: float = 0.45
    slack: float = 0.05
    z_window: int = 60
    least: int = 10
    limit: float = 20.0
    entry: float = 1.5
    stop: float = 3.5
    leave: float = 0.5
    di: int = 14
    momentum: int = 6


def trailing_unit_root(rows: DataFrame, keys: list[str], value: str, lookback: int, order: str = "bar") -> DataFrame:
    """keys, sess, gamma, n, tau: the unit-root regression of the known values in the `lookback` sessions before each session."""
    w = Window.partitionBy(*keys)
    # values are taken from the key's mean: the slope does not change, and the sums stay small
    x = stats.changes(rows.where(F.col(value).isNotNull()).withColumn("x", F.col(value) - F.avg(value).over(w)), keys, "x", order)
    y0, dy = F.col("y0"), F.col("dy")
    terms = {"k": F.count(dy), "sx": F.sum(y0), "sd": F.sum(dy), "sxx": F.sum(y0 * y0), "sxd": F.sum(y0 * dy), "sdd": F.sum(dy * dy)}
    each = rows.select(*keys, "sess").distinct().join(x.groupBy(*keys, "sess").agg(*(v.alias(c) for c, v in terms.items())), [*keys, "sess"], "left")
    past = w.orderBy("sess").rangeBetween(-lookback, -1)
    s = each.select(*keys, "sess", *(F.coalesce(F.sum(c).over(past), F.lit(0)).cast("double").alias(c) for c in terms))
    n = F.nullif(F.col("k"), F.lit(0.0))
    sxx, sxd, sdd = F.col("sxx") - F.col("sx") ** 2 / n, F.col("sxd") - F.col("sx") * F.col("sd") / n, F.col("sdd") - F.col("sd") ** 2 / n
    gamma = sxd / F.when(sxx > 0, sxx)
    rss = F.greatest(sdd - gamma * sxd, F.lit(0.0))
    tau = gamma / F.nullif(F.sqrt(rss / F.when(F.col("k") > 2, F.col("k") - 2) / F.when(sxx > 0, sxx)), F.lit(0.0))
    return s.select(*keys, "sess", gamma.alias("gamma"), F.col("k").cast("long").alias("n"), tau.alias("tau"))


def window_hurst(x: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The Hurst exponent of x[first:stop] for many windows at once, as `stats.hurst` has it: running sums for each lag, read at two places."""
    n = stop - first
    most = np.maximum(20, n // 10)
    sums = np.zeros((5, len(n)))  # lags used, their logs, squares, logs of variances, products
    for k in range(2, min(int(most.max(initial=0)), len(x))):
        live = np.flatnonzero((n > k) & (k < most))
        if not len(live):
            continue
        d = x[k:] - x[:-k]
        total, square = (np.concatenate(([0.0], np.cumsum(v))) for v in (d, d * d))
        a, b, m = first[live], stop[live] - k, n[live] - k
        mean = (total[b] - total[a]) / m
        var = (square[b] - square[a]) / m - mean * mean
        ok = (m > 1) & (var > 1e-14 * np.maximum(square[b] - square[a], 0) / m)
        lag, v = np.log(k), np.log(np.where(ok, var, 1.0))
        for row, add in zip(sums, (1.0, lag, lag * lag, v, lag * v), strict=True):
            row[live] += np.where(ok, add, 0.0)
    c, sx, sxx, sy, sxy = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(c >= 2, (sxy - sx * sy / c) / (sxx - sx * sx / c) / 2, np.nan)


def trailing_hurst(rows: DataFrame, keys: list[str], value: str, lookback: int, order: str = "bar") -> DataFrame:
    """keys, sess, h: the Hurst exponent of the known values in the `lookback` sessions before each session; NULL where undefined."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        known = p[p[value].notna()]
        sess, at = known["sess"].to_numpy(), np.unique(p["sess"].to_numpy())
        x = known[value].to_numpy(float)
        h = window_hurst(x - x.mean() if len(x) else x, np.searchsorted(sess, at - lookback), np.searchsorted(sess, at))
        out = pd.DataFrame({"sess": at, "h": pd.array([None if np.isnan(v) else v for v in h], "Float64")})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "sess", "h"]]

    ship(rows.sparkSession)
    return rows.select(*keys, "sess", order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, sess long, h double")


def regimes(rows: DataFrame, p: VolParams, value: str = "rv") -> DataFrame:
    """symbol, sess, n, tau, h, qualified: whether volatility reverted over the sessions before; rows: symbol, bar, sess, rv."""
    found = trailing_unit_root(rows, ["symbol"], value, p.lookback).join(trailing_hurst(rows, ["symbol"], value, p.lookback), ["symbol", "sess"])
    good = (F.col("tau") < p.critical) & (F.col("h") < p.cutoff + p.slack)
    return found.withColumn("qualified", F.coalesce(good, F.lit(False)))


def side(p: VolParams) -> Column:
    """Against the stronger directional movement; before that is known, against the last moves. Of rows with plus_di, minus_di."""
    against = lambda down, up: F.when(down, 1.0).when(up, -1.0).otherwise(0.0)
    plus, minus = F.nanvl("plus_di", F.lit(None)), F.nanvl("minus_di", F.lit(None))
    back = F.ln("close") - F.ln(panel.shifted("close", p.momentum))
    return F.when(plus.isNotNull(), against(minus > plus, plus > minus)).otherwise(against(back < 0, back > 0))


def signals(bars: DataFrame, p: VolParams) -> DataFrame:
    """Indexed bars with ret, rv, z (within the session), plus_di, minus_di, side."""
    x = indicators.realized_vol(bars, p.window)
    x = pairs.session_z(x, "rv", ["symbol"], p.z_window, p.least, p.limit, "bar").withColumn("z", F.when(F.col("rv").isNull(), 0.0).otherwise(F.col("z")))
    x = x.join(indicators.dmi(bars, p.di, "warm"), ["symbol", "bar"])
    return x.withColumn("side", side(p))


def walk_forward(bars: DataFrame, p: VolParams) -> DataFrame:
    """signals() of the bars out of sample, with each session's tau, h and qualified; bars: indexed."""
    x = signals(bars, p)
    found = regimes(x, p).select("symbol", "sess", "tau", "h", "qualified")
    at = panel.split(bars, p.in_sample).select("split_session")
    return x.join(found, ["symbol", "sess"]).crossJoin(at).where("sess >= split_session").drop("split_session")  # the split is one row


def forecasts(rows: DataFrame, p: VolParams) -> DataFrame:
    """symbol, sess, omega, persistence, v1: a volatility model of the returns within the sessions before each session of rows with ret."""
    by = Window.partitionBy("symbol").orderBy("bar")
    inside = rows.withColumn("x", F.when(F.col("sess") == F.lag("sess").over(by), F.col("ret"))).where("x IS NOT NULL")
    at = rows.select("symbol", F.col("sess").alias("refit")).distinct()
    need = at.withColumn("sess", F.explode(F.sequence(F.greatest(F.col("refit") - p.lookback, F.lit(0).cast("long")), F.greatest(F.col("refit") - 1, F.lit(0).cast("long"))))).where("sess < refit")
    past = need.join(inside.select("symbol", "sess", "bar", "x"), ["symbol", "sess"])
    return models.by_key(past, ["symbol", "refit"], "x", backtests.garch_state, "omega double, persistence double, v1 double", "bar").withColumnRenamed("refit", "sess")


def machine_rule(p: VolParams) -> machine.Rule:
    return machine.Rule(entry=p.entry, stop=p.stop, leave=p.leave, two_sided=False, flat_at_end=True)


def book(bars: DataFrame, p: VolParams | None = None) -> backtests.Books:
    """The whole backtest of every symbol: the screen in sample, positions out of sample sized by each session's forecast, trades."""
    p = p or VolParams()
    indexed = panel.indexed(bars)
    at = panel.split(bars, p.in_sample).select("split_session")
    screen = pairs.vol_screen(indexed.crossJoin(at).where("sess < split_session").drop("split_session"), p.window, p.critical, p.cutoff)
    rows = walk_forward(indexed, p)
    rows = rows.join(forecasts(indicators.realized_vol(indexed, p.window), p), ["symbol", "sess"], "left")
    day = Window.partitionBy("symbol", "sess").orderBy("bar")
    rows = rows.withColumn("sigma", backtests.forecast_deviation(F.row_number().over(day) - 1)).withColumn("i", F.col("bar"))
    rows = backtests.stored(machine.vol_scale(rows, "sigma", ["symbol"]), "vol-signals")
    f = machine.positions(rows, ["symbol"], machine_rule(p))
    by = Window.partitionBy("symbol").orderBy("i")
    rows = rows.withColumn("change", F.coalesce(F.ln("close") - F.lag(F.ln("close")).over(by), F.lit(0.0)))
    done = backtests.stored(machine.profit(rows.join(f, ["symbol", "i"]), ["symbol"]), "vol-book")
    f = done.select("symbol", "i", "position", "entry", "reason")
    log = machine.trade_profit(machine.trades(f, done, ["symbol"]), done, ["symbol"])
    return backtests.Books(backtests.stored(screen, "vol-screen"), done, backtests.stored(log, "vol-trades"), ("symbol",))
