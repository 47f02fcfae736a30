"""Whole backtests in one call: screen, selection, walk forward, positions, trades, statistics, all pairs in one plan.

The stages hand tables on (kept() below spark.checkpoint.dir): the screen, the joint rows of the traded pairs, the refits and
the book are each computed once, and plans stay short however many self-joins a backtest has. A later run over the same files with
the same parameters finds them again.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions import models, stats
from barflow.operators import machine, pairs, panel, results
from barflow.session import kept, ship, stored

KEY = pairs.KEY


@dataclass(frozen=True)
class PairParams:
    """Parameters of the pair books.

    cost_bps: calibrate entry and stop of each qualified refit for this cost of a round trip, instead of `entry` and `stop`. top:
    so many of the best qualifying pairs are traded; None for all pairs, qualified or not.
    """

    in_sample: float = 0.6
    critical: float = -2.86
    cutoff: float = 0.45
    slack: float = 0.05
    lookback: int = 20
    every: int = 5
    least: int = 50
    min_window: int = 10
    max_window: int = 500
    entry: float = 1.5
    stop: float = 3.5
    cost_bps: float | None = None
    vol_window: int = 30
    top: int | None = 15
    z_window: int = 60
    beta_range: tuple[float, float] = (0.0, 3.0)


@dataclass(frozen=True)
class Books:
    """screen: all pairs, ranked. book: a row for each bar out of sample, with z, position, scale, pnl. trades: closed positions."""

    screen: DataFrame
    book: DataFrame
    trades: DataFrame
    keys: tuple[str, ...] = tuple(KEY)

    def stats(self, per_year: float) -> DataFrame:
        """keys, n, ann_return, ann_vol, sharpe, max_drawdown, n_trades, n_stops, n_breaks, disqualified (share)."""
        count = lambda why: F.sum(F.when(F.col("exit_reason") == why, 1).otherwise(0))
        keys = list(self.keys)
        t = self.trades.groupBy(*keys).agg(F.count("*").alias("n_trades"), count("hard stop").alias("n_stops"), count("regime break").alias("n_breaks"))
        out = results.performance(self.book, keys, per_year, "i").join(results.activity(self.book, keys, per_year).select(*keys, "disqualified"), keys).join(t, keys, "left")
        return out.fillna(0, ["n_trades", "n_stops", "n_breaks"])

    def costs(self, per_year: float) -> DataFrame:
        """Statistics at each cost of a switch."""
        rows = results.costed(results.position_turnover(self.book, list(self.keys)))
        return results.performance(rows, [*self.keys, "cost_bps"], per_year, "i")


def evaluate(bars: DataFrame, run: Callable[[DataFrame], Books], per_year: float) -> DataFrame:
    """One row for any engine `run`: units, share of units with a positive Sharpe ratio (per cent), and the best unit's ratio."""
    s = run(bars).stats(per_year)
    return s.agg(F.count("*").alias("units"), (F.avg(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_profitable"), F.max("sharpe").alias("best_sharpe"))


def split_of(rows: DataFrame, fraction: float) -> DataFrame:
    """rows of pairs with split: each pair's first session out of sample."""
    w = Window.partitionBy(*KEY)
    return rows.withColumn("split", F.floor((F.max("sess").over(w) + 1) * F.lit(fraction)))


def screened(bars: DataFrame, p: PairParams, per_day: float, beta_range: tuple[float, float] | None = None) -> DataFrame:
    """The screen of every pair on the panel's sessions in sample."""
    seen = panel.calendar(bars).crossJoin(panel.split(bars, p.in_sample)).where("sess < split_session").select("ts")  # the split is one row
    return kept(pairs.screen(panel.pairs(bars.join(seen, "ts", "left_semi")), p.critical, p.cutoff, per_day, beta_range), "screen", p)


def chosen(screen: DataFrame, p: PairParams, pair: tuple[str, str] | None = None) -> DataFrame | None:
    """The pairs to trade: a named one, else the best `top` of those that qualify; None for all."""
    if pair:
        return pairs.selected(screen, *pair).select(*KEY)
    if p.top is None:
        return None
    return screen.where("qualifies").orderBy("adf_stat", "pair").limit(p.top).select(*KEY)


def joint(bars: DataFrame, picks: DataFrame | None) -> DataFrame:
    return panel.pairs(bars, only=picks)


def calibrated(fits: DataFrame, cost: float, p: PairParams) -> DataFrame:
    """Adds entry_z and stop_z to refits: the thresholds that simulated paths of a qualified fit find best; NULL elsewhere."""
    ratio = p.stop / p.entry
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fits.schema) + ", entry_z double, stop_z double"

    def run(batches):
        for x in batches:
            found = [models.calibrate_entry(-g, s, cost, ratio) if ok else None for g, s, ok in zip(x["gamma"], x["sigma"], x["qualified"], strict=True)]
            z = np.array([f[0] if f else np.nan for f in found], float)
            yield x.assign(entry_z=z, stop_z=z * ratio)

    ship(fits.sparkSession)
    # a refit is half a second of simulation: dealt one by one
    out = fits.repartition(*KEY, "refit").mapInPandas(run, kinds)
    return out.select(*fits.columns, *(F.nanvl(c, F.lit(None)).alias(c) for c in ("entry_z", "stop_z")))


def mean_reversion(bars: DataFrame, p: PairParams | None = None, per_day: float = 24.0, pair: tuple[str, str] | None = None) -> Books:
    """Hedge ratio, regime and window refitted every few sessions; positions sized by the deviation of recent changes."""
    p = p or PairParams()
    screen = screened(bars, p, per_day)
    rows = kept(split_of(joint(bars, chosen(screen, p, pair)), p.in_sample), "rows", p)
    fits = pairs.walk_forward(rows, p.lookback, p.every, "split", p.critical, p.cutoff + p.slack, p.least, p.min_window, p.max_window)
    names = ("alpha", "beta", "zw", "half_life", "qualified")
    if p.cost_bps is not None:
        fits, names = calibrated(fits, p.cost_bps / 1e4, p), (*names, "entry_z", "stop_z")
    rows = pairs.held(rows.withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb")), kept(fits, "refits", p), names)
    # windows reach back into the sample; positions begin at the split
    rows = pairs.variable_z(rows, least=p.min_window).where("sess >= split").withColumn("qualified", F.coalesce("qualified", F.lit(False)))
    rows = rows.withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))
    sized = machine.vol_scale(machine.spread_vol(rows, "spread", KEY, p.vol_window), "sigma", KEY)
    return _books(screen, sized, machine.Rule(entry=p.entry, stop=p.stop), p)


def _books(screen: DataFrame, rows: DataFrame, rule: machine.Rule, params: object) -> Books:
    of = (rule, params)
    rows = kept(rows, "signals", of)
    f = machine.positions(rows, KEY, rule)
    book = kept(machine.profit(rows.join(f, [*KEY, "i"]), KEY), "book", of)
    f = book.select(*KEY, "i", "position", "entry", "reason")
    log = machine.trade_prices(machine.trade_profit(machine.trades(f, book, KEY), book, KEY), book)
    return Books(screen, book, kept(log, "trades", of))


# --- volatility forecasts by refit -----------------------------------------------------------------------------------------

_GARCH = "omega double, persistence double, v1 double"


def garch_state(x: np.ndarray, least: int = 30) -> tuple[float, float, float] | None:
    """omega, alpha + beta and the next variance of a model without constant; None for too few changes or none that differ."""
    if len(x) < least or not x.std() > 0:
        return None
    m = models.fit_garch(x, constant=False)
    return m["omega"], m["alpha"] + m["beta"], float(models.forecast(x, m, 1)[0])


def forecast_deviation(ahead: Column) -> Column:
    """The deviation `ahead` bars (0: the next) after a fit with omega, persistence and v1: the recursion in closed form."""
    level = F.col("omega") / (1 - F.col("persistence"))
    return F.sqrt(level + F.pow(F.col("persistence"), ahead) * (F.col("v1") - level))


def intraday(bars: DataFrame, p: PairParams | None = None, per_day: float = 24.0, pair: tuple[str, str] | None = None) -> Books:
    """Refitted every session; z within the session; flat at its end; sized by a volatility forecast of each refit.

    The forecast is a model of the changes within the refit's sessions under the refit's own hedge ratio, one group for each
    (pair, refit); a bar's deviation is its closed form at the bar's place in the session.
    """
    p = p or PairParams(lookback=5, every=1)
    screen = screened(bars, p, per_day, p.beta_range)
    rows = kept(split_of(joint(bars, chosen(screen, p, pair)), p.in_sample), "rows", p)
    key = [*KEY, "refit"]
    fits = pairs.walk_forward(rows, p.lookback, p.every, "split", p.critical, p.cutoff + p.slack, p.least)
    sane = (F.col("beta") > p.beta_range[0]) & (F.col("beta") < p.beta_range[1])
    past = stats.changes(pairs.windows(rows, p.lookback, p.every, "split", p.least), key, "spread").where("dy IS NOT NULL")
    vol = models.by_key(past, key, "dy", garch_state, _GARCH)
    fits = fits.withColumn("qualified", F.col("qualified") & sane).join(vol, key, "left")
    rows = pairs.held(rows.withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb")), kept(fits, "refits", p), ("alpha", "beta", "qualified", "omega", "persistence", "v1"))
    rows = rows.where("sess >= split").withColumn("qualified", F.coalesce("qualified", F.lit(False))).withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))
    rows = pairs.session_z(rows, "spread", KEY, p.z_window, p.min_window)
    by, day = Window.partitionBy(*KEY).orderBy("i"), Window.partitionBy(*KEY, "sess").orderBy("i")
    rows = rows.withColumn("sigma", forecast_deviation(F.row_number().over(day) - 1)).withColumn("is_last", F.coalesce(F.lead("sess").over(by) != F.col("sess"), F.lit(True)))
    rows = rows.withColumn("change", F.coalesce(F.col("spread") - F.lag("spread").over(by), F.lit(0.0)))
    return _books(screen, machine.vol_scale(rows, "sigma", KEY), machine.Rule(entry=p.entry, stop=p.stop, flat_at_end=True), p)


@dataclass(frozen=True)
class DailyParams:
    """Parameters of the daily books: rows of a window, rows between two checks, thresholds of the screen and of the checks."""

    in_sample: float = 0.6
    lookback: int = 252
    every: int = 21
    screen_p: float = 0.05
    screen_cutoff: float = 0.45
    check_p: float = 0.10
    cutoff: float = 0.5
    entry: float = 1.5
    stop: float = 3.5
    top: int | None = 15


def screen_by_p(rows: DataFrame, p: DailyParams) -> DataFrame:
    """pair, a, b, beta, adf_stat, adf_p, h, qualifies: the lagged unit-root test by p-value; rows: pairs in sample."""
    s = pairs.spreads(rows)

    def test(x: np.ndarray) -> tuple[float, float, float]:
        _, _, tau, prob = models.lagged_unit_root(x)
        return tau, prob, stats.hurst(x)

    found = models.by_key(s, KEY, "spread", test, "adf_stat double, adf_p double, h double").join(s.groupBy(*KEY).agg(F.first("beta").alias("beta")), KEY)
    clean = [F.nanvl(c, F.lit(None)).alias(c) for c in ("adf_stat", "adf_p", "h")]
    good = (F.col("adf_p") < p.screen_p) & (F.col("h") < p.screen_cutoff)
    out = found.select(F.concat_ws("/", *KEY).alias("pair"), *KEY, "beta", *clean)
    return out.withColumn("qualifies", F.coalesce(good, F.lit(False))).orderBy(F.asc_nulls_last("adf_p"), "adf_stat", "pair")


def daily(bars: DataFrame, p: DailyParams | None = None, pair: tuple[str, str] | None = None) -> Books:
    """Hedge ratio of each day; regime and volatility model checked again every `every` rows on the window of that day.

    A check's window is unfolded to its row numbers, so the join is by equality and every (pair, check) is one bounded group.
    """
    p = p or DailyParams()
    rows = kept(panel.pairs(bars), "rows", p)
    w = Window.partitionBy(*KEY)
    rows = rows.withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb")).withColumn("split", F.greatest(F.floor((F.max("i").over(w) + 1) * F.lit(p.in_sample)), F.lit(p.lookback)))
    screen = kept(screen_by_p(rows.where("i < split").drop("la", "lb", "split"), p), "screen", p)
    if pair:
        rows = rows.join(pairs.selected(screen, *pair).select(*KEY), KEY, "left_semi")
    elif p.top is not None:
        rows = rows.join(screen.where("qualifies").orderBy("adf_p", "adf_stat", "pair").limit(p.top).select(*KEY), KEY, "left_semi")
    z = pairs.ols_z(rows, p.lookback).where("i >= split").withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))
    since = F.col("i") - F.col("split")
    z = kept(z.withColumn("ahead", since % p.every).withColumn("check", F.col("i") - F.col("ahead")), "daily", p)
    at = z.where("ahead = 0").select(*KEY, "check", "alpha", "beta").withColumn("i", F.explode(F.sequence(F.col("check") - p.lookback, F.col("check") - 1)))
    win = at.join(rows.select(*KEY, "i", "la", "lb"), [*KEY, "i"]).withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))

    def check(x: np.ndarray) -> tuple:
        return models.lagged_unit_root(x)[3], stats.hurst(x), *(garch_state(np.diff(x)) or (math.nan,) * 3)

    names = ["adf_p", "h", "omega", "persistence", "v1"]
    found = models.by_key(win, [*KEY, "check"], "spread", check, ", ".join(f"{c} double" for c in names)).select(*KEY, "check", *(F.nanvl(c, F.lit(None)).alias(c) for c in names))
    z = z.join(found, [*KEY, "check"], "left").withColumn("qualified", F.coalesce((F.col("adf_p") < p.check_p) & (F.col("h") < p.cutoff), F.lit(False)))
    z = z.withColumn("sigma", forecast_deviation(F.col("ahead"))).withColumn("change", F.coalesce(F.col("spread") - F.lag("spread").over(w.orderBy("i")), F.lit(0.0)))
    return _books(screen, machine.vol_scale(z, "sigma", KEY), machine.Rule(entry=p.entry, stop=p.stop), p)


def same_winner(one: DataFrame, two: DataFrame) -> DataFrame:
    """The best pair of screen `one` looked up in screen `two` in either order: pair, other (best of two), stat, qualifies, same."""
    best = one.orderBy(F.asc_nulls_last("adf_stat"), "pair").limit(1).select(F.col("pair").alias("best"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    other = two.orderBy(F.asc_nulls_last("adf_stat"), "pair").limit(1).select(F.col("pair").alias("other"), F.least("a", "b").alias("ox"), F.greatest("a", "b").alias("oy"))
    there = two.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "adf_stat", "qualifies")
    out = best.join(there, ["x", "y"], "left").crossJoin(other)  # other is one row
    return out.select(F.col("best").alias("pair"), "other", "adf_stat", "qualifies", ((F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy"))).alias("same"))


def basket(rows: DataFrame, symbols: DataFrame, rule: machine.Rule, scale_max: float = 3.0) -> Books:
    """The machines of the given symbols at once, the capital split evenly; pnl is a share of the whole capital.

    rows: symbol, bar, ts, close, z and what positions() reads; symbols: one row for each.
    """
    rows = rows.join(symbols.select("symbol"), "symbol", "left_semi").withColumn("i", F.col("bar"))
    rows, symbols = stored(rows, "signals"), stored(symbols, "symbols")
    f = machine.positions(rows, ["symbol"], rule)
    w = Window.partitionBy("symbol").orderBy("i")
    rows = rows.withColumn("change", F.coalesce(F.ln("close") - F.lag(F.ln("close")).over(w), F.lit(0.0)))
    rows = rows if "scale" in rows.columns else rows.withColumn("scale", F.lit(1.0))
    count = symbols.select(F.countDistinct("symbol").alias("k"))
    book = machine.profit(rows.join(f, ["symbol", "i"]), ["symbol"]).crossJoin(count)  # count is one row
    book = book.withColumn("pnl", F.col("pnl") / F.col("k") / F.lit(scale_max))
    book = book if "qualified" in book.columns else book.withColumn("qualified", F.lit(True))
    book = stored(book, "book")
    f = book.select("symbol", "i", "position", "entry", "reason")
    return Books(symbols, book, machine.trade_profit(machine.trades(f, book, ["symbol"]), book, ["symbol"]), ("symbol",))


def basket_costs(b: Books, per_year: float, scale_max: float = 3.0) -> DataFrame:
    """Statistics of the basket's summed profit at each cost, charged on every symbol's own turnover."""
    rows = results.position_turnover(b.book, list(b.keys)).withColumn("turnover", F.col("turnover") / F.col("k") / F.lit(scale_max))
    total = results.costed(rows).groupBy("cost_bps", "i").agg(F.sum("pnl").alias("pnl"))
    return results.performance(total, ["cost_bps"], per_year, "i")
