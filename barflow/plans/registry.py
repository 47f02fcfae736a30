"""Registered queries: each operator on panels derived from the driver's tables. Results are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions import models, stats
from barflow.operators import indicators as ind
from barflow.operators import backtests, factors, machine, pairs, panel, resampling, results, rotation, sizing, tiles, volatility
from barflow.plans.oracle import ORACLE  # noqa: F401
from barflow.sources.bars import by_user, complete, daily, hourly, table, walks
from barflow.session import scratch, stored
from barflow.streaming import keyed
from barflow.streaming.bars import Rotator, bar_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PAIR = ["a", "b"]
#: Clock of the rotation queries: lookback, fast and slow mean, bars between rebalances, names held, in-sample share.
LOOKBACK, FAST, SLOW, EVERY, TOP, FRACTION = 20, 10, 30, 24, 2, 0.6
PER_YEAR = 24.0 * 252


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r(c: str | Column, name: str | None = None) -> Column:
    """Rounded to 6 places, without a negative zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c) if isinstance(c, str) or name else out


def n(c: str | Column, name: str | None = None) -> Column:
    out = (F.col(c) if isinstance(c, str) else c).cast("long")
    return out.alias(name or c) if isinstance(c, str) or name else out


def bars(spark: SparkSession, d: str) -> DataFrame:
    return panel.indexed(hourly(spark, d))


def joint(spark: SparkSession, d: str, least: int = 200) -> DataFrame:
    return panel.pairs(hourly(spark, d), least)


# --- panel ---------------------------------------------------------------------------------------------------------------


@query
def panel_hourly_bars(spark, d):
    return hourly(spark, d).select("symbol", "ts", r("open"), r("high"), r("low"), r("close"), n("volume"))


@query
def panel_daily_complete(spark, d):
    return complete(daily(spark, d)).select("symbol", "ts", r("close"))


@query
def panel_profile(spark, d):
    return panel.profile(hourly(spark, d)).select("symbol", n("n_bars"), "first_ts", "last_ts")


@query
def session_ids(spark, d):
    return panel.calendar(hourly(spark, d)).select("ts", n("bar"), n("sess"))


@query
def session_flags(spark, d):
    return panel.calendar(hourly(spark, d)).select("ts", n("pos"), "is_first", "is_last")


@query
def bars_per_year(spark, d):
    return panel.bars_per_year(hourly(spark, d)).select(n("n_bars"), n("n_days"), r("bars_per_year"))


@query
def split_by_session(spark, d):
    return panel.split(hourly(spark, d), FRACTION).select(n("n_sessions"), n("split_session"), n("split_bar"))


# --- indicators ------------------------------------------------------------------------------------------------------------


@query
def log_returns(spark, d):
    return bars(spark, d).select("symbol", n("bar"), r(ind.log_return(), "ret"))


@query
def roc(spark, d):
    return bars(spark, d).select("symbol", n("bar"), r(ind.roc("close", LOOKBACK), "roc"))


@query
def sma(spark, d):
    return bars(spark, d).select("symbol", n("bar"), r(ind.sma("close", 10), "sma"))


@query
def bollinger(spark, d):
    return bars(spark, d).select("symbol", n("bar"), *ind.bollinger("close", 20, 2.0)).select("symbol", "bar", r("mid"), r("upper"), r("lower"))


@query
def realized_vol(spark, d):
    return ind.realized_vol(bars(spark, d), 12).select("symbol", n("bar"), r("rv"))


@query
def volume_flag(spark, d):
    return bars(spark, d).select("symbol", n("bar"), ind.volume_up().alias("up"))


@query
def trend_filter(spark, d):
    return bars(spark, d).select("symbol", n("bar"), ind.trend("close", FAST, SLOW).alias("ok"))


@query
def ema(spark, d):
    return ind.ema(bars(spark, d), 12).select("symbol", n("bar"), r("ema"))


@query
def macd(spark, d):
    return ind.macd(bars(spark, d), 12, 26, 9).select("symbol", n("bar"), r("macd"), r("signal"), r("hist"))


@query
def rsi(spark, d):
    return ind.rsi(bars(spark, d), 14).select("symbol", n("bar"), r("rsi"))


def _dmi(spark, d, style, names):
    return ind.dmi(bars(spark, d), 14, style).select("symbol", n("bar"), *(r(c) for c in names))


@query
def dmi_dashboard(spark, d):
    return _dmi(spark, d, "chart", ["plus_di", "minus_di", "adx"])


@query
def dmi_panel(spark, d):
    return _dmi(spark, d, "panel", ["plus_di", "minus_di", "adx"])


@query
def dmi_intraday(spark, d):
    return _dmi(spark, d, "warm", ["plus_di", "minus_di"])


#: Bars of a block in the queries that scan: a symbol's month is some thirty tasks.
BARS = 24


@query
def macd_scan(spark, d):
    """The same as macd, each symbol in blocks of a day."""
    return ind.macd(bars(spark, d), 12, 26, 9, BARS).select("symbol", n("bar"), r("macd"), r("signal"), r("hist"))


@query
def rsi_scan(spark, d):
    return ind.rsi(bars(spark, d), 14, BARS).select("symbol", n("bar"), r("rsi"))


@query
def dmi_scan(spark, d):
    """The same as dmi_panel, absent bars included."""
    return ind.dmi(bars(spark, d), 14, "panel", BARS).select("symbol", n("bar"), r("plus_di"), r("minus_di"), r("adx"))


@query
def topn_rank(spark, d):
    s = rotation.signals(bars(spark, d), LOOKBACK, FAST, SLOW).where("ok AND roc IS NOT NULL")
    best = F.row_number().over(Window.partitionBy("bar").orderBy(F.desc("roc"), "symbol"))
    return s.withColumn("rank", best).where("rank <= 2").select(n("bar"), "symbol", n("rank"), r("roc"))


@query
def stream_rotation(spark, d):
    """Three portfolios' rotations over the event stream, bars of six hours: orders of the bars that the watermark has closed."""
    own = spark.newSession()  # the state store is set for this stream alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = table(own, d, "events")
    ticks = own.readStream.schema(events.schema).parquet(f"{d}/event[s].parquet")  # a pattern: the table may be a file or a folder
    ticks = ticks.withColumn("portfolio", F.concat(F.lit("p"), F.pmod("user_id", F.lit(3)))).withColumn("ts", F.col("ts").cast("timestamp"))
    orders, path = keyed.rotate(ticks, Rotator(5, 3, 6, 4, 2, 100_000.0), symbol="event_type", width="6 hours"), scratch(spark, "stream")
    run = orders.writeStream.format("parquet").outputMode("append").option("path", f"{path}/orders").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(keyed.ORDERS).parquet(f"{path}/orders")


@query
def bollinger_rsi_cross(spark, d):
    """Crossing signals: RSI up through 30 under the lower band buys, down through 70 over the upper band sells."""
    return ind.band_cross(bars(spark, d)).select("symbol", n("bar"), "side")


@query
def bollinger_rsi_cross_fast(spark, d):
    """The same with an RSI of 3 bars and bands of one deviation, which such noisy bars do cross."""
    return ind.band_cross(bars(spark, d), w=3, k=1.0).select("symbol", n("bar"), "side")


# --- statistics ------------------------------------------------------------------------------------------------------------


@query
def hedge_ratio(spark, d):
    s = pairs.spreads(joint(spark, d, 0)).groupBy(*PAIR)
    return s.agg(F.count("*").alias("n"), F.first("alpha").alias("alpha"), F.first("beta").alias("beta")).select(*PAIR, n("n"), r("alpha"), r("beta"))


@query
def adf_screen(spark, d):
    s = stats.changes(pairs.spreads(joint(spark, d)), PAIR, "spread").groupBy(*PAIR).agg(*stats.unit_root())
    return s.select(*PAIR, n("n"), r("gamma"), r("tau"))


@query
def ou_half_life(spark, d):
    s = stats.changes(pairs.spreads(joint(spark, d)), PAIR, "spread").groupBy(*PAIR).agg(*stats.unit_root())
    return s.select(*PAIR, r(stats.half_life(), "half_life"))


@query
def ou_sigma(spark, d):
    s = stats.changes(pairs.spreads(joint(spark, d)), PAIR, "spread").groupBy(*PAIR).agg(*stats.unit_root())
    return s.select(*PAIR, r("sigma"))


@query
def hurst_levels(spark, d):
    return stats.hurst_by(pairs.spreads(joint(spark, d)), PAIR, "spread").select(*PAIR, r("h"))


@query
def hurst_log(spark, d):
    x = bars(spark, d).withColumn("x", F.ln("close")).withColumnRenamed("bar", "i")
    return stats.hurst_by(x, ["symbol"], "x").select("symbol", r("h"), stats.regime().alias("regime"))


@query
def hurst_lag_sensitivity(spark, d):
    x = bars(spark, d).withColumn("x", F.ln("close")).withColumnRenamed("bar", "i")
    size = x.groupBy("symbol").agg(F.count("*").alias("size"))
    share = F.explode(F.array(*(F.lit(k) for k in (2, 5, 10, 20, 30, 40)))).alias("pct")
    limits = size.select("symbol", "size", share).withColumn("m", F.greatest(F.floor(F.col("size") * F.col("pct") / 100), F.lit(4)))
    return stats.hurst_by(x.join(limits, "symbol"), ["symbol", "pct"], "x", maximum="m").select("symbol", n("pct"), r("h"))


def screened(spark: SparkSession, d: str, least: int = 200) -> DataFrame:
    """The ranked screen of all pairs with enough joint bars."""
    return pairs.screen(joint(spark, d, least), bars_per_day=24.0).select("pair", r("beta"), r("adf_stat"), r("h"), r("half_life_bars"), r("half_life_days"), n("n_bars"), "qualifies")


@query
def pair_screen_full(spark, d):
    return screened(spark, d)


@query
def pair_screen_tiles(spark, d):
    """The same screen from tiles of symbols, without joint rows."""
    s = tiles.screen(hourly(spark, d), 200, bars_per_day=24.0)
    return s.select("pair", r("beta"), r("adf_stat"), r("h"), r("half_life_bars"), r("half_life_days"), n("n_bars"), "qualifies")


@query
def pair_screen_wide(spark, d):
    """Every two users with 12 joint bars of six hours: a panel of thousands of symbols, full of gaps. In no order: millions of pairs."""
    short = lambda c: F.rint(F.col(c) * 1e4) / 1e4 + F.lit(0.0)  # noqa: E731  F.round makes a decimal of every number
    return tiles.screen(by_user(spark, d), 12, ordered=False).select("pair", short("beta").alias("beta"), short("adf_stat").alias("adf_stat"), short("h").alias("h"), n("n_bars"), "qualifies")


@query
def pair_screen_intraday(spark, d):
    """In-sample sessions only, with sane hedge ratios."""
    hours = hourly(spark, d)
    seen = panel.calendar(hours).crossJoin(panel.split(hours, FRACTION)).where("sess < split_session").select("ts")  # the split is one row
    s = joint(spark, d).join(seen, "ts", "left_semi")
    return pairs.screen(s, beta_range=(0.0, 3.0)).select("pair", r("beta"), r("adf_stat"), r("h"), "qualifies")


@query
def selected_pair(spark, d):
    return pairs.selected(pairs.screen(joint(spark, d))).select("pair", r("adf_stat"), "qualifies")


@query
def vol_screen(spark, d):
    return pairs.vol_screen(bars(spark, d)).select("symbol", r("adf_stat"), r("h"), "qualifies")


@query
def rolling_ols_z(spark, d):
    s = joint(spark, d).withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb"))
    return pairs.ols_z(s, 60).select(*PAIR, n("i"), r("beta"), r("z"))


@query
def rolling_z(spark, d):
    return pairs.rolling_z(pairs.spreads(joint(spark, d)), "spread", PAIR, 60).select(*PAIR, n("i"), r("z"))


@query
def session_z(spark, d):
    return pairs.session_z(pairs.spreads(joint(spark, d)), "spread", PAIR).select(*PAIR, n("i"), r("z"))


@query
def variable_window_z(spark, d):
    s = pairs.spreads(joint(spark, d)).withColumn("zw", (10 + (F.floor(F.col("i") / 50) % 5) * 20).cast("long"))
    return pairs.variable_z(s).select(*PAIR, n("i"), n("zw"), r("z"))


@query
def rv_z(spark, d):
    x = ind.realized_vol(bars(spark, d), 12)
    return pairs.session_z(x, "rv", ["symbol"], 60, 10, 20.0, "bar").withColumn("z", F.when(F.col("rv").isNull(), 0.0).otherwise(F.col("z"))).select("symbol", n("bar"), r("z"))


@query
def walk_forward_refits(spark, d):
    out = pairs.walk_forward(joint(spark, d), lookback=5, every=5, start=5)
    return out.select(*PAIR, n("refit"), n("n"), r("beta"), r("adf_stat"), r("h"), n("zw"), "qualified")


# --- machines --------------------------------------------------------------------------------------------------------------


def _spread_rows(spark, d):
    rows = pairs.rolling_z(pairs.spreads(joint(spark, d)), "spread", PAIR, 60)
    return rows.withColumn("qualified", (F.col("sess") % 7) != 6)


def _folded(spark, d):
    # read by positions, trades, prices and profit: kept once computed
    rows = _spread_rows(spark, d).persist()
    return rows, machine.positions(rows, PAIR, machine.Rule()).persist()


@query
def state_machine_spread(spark, d):
    _, f = _folded(spark, d)
    return f.select(*PAIR, n("i"), r("position"), n("entry"), "reason")


@query
def state_machine_scan(spark, d):
    """The same as state_machine_spread, each pair in blocks of 50 rows."""
    f = machine.positions(_spread_rows(spark, d), PAIR, machine.Rule(), block=50)
    return f.select(*PAIR, n("i"), r("position"), n("entry"), "reason")


@query
def state_machine_intraday(spark, d):
    rows = pairs.session_z(pairs.spreads(joint(spark, d)), "spread", PAIR)
    last = F.lead("sess").over(Window.partitionBy(*PAIR).orderBy("i"))
    rows = rows.withColumn("is_last", F.coalesce(last != F.col("sess"), F.lit(True)))
    f = machine.positions(rows, PAIR, machine.Rule(flat_at_end=True))
    return f.select(*PAIR, n("i"), r("position"), n("entry"), "reason")


def _vol_rows(spark, d):
    return volatility.signals(bars(spark, d), volatility.VolParams())


@query
def state_machine_vol(spark, d):
    f = machine.positions(_vol_rows(spark, d), ["symbol"], machine.Rule(entry=1.5, stop=3.5, leave=0.5, two_sided=False, flat_at_end=True), "bar")
    return f.select("symbol", n("bar"), r("position"), n("entry"), "reason")


@query
def vol_target_scale(spark, d):
    s = machine.vol_scale(machine.spread_vol(_spread_rows(spark, d), "spread", PAIR), "sigma", PAIR)
    return s.select(*PAIR, n("i"), r("sigma"), r("scale"))


def _book(spark, d):
    rows, f = _folded(spark, d)
    s = machine.vol_scale(machine.spread_vol(rows, "spread", PAIR), "sigma", PAIR)
    return machine.profit(s.join(f, [*PAIR, "i"]), PAIR), f


@query
def spread_pnl(spark, d):
    return _book(spark, d)[0].select(*PAIR, n("i"), r("pnl"))


def _log(spark, d):
    book, f = _book(spark, d)
    return machine.trade_prices(machine.trade_profit(machine.trades(f, book, PAIR), book, PAIR), book), book


@query
def trade_log(spark, d):
    log, _ = _log(spark, d)
    return log.select(*PAIR, "entry_ts", "exit_ts", "direction", machine.labelled().alias("label"), r("entry_z"), r("exit_z"), n("hold_bars"), "exit_reason")


@query
def trade_pnl(spark, d):
    log, _ = _log(spark, d)
    return log.select(*PAIR, n("entry"), n("exit"), r("pnl"))


@query
def trade_prices(spark, d):
    log, _ = _log(spark, d)
    return log.select(*PAIR, n("entry"), n("exit"), r("entry_price_a"), r("entry_price_b"), r("exit_price_a"), r("exit_price_b"))


@query
def legs(spark, d):
    log, book = _log(spark, d)
    log = log.join(book.select(*PAIR, F.col("i").alias("entry"), "beta"), [*PAIR, "entry"])
    return machine.legs(log, 10_000.0).select(*PAIR, n("entry"), "leg", "symbol", "side", r("move_pct"), r("amount"), n("shares"))


@query
def exit_reason_counts(spark, d):
    log, _ = _log(spark, d)
    return results.reasons(log, PAIR).select(*PAIR, "exit_reason", n("n"))


@query
def beta_stability(spark, d):
    """The hedge ratio in force at the start of each session, refitted every session: range, sample deviation, and whether it is unstable."""
    rows = joint(spark, d)
    held = pairs.held(rows, pairs.walk_forward(rows, lookback=5, every=1, start=5)).where("beta IS NOT NULL")
    fit = held.groupBy(*PAIR, "sess").agg(F.min_by("beta", "i").alias("beta"))
    return fit.groupBy(*PAIR).agg(F.min("beta").alias("lo"), F.max("beta").alias("hi"), F.stddev_samp("beta").alias("dev")).select(
        *PAIR, r("lo"), r("hi"), r("dev"), ((F.col("hi") - F.col("lo") > 0.5) | (F.signum("lo") != F.signum("hi"))).alias("unstable")
    )


# --- rotation --------------------------------------------------------------------------------------------------------------


class Rotation:
    """The rotation of one panel, with its calendar's size and split taken first (two small aggregates)."""

    def __init__(self, spark, d, lookback=LOOKBACK, every=EVERY, top=TOP, phases=1, start=None, score=None, mask=None, extra=None, raw=None):
        raw = hourly(spark, d) if raw is None else raw
        self.clock = panel.calendar(raw)
        self.bars = (self.clock.agg(F.max("bar")).first()[0] or -1) + 1
        found = panel.split(raw, FRACTION).first()
        self.start = start if start is not None else found["split_bar"] if found else 0  # a panel without bars has no split
        self.every, self.top, self.phases = every, top, phases
        rows = raw.join(self.clock, "ts")
        self.signal = rotation.signals(rows, lookback, FAST, SLOW)
        if extra:
            self.signal = extra(rows, self.signal)
        self.signal = self.signal.persist()
        self.held = rotation.baskets(self.signal, F.col("roc") if score is None else score, F.col("ok") if mask is None else mask, self.start, every, top, self.bars, phases)
        self.parts = rotation.contributions(self.held, self.signal, every, self.bars)

    def pnl(self):
        return rotation.profit(self.parts, self.clock, self.start, self.phases)

    def turnover(self):
        return rotation.turnover(self.held, self.every, self.top, self.bars)

    def trades(self):
        return rotation.trades(self.held, self.parts, self.every, self.bars)


@query
def momentum_baskets(spark, d):
    return Rotation(spark, d).held.select(n("t0"), "symbol", n("rank"), r("weight"))


@query
def momentum_pnl(spark, d):
    return Rotation(spark, d).pnl().select(n("bar"), r("pnl"), n("n_held"))


@query
def momentum_turnover(spark, d):
    return Rotation(spark, d).turnover().select(n("bar"), n("dropped"), n("added"), r("turnover"))


@query
def momentum_trades(spark, d):
    return Rotation(spark, d).trades().select("symbol", n("entry"), n("exit"), n("hold_bars"), "exit_reason", r("pnl"))


@query
def per_ticker_summary(spark, d):
    return results.by_symbol(Rotation(spark, d).trades()).select("symbol", n("n_trades"), r("mean_pnl"), r("pnl"), r("win_rate"), r("mean_hold"))


@query
def buy_and_hold(spark, d):
    x = Rotation(spark, d)
    return rotation.buy_and_hold(x.signal, x.start).select(n("bar"), r("pnl"))


@query
def phase_sweep(spark, d):
    x = Rotation(spark, d, phases=EVERY)
    return results.performance(x.pnl(), ["phase"], PER_YEAR).select(n("phase"), n("n"), r("ann_return"), r("ann_vol"), r("sharpe"), r("max_drawdown"))


@query
def tranche(spark, d):
    """Mean over all phases, from the bar on at which all have begun."""
    x = Rotation(spark, d, phases=EVERY)
    return x.pnl().where(F.col("bar") >= x.start + EVERY).groupBy("bar").agg(F.avg("pnl").alias("pnl")).select(n("bar"), r("pnl"))


@query
def equity_curve(spark, d):
    return results.equity(Rotation(spark, d).pnl(), ["phase"], 100_000.0, 100_000.0).select(n("bar"), r("equity"))


@query
def performance_stats(spark, d):
    return results.performance(Rotation(spark, d).pnl(), ["phase"], PER_YEAR).select(n("n"), r("ann_return"), r("ann_vol"), r("sharpe"), r("max_drawdown"))


@query
def drawdown(spark, d):
    a = results.drawdown(Rotation(spark, d).pnl(), ["phase"])
    b = results.drawdown(Rotation(spark, d).pnl(), ["phase"], from_zero=True).select("bar", F.col("drawdown").alias("drawdown0"))
    return a.join(b, "bar").select(n("bar"), r("cum"), r("drawdown"), r("drawdown0"))


@query
def cost_sensitivity_basket(spark, d):
    x = Rotation(spark, d)
    rows = x.pnl().join(x.turnover().select("phase", "bar", "turnover"), ["phase", "bar"], "left")
    return results.performance(results.costed(rows), ["cost_bps"], PER_YEAR).select(n("cost_bps"), r("ann_return"), r("sharpe"))


@query
def cost_sensitivity(spark, d):
    rows = results.costed(results.position_turnover(_book(spark, d)[0], PAIR))
    return results.performance(rows, [*PAIR, "cost_bps"], PER_YEAR, "i").select(*PAIR, n("cost_bps"), r("ann_return"), r("sharpe"))


@query
def breakeven_cost(spark, d):
    x = Rotation(spark, d)
    rows = x.pnl().join(x.turnover().select("phase", "bar", "turnover"), ["phase", "bar"], "left")
    return results.breakeven(results.performance(results.costed(rows), ["phase", "cost_bps"], PER_YEAR), ["phase"]).select(n("breakeven_bps"))


def _features(rows, signal):
    di = ind.dmi(rows, 14, "panel")
    vol = ind.realized_vol(rows, 12).select("symbol", "bar", F.col("rv").alias("vol"))
    out = signal.join(vol, ["symbol", "bar"]).join(di, ["symbol", "bar"])
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("plus_di", "minus_di", "adx")]
    return out.select("symbol", "bar", "ret", "roc", "ok", "vol", *clean, F.lit(0.5).alias("hurst"))


@query
def momentum_variants(spark, d):
    """Baskets of every selection rule on one clock, in one plan."""
    x = Rotation(spark, d, extra=_features)
    rules = {k: v for k, v in rotation.variants().items() if "hurst" not in k}
    return rotation.variant_baskets(x.signal, rules, x.start, EVERY, TOP, x.bars).select("variant", n("t0"), "symbol", n("rank"))


def _sweep(x, starts):
    """Statistics of the rotation from each start on, in one plan: the start takes the place of the phase."""
    held = rotation.start_baskets(x.signal, F.col("roc"), F.col("ok"), starts, x.every, x.top, x.bars)
    parts = rotation.contributions(held, x.signal, x.every, x.bars)
    pnl = rotation.start_profit(parts, x.clock, starts)
    return results.performance(pnl, ["phase"], PER_YEAR).select(n("phase", "start"), n("n"), r("ann_return"), r("sharpe"))


@query
def start_date_sweep(spark, d):
    """Four fixed starts, those of the SQL."""
    return _sweep(Rotation(spark, d), [60, 150, 240, 330])


@query
def start_date_sweep_full(spark, d):
    """Starts over the whole panel, as many as its bars allow."""
    x = Rotation(spark, d)
    return _sweep(x, rotation.sweep_starts(x.bars, LOOKBACK))


def _grid(spark, d, lookbacks, tops, phases):
    """Profit of all cells and phases in one plan, and the first bar of the clock."""
    def scores(rows, signal):
        return rows.select("symbol", "bar", ind.log_return().alias("ret"), ind.trend("close", FAST, SLOW).alias("ok"), *(ind.roc("close", k).alias(f"roc{k}") for k in lookbacks))

    x = Rotation(spark, d, extra=scores, score=F.lit(0.0))
    held = rotation.grid_baskets(x.signal, {k: F.col(f"roc{k}") for k in lookbacks}, F.col("ok"), tops, x.start, EVERY, x.bars, phases)
    return rotation.grid_profit(held, x.signal, x.clock, lookbacks, tops, x.start, EVERY, x.bars, phases), x.start


@query
def parameter_grid(spark, d):
    pnl, _ = _grid(spark, d, [10, 20, 40], (1, 2), 1)
    return results.performance(pnl, ["lookback", "top"], PER_YEAR).select("lookback", "top", r("ann_return"), r("sharpe"))


@query
def lookback_top_grid(spark, d):
    """Fifteen cells of lookback and names held, each over all phases: statistics of the mean over the phases, from the bar on at which all have begun."""
    pnl, start = _grid(spark, d, [10, 15, 20, 30, 40], (1, 2, 3), EVERY)
    mean = pnl.where(F.col("bar") >= start + EVERY).groupBy("lookback", "top", "bar").agg(F.avg("pnl").alias("pnl"))
    return results.performance(mean, ["lookback", "top"], PER_YEAR).select("lookback", "top", r("ann_return"), r("sharpe"))


@query
def grid_stability(spark, d):
    """Median and worst Sharpe ratio over those fifteen cells, and whether one of them loses."""
    g = QUERIES["lookback_top_grid"](spark, d)
    return g.agg(F.count("*").alias("cells"), F.median("sharpe").alias("median"), F.min("sharpe").alias("worst")).select(n("cells"), r("median"), r("worst"), (F.col("worst") < 0).alias("fragile"))


def _cell_books(spark, d):
    """Every rule at every setting of its windows and thresholds: the settings, the rotation behind them, and all baskets in one plan."""
    of, axes = rotation.cells(), rotation.Axes()

    def features(rows, signal):
        vol = ind.realized_vol(rows, 12).select("symbol", "bar", F.col("rv").alias("vol"))
        lasting = ind.rolling_hursts(rows, axes.hurst).select("symbol", "bar", *(F.nanvl(f"hurst_{w}", F.lit(None)).alias(f"hurst_{w}") for w in axes.hurst))
        return signal.join(vol, ["symbol", "bar"]).join(ind.dmi_windows(rows, axes.di), ["symbol", "bar"]).join(lasting, ["symbol", "bar"])

    x = Rotation(spark, d, extra=features, raw=walks(complete(hourly(spark, d))))
    return of, x, rotation.cell_baskets(x.signal, of, x.start, EVERY, TOP, x.bars)


def _rule_cells(spark, d):
    """Phase-neutral statistics of every setting, and the rotation behind them."""
    of, x, held = _cell_books(spark, d)
    stats_ = results.performance(rotation.neutral_profit(held, x.signal, x.clock, len(of), x.start, EVERY, x.bars), ["cell"], PER_YEAR)
    kind = "cell int, variant string, di_window int, hurst_window int, level double, grid boolean, near boolean, own boolean"
    names = spark.createDataFrame([(k, c.variant, c.di, c.hurst, c.level, c.grid, c.near, c.own) for k, c in enumerate(of)], kind)  # one row for each setting
    return names.join(stats_, "cell"), x


@query
def parameter_grid_neutral(spark, d):
    """The grid of each rule with knobs: DMI window and ADX threshold, DMI window alone, or Hurst window and threshold."""
    g, _ = _rule_cells(spark, d)
    return g.where("grid").select("variant", n("di_window"), n("hurst_window"), "level", r("ann_return"), r("sharpe"))


@query
def neighborhood_stability(spark, d):
    """Median and worst Sharpe ratio around each rule's own setting, over the settings that trade, and how many those are."""
    g, _ = _rule_cells(spark, d)
    x = g.where("near").groupBy("variant").agg(F.count("sharpe").alias("settings"), F.median("sharpe").alias("median"), F.min("sharpe").alias("worst"))
    return x.select("variant", n("settings"), r("median"), r("worst"))


@query
def variant_verdicts(spark, d):
    """Every rule at its own setting against holding all names, and whether a cell of its own grid loses (a rule without knobs is not fragile)."""
    g, x = _rule_cells(spark, d)
    hold = results.performance(rotation.buy_and_hold(x.signal, x.start).withColumn("k", F.lit(1)), ["k"], PER_YEAR).select(F.col("sharpe").alias("hold"))
    on = lambda flag, value: F.when(F.col(flag), F.col(value))
    v = g.groupBy("variant").agg(F.max(on("own", "sharpe")).alias("sharpe"), F.median(on("grid", "sharpe")).alias("median"), F.min(on("grid", "sharpe")).alias("worst"))
    v = v.crossJoin(hold)  # one row
    yes = lambda c: F.coalesce(c, F.lit(False))
    return v.select("variant", r("sharpe"), r("hold"), yes(F.col("sharpe") > F.col("hold")).alias("beats"), r("median"), r("worst"), yes(F.col("worst") < 0).alias("fragile"))


def _deltas(spark, nudges, perf):
    """key, value, sharpe and its change from the base (cell 0); nudges: (key, value) of cells from 1 on."""
    names = spark.createDataFrame([(k + 1, key, value) for k, (key, value) in enumerate(nudges)], "cell int, key string, value long")
    base = perf.where("cell = 0").select(F.col("sharpe").alias("base"))
    return names.join(perf, "cell").crossJoin(base).select("key", "value", r("sharpe"), r(F.col("sharpe") - F.col("base"), "delta"))  # base is one row


@query
def perturbation(spark, d):
    """Each parameter nudged by ten per cent either way (whole numbers are cut), and the change of the Sharpe ratio, in one plan."""
    nudges = [(key, int(value * f)) for key, value in (("lookback", LOOKBACK), ("every", EVERY)) for f in (0.9, 1.1)]
    of = [(LOOKBACK, EVERY)] + [(v, EVERY) if key == "lookback" else (LOOKBACK, v) for key, v in nudges]
    looks = sorted({k for k, _ in of})

    def scores(rows, signal):
        return rows.select("symbol", "bar", ind.log_return().alias("ret"), ind.trend("close", FAST, SLOW).alias("ok"), *(ind.roc("close", k).alias(f"roc{k}") for k in looks))

    x = Rotation(spark, d, extra=scores, score=F.lit(0.0))
    pnl = rotation.nudged(x.signal, x.clock, {k: F.col(f"roc{k}") for k in looks}, F.col("ok"), of, x.start, TOP, x.bars)
    return _deltas(spark, nudges, results.performance(pnl, ["cell"], PER_YEAR))


@query
def perturbation_factors(spark, d):
    """The factor book under nudged rebalancing and z window; what a nudge does not touch is computed once."""
    rows, base = _factor_rows(spark, d), {"every": 45, "z_window": 90}
    nudges = [(key, int(value * f)) for key, value in base.items() for f in (0.9, 1.1)]
    of = [base] + [base | {key: v} for key, v in nudges]
    resid = {e: stored(factors.residuals(rows, 200, 100, e, 2, 3), "residuals") for e in sorted({c["every"] for c in of})}
    parts = [factors.stat_arb(resid[c["every"]], c["z_window"]).groupBy("bar").agg(F.sum("part").alias("pnl")).withColumn("cell", F.lit(k)) for k, c in enumerate(of)]
    return _deltas(spark, nudges, results.performance(reduce(DataFrame.unionByName, parts), ["cell"], PER_YEAR))


def _permuted(x, count):
    """sim, total: profit of baskets chosen by a hash of simulation, symbol and bar."""
    sims = x.signal.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    t0 = F.col("bar") + 1
    picks = sims.where("ok AND roc IS NOT NULL").select("sim", "symbol", t0.alias("t0")).where((F.col("t0") >= x.start) & ((F.col("t0") - x.start) % EVERY == 0) & (F.col("t0") < x.bars))
    order = Window.partitionBy("sim", "t0").orderBy(F.md5(F.concat_ws("|", F.col("sim").cast("string"), "symbol", F.col("t0").cast("string")).cast("binary")))
    picks = picks.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TOP).withColumn("weight", 1 / F.count("*").over(Window.partitionBy("sim", "t0")))
    parts = rotation.contributions(picks.withColumnRenamed("sim", "phase"), x.signal, EVERY, x.bars)
    return parts.groupBy("phase").agg(F.sum("part").alias("total")).select(n("phase", "sim"), "total")


@query
def permutation_test(spark, d):
    """Total profit of baskets chosen by a hash of simulation, symbol and bar, for the 20 simulations of the SQL."""
    return _permuted(Rotation(spark, d), 20).select("sim", r("total"))


@query
def permutation_significance(spark, d):
    """The real profit among 400 random runs: share of the runs that reach it."""
    x = Rotation(spark, d)
    real = x.parts.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("real"))
    # real is one row; a random run that picks the same baskets may differ in the last digits
    share = F.avg(F.when(F.col("total") >= F.col("real") - 1e-12, 1.0).otherwise(0.0))
    return _permuted(x, 400).crossJoin(real).agg(n(F.count("*"), "sims"), r(F.first("real"), "real"), r(F.percentile("total", F.lit(0.5)), "p50"), r(share, "p_value"))


@query
def runner_consistency(spark, d):
    """The phase plan's first phase against the single run: largest difference."""
    a = Rotation(spark, d).pnl().select("bar", F.col("pnl").alias("x"))
    b = Rotation(spark, d, phases=3).pnl().where("phase = 0").select("bar", F.col("pnl").alias("y"))
    return a.join(b, "bar", "full").agg(r(F.max(F.abs(F.coalesce("x", F.lit(9.0)) - F.coalesce("y", F.lit(-9.0)))), "worst"), n(F.count("*"), "n"))


# --- resampling ------------------------------------------------------------------------------------------------------------


#: Draws that the SQL of the bootstraps fixes, and those of the full runs.
DRAWS, FULL_DRAWS, FULL_PAIRED_DRAWS = 200, 2000, 5000


def _boot(spark, d, draws):
    return results.boot_sharpe(results.block_bootstrap(Rotation(spark, d).pnl(), ["pnl"], 24, draws), "pnl", PER_YEAR)


def _against_hold(spark, d):
    """bar, pnl of the rotation, hold (all names) and a constant key."""
    x = Rotation(spark, d)
    return x.pnl().select("bar", "pnl").join(rotation.buy_and_hold(x.signal, x.start).withColumnRenamed("pnl", "hold"), "bar").withColumn("book", F.lit("rotation"))


@query
def block_bootstrap(spark, d):
    return _boot(spark, d, DRAWS).select(n("boot"), r("sharpe"))


def _boot_full(spark, d):
    pnl = Rotation(spark, d).pnl().withColumn("book", F.lit("rotation"))
    return resampling.moments(resampling.draws(pnl, ["book"], ["pnl"], 24, FULL_DRAWS), ["book"], "pnl", PER_YEAR)


@query
def block_bootstrap_full(spark, d):
    return _boot_full(spark, d).select(n("boot"), r("sharpe"))


@query
def bootstrap_significance(spark, d):
    return results.significance(_boot(spark, d, DRAWS)).select(r("p05"), r("p50"), r("p95"), r("p_positive"), n("degenerate"))


@query
def bootstrap_significance_full(spark, d):
    return resampling.significance(_boot_full(spark, d), ["book"]).select(r("p05"), r("p50"), r("p95"), r("p_positive"), n("degenerate"))


@query
def pair_significance(spark, d):
    """The bootstrap of every pair's book in one plan."""
    drawn = resampling.draws(_book(spark, d)[0], PAIR, ["pnl"], 24, FULL_DRAWS, "i")
    return resampling.significance(resampling.moments(drawn, PAIR, "pnl", PER_YEAR), PAIR).select(*PAIR, r("p05"), r("p50"), r("p95"), r("p_positive"), n("degenerate"))


@query
def paired_bootstrap(spark, d):
    draws = results.block_bootstrap(_against_hold(spark, d), ["pnl", "hold"], 24, DRAWS)
    a, b = results.boot_sharpe(draws, "pnl", PER_YEAR), results.boot_sharpe(draws, "hold", PER_YEAR).withColumnRenamed("sharpe", "other")
    return a.join(b, "boot").select(n("boot"), r(F.col("sharpe") - F.col("other"), "diff"))


def _paired_full(spark, d):
    return resampling.paired(_against_hold(spark, d), ["book"], "pnl", "hold", 24, FULL_PAIRED_DRAWS, PER_YEAR)


@query
def paired_bootstrap_full(spark, d):
    return _paired_full(spark, d).select(n("boot"), r("diff"))


@query
def paired_significance(spark, d):
    """Interval of the difference in Sharpe ratio against holding all names, and the chances of a better ratio and of a lower volatility."""
    return resampling.interval(_paired_full(spark, d), ["book"]).select(r("lo"), r("mid"), r("hi"), r("p_better"), r("p_vol_lower"))


def _evaluations(spark, d):
    rot = Rotation(spark, d)
    a = rot.pnl().agg(F.count("*").alias("n"), (F.avg("pnl") / F.nullif(F.stddev_pop("pnl"), F.lit(0.0))).alias("sharpe_bar"))
    t = rot.trades().groupBy("symbol").agg(F.sum("pnl").alias("p")).agg((F.avg(F.when(F.col("p") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_profitable"))
    book = _book(spark, d)[0]
    per = book.groupBy(*PAIR).agg(F.count("*").alias("n"), (F.avg("pnl") / F.nullif(F.stddev_pop("pnl"), F.lit(0.0))).alias("sharpe_bar"))
    share = per.agg((F.avg(F.when(F.col("sharpe_bar") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_profitable"))
    best = per.orderBy(F.desc_nulls_last("sharpe_bar"), *PAIR).limit(1).select("n", "sharpe_bar")
    # each side of these joins is one row
    return a.crossJoin(t).withColumn("family", F.lit("rotation")).unionByName(best.crossJoin(share).withColumn("family", F.lit("mean reversion")))


@query
def deflated_sharpe(spark, d):
    return results.deflated(_evaluations(spark, d), 14, 0.02).select("family", n("n"), r("sharpe_bar"), r("dsr"))


@query
def leaderboard(spark, d):
    return results.leaderboard(results.deflated(_evaluations(spark, d), 14, 0.02)).select("family", r("pct_profitable"), r("dsr"))


# --- models ----------------------------------------------------------------------------------------------------------------


@query
def adf_lagged(spark, d):
    """Change on level and one earlier change, with p-value."""
    s = pairs.spreads(joint(spark, d))
    out = models.by_key(s, PAIR, "spread", models.lagged_unit_root, "gamma double, error double, tau double, p double")
    return out.select(*PAIR, r("gamma"), r("error"), r("tau"), r("p"))


@query
def pca_residuals(spark, d):
    x = _factor_rows(spark, d)
    return factors.residuals(x, 200, 100, 45, 2, 3).select("symbol", n("bar"), n("refit"), r("resid"))


@query
def pca_stat_arb(spark, d):
    out = factors.stat_arb(factors.residuals(_factor_rows(spark, d), 200, 100, 45, 2, 3))
    return out.select("symbol", n("bar"), r("z"), r("position"), "reason", n("n_open"), r("part"))


@query
def pca_trades(spark, d):
    """The factor book's trades, those open at the end included."""
    rows = _factor_rows(spark, d)
    log = factors.trades(factors.stat_arb(factors.residuals(rows, 200, 100, 45, 2, 3)), rows.agg(F.max("bar")))
    return log.select("symbol", n("entry"), n("exit"), "direction", r("entry_z"), r("exit_z"), n("hold_bars"), "exit_reason", r("pnl"))


@query
def pca_capital(spark, d):
    """What the factor book makes of a starting capital that no bar exceeds."""
    pnl = factors.stat_arb(factors.residuals(_factor_rows(spark, d), 200, 100, 45, 2, 3)).groupBy("bar").agg(F.sum("part").alias("pnl")).withColumn("book", F.lit("factor residuals"))
    units = spark.createDataFrame([("factor residuals", 50_000.0)], "book string, unit double")
    return results.capital(pnl, ["book"], units, 50_000.0).select("book", r("unit"), r("final"), r("total_return_pct"))


def _factor_rows(spark, d):
    x = panel.indexed(complete(daily(spark, d)))
    return x.select("symbol", "bar", ind.log_return().alias("ret"))


@query
def garch_fit(spark, d):
    x = bars(spark, d).select("symbol", F.col("bar").alias("i"), ind.log_return().alias("x"))

    def f(v):
        m = models.fit_garch(v)
        return m["mu"], m["omega"], m["alpha"], m["beta"], m["loglik"], m["alpha"] + m["beta"]

    return models.by_key(x, ["symbol"], "x", f, "mu double, omega double, alpha double, beta double, loglik double, persistence double").select("symbol", *(r(c) for c in ("mu", "omega", "alpha", "beta", "loglik", "persistence")))


@query
def garch_forecast(spark, d):
    x = bars(spark, d).select("symbol", F.col("bar").alias("i"), ind.log_return().alias("x"))
    f = lambda v: tuple(models.forecast(v, models.fit_garch(v), 5) ** 0.5)
    return models.by_key(x, ["symbol"], "x", f, "h1 double, h2 double, h3 double, h4 double, h5 double").select("symbol", *(r(f"h{k}") for k in range(1, 6)))


@query
def ou_calibration(spark, d):
    """The entry threshold of each pair from its own speed and deviation, at five basis points a trade."""
    s = stats.changes(pairs.spreads(joint(spark, d)), PAIR, "spread").groupBy(*PAIR).agg(*stats.unit_root())
    kinds = "a string, b string, kappa double, sigma double, entry_z double, expected double"

    def run(batches):
        for p in batches:
            found = [models.calibrate_entry(-g, v, 5e-4) for g, v in zip(p["gamma"], p["sigma"], strict=True)]
            yield p.assign(kappa=-p["gamma"], entry_z=[x[0] if x else None for x in found], expected=[x[1] if x else None for x in found])[["a", "b", "kappa", "sigma", "entry_z", "expected"]]

    return s.select(*PAIR, "gamma", "sigma").mapInPandas(run, kinds).select(*PAIR, r("kappa"), r("sigma"), r("entry_z"), r("expected"))


@query
def ou_moments(spark, d):
    """Each pair's spread against the process fitted to it: mean and variance over time, stationary variance in theory, half-life."""
    s = pairs.spreads(joint(spark, d))
    seen = s.groupBy(*PAIR).agg(F.avg("spread").alias("mean"), F.var_pop("spread").alias("var"))
    fit = stats.changes(s, PAIR, "spread").groupBy(*PAIR).agg(*stats.unit_root())
    return seen.join(fit, PAIR).select(*PAIR, r("mean"), r("var"), r(stats.stationary_variance(), "theory"), r(stats.half_life(), "half_life"))


@query
def tick_bars(spark, d):
    """The streaming bar aggregation on the whole table: equal to the batch bars."""
    ticks = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = bar_stream(ticks, "event_type", "ts", "value")
    return x.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r("open"), r("high"), r("low"), r("close"), n("volume"))


# --- orchestration and sizing ----------------------------------------------------------------------------------------------


@query
def rolling_hurst(spark, d):
    return ind.rolling_hurst(bars(spark, d), 120, 9).select("symbol", n("bar"), r("hurst"))


def _features_hurst(rows, signal):
    x = _features(rows, signal).drop("hurst").join(ind.rolling_hurst(rows, 120, 9), ["symbol", "bar"])
    return x.withColumn("hurst", F.when(~F.isnan("hurst"), F.col("hurst")))


@query
def momentum_hurst_variants(spark, d):
    """Baskets of the two Hurst rules at their own setting on the first phase of the clock, over prices that wander."""
    of, x, held = _cell_books(spark, d)
    own = spark.createDataFrame([(k, c.variant) for k, c in enumerate(of) if c.own and c.hurst], "cell int, variant string")
    return held.where("phase = 0").join(own, "cell").select("variant", n("t0"), "symbol", n("rank"))


def _walked(spark, d):
    """Refits, the z of each bar under the fit in force, positions, scale and profit."""
    s = joint(spark, d).withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb"))
    fits = pairs.walk_forward(joint(spark, d), lookback=5, every=5, start=5)
    # windows reach back over the whole history; rows before the first refit are left out afterwards
    rows = pairs.variable_z(pairs.held(s, fits)).where("beta IS NOT NULL")
    rows = rows.withColumn("i", (F.row_number().over(Window.partitionBy(*PAIR).orderBy("i")) - 1).cast("long"))
    rows = rows.withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha")).persist()
    f = machine.positions(rows, PAIR, machine.Rule()).persist()
    sized = machine.vol_scale(machine.spread_vol(rows, "spread", PAIR), "sigma", PAIR)
    return machine.profit(sized.join(f, [*PAIR, "i"]), PAIR), f


@query
def walk_forward_meanrev(spark, d):
    return _walked(spark, d)[0].select(*PAIR, n("i"), "qualified", n("zw"), r("z"), r("position"), r("scale"), r("pnl"))


@query
def meanrev_trades(spark, d):
    book, f = _walked(spark, d)
    log = machine.trade_profit(machine.trades(f, book, PAIR), book, PAIR)
    return log.select(*PAIR, n("entry"), n("exit"), "direction", n("hold_bars"), "exit_reason", r("pnl"))


def _walk_log(spark, d):
    book, f = _walked(spark, d)
    return machine.trade_profit(machine.trades(f, book, PAIR), book, PAIR), book


@query
def trade_summary(spark, d):
    """Each pair's walk-forward trades in one row."""
    return results.summary(_walk_log(spark, d)[0], PAIR).select(*PAIR, n("n"), r("win_rate"), r("avg_hold"), r("best"), r("worst"))


@query
def trade_numbers(spark, d):
    """The trades of all pairs merged and numbered by entry."""
    log = results.numbered(_walk_log(spark, d)[0], ["exit_ts", *PAIR])
    return log.select(n("number"), *PAIR, n("entry"), n("exit"), "direction")


@query
def pair_activity(spark, d):
    """Share of bars disqualified and idle, turnover a year, of each walk-forward book."""
    return results.activity(_walk_log(spark, d)[1], PAIR, PER_YEAR).select(*PAIR, r("disqualified"), r("idle"), r("turnover_year"))


@query
def capital_report(spark, d):
    """100,000 behind each walk-forward book, one per cent of it at risk at the median deviation."""
    book = _walk_log(spark, d)[1]
    units = sizing.risk_unit(book, PAIR, "sigma", 100_000.0, 1.0)
    return results.capital(book, PAIR, units, 100_000.0).select(*PAIR, r("unit"), r("final"), r("total_return_pct"))


@query
def ticker_trades(spark, d):
    """The eight symbols with the most legs of pair trades: sides, amounts, moves, money."""
    log, book = _log(spark, d)
    log = log.join(book.select(*PAIR, F.col("i").alias("entry"), "beta"), [*PAIR, "entry"])
    t = results.by_ticker(machine.legs(log, 10_000.0)).orderBy(F.desc("legs"), "symbol").limit(8)
    return t.select("symbol", n("legs"), n("longs"), n("shorts"), r("mean_amount"), r("mean_move"), r("won"))


@query
def universe(spark, d):
    """Symbols of both panels, each once."""
    return hourly(spark, d).select("symbol").union(daily(spark, d).select("symbol")).distinct()


@query
def meanrev_universe(spark, d):
    """Statistics of every pair's walk-forward book, best first."""
    p = results.performance(_walked(spark, d)[0], PAIR, PER_YEAR, "i")
    return p.select(*PAIR, n("n"), r("ann_return"), r("sharpe"), r("max_drawdown"), (F.coalesce(F.col("sharpe"), F.lit(0.0)) > 0).alias("profitable"))


@query
def red_flags(spark, d):
    perf = results.performance(_book(spark, d)[0], PAIR, PER_YEAR, "i")
    return sizing.red_flags(perf, QUERIES["beta_stability"](spark, d), PAIR)


@query
def vol_basket(spark, d):
    """All symbols' volatility machines at once, capital split evenly: money won at each bar."""
    rows = _vol_rows(spark, d)
    f = machine.positions(rows, ["symbol"], machine.Rule(entry=1.5, stop=3.5, leave=0.5, two_sided=False, flat_at_end=True), "bar")
    w = Window.partitionBy("symbol").orderBy("bar")
    x = rows.join(f, ["symbol", "bar"]).withColumn("pnl", F.coalesce(F.lag("position").over(w) * (F.ln("close") - F.lag(F.ln("close")).over(w)), F.lit(0.0)))
    names = x.select(F.countDistinct("symbol").alias("k"))
    return x.groupBy("bar").agg(F.sum("pnl").alias("s")).crossJoin(names).select(n("bar"), r(F.col("s") * 100_000.0 / F.col("k"), "won"))  # names is one row


#: The volatility book on this panel of 30 sessions: regimes over five sessions.
VOL = volatility.VolParams(lookback=5)


@query
def vol_regimes(spark, d):
    """Each session's regime of each symbol over the five sessions before it."""
    rows = ind.realized_vol(bars(spark, d), VOL.window)
    return volatility.regimes(rows, VOL).select("symbol", n("sess"), n("n"), r("tau"), r("h"), "qualified")


@query
def vol_walk_forward(spark, d):
    """Bars out of sample: z within the session, and the session's regime."""
    return volatility.walk_forward(bars(spark, d), VOL).select("symbol", n("bar"), r("z"), "qualified")


@query
def vol_walk_forward_positions(spark, d):
    """Positions under the regime check of each session; reason tells why one closes."""
    f = machine.positions(volatility.walk_forward(bars(spark, d), VOL), ["symbol"], volatility.machine_rule(VOL), "bar")
    return f.select("symbol", n("bar"), r("position"), n("entry"), "reason")


@query
def vol_book(spark, d):
    """The whole book sized by each session's volatility forecast: every bar's scale and profit."""
    return volatility.book(hourly(spark, d), VOL).book.select("symbol", n("bar"), "qualified", r("sigma"), r("scale"), r("position"), r("pnl"))


@query
def vol_book_stats(spark, d):
    b = volatility.book(hourly(spark, d), VOL)
    return b.stats(PER_YEAR).select("symbol", r("ann_return"), r("sharpe"), r("max_drawdown"), n("n_trades"), n("n_stops"), n("n_breaks"), r("disqualified"))


@query
def trade_amounts(spark, d):
    x = Rotation(spark, d)
    out = sizing.amounts(x.trades(), x.pnl(), bars(spark, d), sizing.dollar_per_unit(100_000.0, 1.0), ["phase"])
    return out.select("symbol", n("entry"), n("exit"), r("entry_price"), r("exit_price"), r("amount"), n("shares"))


@query
def phase_percentiles(spark, d):
    x = Rotation(spark, d, phases=EVERY)
    p = results.performance(x.pnl(), ["phase"], PER_YEAR).withColumn("k", F.lit(1))
    return sizing.percentiles(p, ["k"], "sharpe").select(r("lo"), r("p05"), r("p50"), r("p95"), r("hi"))


@query
def change_pct(spark, d):
    return sizing.change_pct(bars(spark, d)).select("symbol", r("last"), r("day_pct"), r("total_pct"))


@query
def chart_range(spark, d):
    return sizing.padded_range(bars(spark, d), "close", 50).select("symbol", r("lo"), r("hi"))


@query
def naive_static_z(spark, d):
    """One hedge ratio for the whole sample, sized by a fixed deviation: positions without a stop."""
    rows = pairs.rolling_z(pairs.spreads(joint(spark, d)), "spread", PAIR, 120)
    return machine.positions(rows, PAIR, machine.Rule(stop=None)).select(*PAIR, n("i"), r("position"))


@query
def naive_in_sample_z(spark, d):
    """The same with the hedge ratio of each pair's sessions in sample, held over the whole time."""
    rows = backtests.split_of(joint(spark, d), FRACTION).withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb"))
    w, seen = Window.partitionBy(*PAIR), F.col("sess") < F.col("split")
    y, x = F.when(seen, F.col("la")), F.when(seen, F.col("lb"))
    rows = rows.withColumn("spread", F.col("la") - F.regr_slope(y, x).over(w) * F.col("lb") - F.regr_intercept(y, x).over(w))
    rows = pairs.rolling_z(rows, "spread", PAIR, 120)
    return machine.positions(rows, PAIR, machine.Rule(stop=None)).select(*PAIR, n("i"), r("position"))


@query
def garch_sized_pnl(spark, d):
    """Same-bar illustration: each symbol's position sized by its fitted conditional deviation."""
    x = bars(spark, d).select("symbol", F.col("bar").alias("i"), ind.log_return().alias("x"))

    def f(v):
        m = models.fit_garch(v)
        s = models.variances((v - m["mu"]) ** 2, m["omega"], m["alpha"], m["beta"]) ** 0.5
        import numpy as np

        scale = np.clip(np.median(s) / s, 0.2, 3.0)
        return float(v.sum()), float((v * scale).sum()), float(scale.mean())

    return models.by_key(x, ["symbol"], "x", f, "plain double, sized double, scale double").select("symbol", r("plain"), r("sized"), r("scale"))


@query
def variant_summary(spark, d):
    """Phase-neutral and costed results of every selection rule, in one plan, against holding all names."""
    x = Rotation(spark, d, phases=EVERY, extra=_features_hurst)
    key = ("variant", "phase")
    rules = rotation.variants()
    held = rotation.variant_baskets(x.signal, rules, x.start, EVERY, TOP, x.bars, EVERY)
    parts = rotation.contributions(held, x.signal, EVERY, x.bars, key).groupBy(*key, "bar").agg(F.sum("part").alias("pnl"), F.count("*").alias("n_held"))
    moves = rotation.turnover(held, EVERY, TOP, x.bars, key).select(*key, "bar", "turnover")
    # phases without a basket earn 0, so the mean over phases is a sum over EVERY; from the bar on at which all have begun
    blend = parts.join(moves, [*key, "bar"], "full").groupBy("variant", "bar").agg(*((F.coalesce(F.sum(c), F.lit(0.0)) / EVERY).alias(c) for c in ("pnl", "turnover", "n_held")))
    names = F.explode(F.array(*(F.lit(k) for k in rules))).alias("variant")
    at = x.clock.where(F.col("bar") >= x.start + EVERY).select("bar", names)
    mean = at.join(blend, ["variant", "bar"], "left").select("variant", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pnl", "turnover", "n_held")))
    mean = mean.select("variant", "pnl", (F.col("pnl") - F.col("turnover") * 5e-4).alias("net"), F.col("n_held").alias("held"))
    hold = rotation.buy_and_hold(x.signal, x.start).crossJoin(x.signal.select(F.countDistinct("symbol").cast("double").alias("held")))  # the count is one row
    mean = mean.unionByName(hold.select(F.lit("buy_and_hold").alias("variant"), "pnl", F.col("pnl").alias("net"), "held"))
    y = mean.groupBy("variant").agg(F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"), F.avg("net").alias("net"), F.avg("held").alias("held"), F.avg(F.when(F.col("held") == 0, 1.0).otherwise(0.0)).alias("idle"))
    return y.select("variant", r(F.col("m") * PER_YEAR, "ann_return"), r(results.sharpe(F.col("m"), F.col("s"), PER_YEAR), "sharpe"), r(F.col("net") * PER_YEAR, "net_return"), r("held"), r("idle"))


def _intraday(spark, d):
    """Refitted every session on the five before; z within the session; flat at its end; the hedge ratio must stay sane."""
    s = joint(spark, d).withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb"))
    fits = pairs.walk_forward(joint(spark, d), lookback=5, every=1, start=1)
    rows = pairs.held(s, fits).where("beta IS NOT NULL").withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))
    rows = rows.withColumn("qualified", F.col("qualified") & (F.col("beta") > 0) & (F.col("beta") < 3))
    rows = pairs.session_z(rows, "spread", PAIR)
    by = Window.partitionBy(*PAIR).orderBy("i")
    rows = rows.withColumn("is_last", F.coalesce(F.lead("sess").over(by) != F.col("sess"), F.lit(True))).withColumn("change", F.coalesce(F.col("spread") - F.lag("spread").over(by), F.lit(0.0))).persist()
    return rows, machine.positions(rows, PAIR, machine.Rule(flat_at_end=True))


@query
def intraday_walk_forward(spark, d):
    rows, f = _intraday(spark, d)
    out = machine.profit(rows.withColumn("scale", F.lit(1.0)).join(f, [*PAIR, "i"]), PAIR)
    return out.select(*PAIR, n("i"), "qualified", r("z"), r("position"), r("pnl"))


@query
def intraday_garch_scale(spark, d):
    """The scale of every pair's positions from a volatility forecast refitted every session."""
    rows, _ = _intraday(spark, d)
    sigma = machine.garch_sigma(rows, PAIR, lookback=5)
    out = machine.vol_scale(rows.join(sigma.withColumn("sigma", F.when(~F.isnan("sigma"), F.col("sigma"))), [*PAIR, "i"]), "sigma", PAIR)
    return out.select(*PAIR, n("i"), r("scale"))


@query
def daily_walk_forward(spark, d):
    """Rolling hedge ratio of daily prices; the position earns the next change of its own day's residual."""
    s = panel.pairs(complete(daily(spark, d)), 200).withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb"))
    rows = pairs.ols_z(s, 120).withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha")).where("z IS NOT NULL").persist()
    f = machine.positions(rows, PAIR, machine.Rule())
    by = Window.partitionBy(*PAIR).orderBy("i")
    rows = rows.withColumn("change", F.coalesce(F.col("spread") - F.lag("spread").over(by), F.lit(0.0))).withColumn("scale", F.lit(1.0))
    return machine.profit(rows.join(f, [*PAIR, "i"]), PAIR).select(*PAIR, n("i"), r("beta"), r("position"), r("pnl"))


# --- whole backtests -------------------------------------------------------------------------------------------------------


_STATS = ("ann_return", "sharpe", "max_drawdown")


def _report(b, keys=PAIR):
    return b.stats(PER_YEAR).select(*keys, n("n"), *(r(c) for c in _STATS), n("n_trades"), n("n_stops"), n("n_breaks"), r("disqualified"))


@query
def backtest_pairs(spark, d):
    """The fifteen best qualifying pairs of the screen in sample, each walked forward out of sample."""
    return _report(backtests.mean_reversion(hourly(spark, d), backtests.PairParams()))


@query
def backtest_pairs_calibrated(spark, d):
    """The same with entry and stop of each qualified refit from simulated paths at five basis points."""
    return _report(backtests.mean_reversion(hourly(spark, d), backtests.PairParams(cost_bps=5.0)))


@query
def backtest_intraday(spark, d):
    """Refitted every session, flat at its end, sized by the volatility forecast of each refit."""
    return _report(backtests.intraday(hourly(spark, d)))


@query
def backtest_daily(spark, d):
    """Daily hedge ratios; regime and volatility model checked again every 21 rows."""
    return _report(backtests.daily(complete(daily(spark, d))))


@query
def backtest_costs(spark, d):
    """Each traded pair's statistics at every cost of a switch."""
    b = backtests.mean_reversion(hourly(spark, d), backtests.PairParams())
    return b.costs(PER_YEAR).select(*PAIR, n("cost_bps"), r("ann_return"), r("sharpe"))


@query
def screen_by_p_value(spark, d):
    """The daily screen in sample, ranked by p-value."""
    rows = backtests.split_of(panel.pairs(complete(daily(spark, d))), FRACTION).where("sess < split").drop("split")
    return backtests.screen_by_p(rows, backtests.DailyParams()).select("pair", r("beta"), r("adf_stat"), r("adf_p"), r("h"), "qualifies")


@query
def best_pair_elsewhere(spark, d):
    """Whether the best pair of the first half of the sessions is the best of the second half."""
    rows = backtests.split_of(joint(spark, d), 0.5)
    one, two = (pairs.screen(rows.where(c).drop("split")) for c in ("sess < split", "sess >= split"))
    return backtests.same_winner(one, two).select("pair", "other", r("adf_stat"), "qualifies", "same")


def _vol_basket(spark, d):
    rows = _vol_rows(spark, d)
    picks = pairs.vol_screen(bars(spark, d)).where("qualifies").orderBy("adf_stat", "symbol").limit(3)
    return backtests.basket(rows, picks, machine.Rule(entry=1.5, stop=3.5, leave=0.5, two_sided=False, flat_at_end=True))


@query
def vol_basket_top(spark, d):
    """The three best symbols of the volatility screen, the capital split evenly: trades of each in the order of entry."""
    b = _vol_basket(spark, d)
    return results.numbered(b.trades, ["exit_ts", "symbol"]).select(n("number"), "symbol", n("entry"), n("exit"), "exit_reason", r("pnl"))


@query
def vol_basket_costs(spark, d):
    """The basket's statistics at every cost, charged on each symbol's own turnover."""
    return backtests.basket_costs(_vol_basket(spark, d), PER_YEAR).select(n("cost_bps"), r("ann_return"), r("sharpe"), r("max_drawdown"))


@query
def garch_report(spark, d):
    """Each symbol's fitted model: persistence, long-run deviation, bars in which a shock halves."""
    x = bars(spark, d).select("symbol", F.col("bar").alias("i"), ind.log_return().alias("x")).where("x IS NOT NULL")
    g = models.by_key(x, ["symbol"], "x", backtests.garch_state, "omega double, persistence double, v1 double")
    p = F.col("persistence")
    level = F.sqrt(F.col("omega") / F.nullif(1 - p, F.lit(0.0)))
    return g.select("symbol", r("persistence"), r(level, "long_run"), r(F.when((p > 0) & (p < 1), F.ln(F.lit(0.5)) / F.ln(p)), "half_life"))


@query
def variant_shortlist(spark, d):
    """The four best selection rules whose Sharpe ratio exceeds 0.85 of holding all names."""
    v = QUERIES["variant_summary"](spark, d)
    hold = v.where("variant = 'buy_and_hold'").select(F.col("sharpe").alias("hold"))
    x = v.where("variant <> 'buy_and_hold'").crossJoin(hold).where("sharpe > 0.85 * hold")  # hold is one row
    return x.orderBy(F.desc("sharpe"), "variant").limit(4).select("variant", "sharpe")


@query
def leaderboard_full(spark, d):
    """All three families by deflated Sharpe ratio: rotation, mean reversion out of sample, factor residuals."""
    one = F.avg("pnl") / F.nullif(F.stddev_pop("pnl"), F.lit(0.0))
    share = lambda c: (F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)) * 100).alias("pct_profitable")
    x = Rotation(spark, d)
    rot = x.pnl().agg(F.count("*").alias("n"), one.alias("sharpe_bar")).crossJoin(x.trades().groupBy("symbol").agg(F.sum("pnl").alias("p")).agg(share("p")))
    book = backtests.mean_reversion(hourly(spark, d), backtests.PairParams()).book
    per = book.groupBy(*PAIR).agg(F.count("*").alias("n"), one.alias("sharpe_bar"))
    rev = per.orderBy(F.desc_nulls_last("sharpe_bar"), *PAIR).limit(1).select("n", "sharpe_bar").crossJoin(per.agg(share("sharpe_bar")))
    arb = factors.stat_arb(factors.residuals(_factor_rows(spark, d), 200, 100, 45, 2, 3))
    pnl = arb.groupBy("bar").agg(F.sum("part").alias("pnl"))
    fac = pnl.agg(F.count("*").alias("n"), one.alias("sharpe_bar")).crossJoin(arb.groupBy("symbol").agg(F.sum("part").alias("p")).agg(share("p")))
    rows = None
    for name, f in (("rotation", rot), ("mean reversion", rev), ("factor residuals", fac)):  # every side is one row
        f = f.withColumn("family", F.lit(name))
        rows = f if rows is None else rows.unionByName(f)
    return results.leaderboard(results.deflated(rows, 14, 0.02)).select("family", n("n"), r("pct_profitable"), r("dsr"))
