"""Invariants and cross-checks of the panel operators on generated series, and agreement with SQL on the smallest tables."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.functions import models, stats
from barflow.operators import factors, indicators, machine, pairs, panel, results, rotation
from barflow.plans import registry
from barflow.sources import importer
from barflow.streaming.bars import Rotator, bar_stream, rotate, session_stream

ROOT = Path(__file__).resolve().parents[1]


def hourly_index(days, per_day=9):
    return [t for d in pd.bdate_range("2024-01-01", periods=days) for t in pd.date_range(d + pd.Timedelta(hours=10), periods=per_day, freq="h")]


def long(spark, at, **series):
    rows = [(s, t.to_pydatetime(), float(v)) for s, x in series.items() for t, v in zip(at, x, strict=True) if v == v]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")


def walk(n, sd, seed):
    return np.cumsum(np.random.default_rng(seed).normal(0, sd, n))


@pytest.fixture(scope="module")
def coint(spark):
    at = hourly_index(60)
    n = len(at)
    common, noise = walk(n, 0.01, 0), models.simulate_ou(0.1, 0.005, n, 1, 1)[0]
    return long(spark, at, AAA=np.exp(4 + common), BBB=np.exp(3 + 0.8 * common + noise), CCC=np.exp(4 + walk(n, 0.01, 21)), DDD=np.exp(4 + walk(n, 0.01, 32)))


def test_calendar_counts_panel_rows(spark):
    at = hourly_index(3)
    cal = panel.calendar(long(spark, at, A=np.arange(27) + 1.0, B=[1.0] * 5 + [math.nan] * 22)).orderBy("ts").collect()
    assert [r["bar"] for r in cal] == list(range(27)) and [r["sess"] for r in cal] == [k // 9 for k in range(27)]
    assert [r["is_last"] for r in cal] == [k % 9 == 8 for k in range(27)]


def test_windows_see_gaps(spark):
    at = hourly_index(1)
    rows = panel.indexed(long(spark, at, A=range(1, 10), B=[1, 2, math.nan, 4, 5, 6, 7, 8, 9]))
    out = {(r["symbol"], r["bar"]): r for r in rows.select("symbol", "bar", indicators.sma("close", 3).alias("m"), indicators.roc("close", 1).alias("roc")).collect()}
    assert out["A", 2]["m"] == 2 and out["A", 1]["m"] is None and out["B", 4]["m"] is None and out["B", 5]["m"] == 5 and out["B", 3]["roc"] is None


@pytest.mark.parametrize("days,per_day,want", [(3, 5, 1260), (10, 9, 2268)])
def test_bars_per_year(spark, days, per_day, want):
    at = hourly_index(days, per_day)
    assert panel.bars_per_year(long(spark, at, A=np.ones(len(at)))).first()["bars_per_year"] == want


def test_split_bounds(spark):
    with pytest.raises(ValueError):
        panel.split(spark.createDataFrame([], "symbol string, ts timestamp_ntz, close double"), 1.0)


def test_indicators_equal_pandas(spark):
    at, x = hourly_index(20), np.exp(walk(180, 0.01, 5)) * 100
    rows = panel.indexed(long(spark, at, A=x)).withColumn("high", F.col("close") * 1.01).withColumn("low", F.col("close") * 0.99)
    s = pd.Series(x)
    got = indicators.macd(rows, 12, 26, 9).orderBy("bar").toPandas()
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert np.allclose(got["macd"], line) and np.allclose(got["hist"], line - line.ewm(span=9, adjust=False).mean())
    rsi = indicators.rsi(rows, 14).orderBy("bar").toPandas()["rsi"]
    assert rsi.between(0, 100).all() and rsi[0] == 50
    dmi = indicators.dmi(rows, 14, "warm").orderBy("bar").toPandas()
    assert dmi["plus_di"][:14].isna().all() and (dmi["plus_di"][14:] >= 0).all()
    rising = panel.indexed(long(spark, at, A=np.arange(180) + 1.0))
    assert set(indicators.rsi(rising, 14).toPandas()["rsi"]) == {50.0}


def test_recurrence_keeps_the_past_over_gaps():
    rng = np.random.default_rng(3)
    for alpha in (1 / 14, 0.2, 1.0):
        x = rng.normal(size=200)
        x[rng.random(200) < 0.3] = np.nan
        assert np.allclose(indicators.recurrence(x, alpha), pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), equal_nan=True)
    assert np.isnan(indicators.recurrence(np.full(3, np.nan), 0.5)).all() and not len(indicators.recurrence(np.zeros(0), 0.5))


def test_band_cross_by_hand(spark):
    """A fall that ends in a bar up, still far under the band: a buy; its mirror image: a sell; nothing without the cross."""
    at = hourly_index(10)
    x = np.r_[100 + np.tile([0.1, -0.1], 30), 100 - 3.0 * np.arange(1, 6), 100 - 12.0, np.full(24, 88.0)]
    out = indicators.band_cross(panel.indexed(long(spark, at, A=x, B=200 - x)), w=3, k=1.0)
    assert {(r["symbol"], r["bar"], r["side"]) for r in out.collect()} == {("A", 65, "buy"), ("B", 65, "sell")}


def test_screen_finds_the_pair(spark, coint):
    out = {r["pair"]: r for r in pairs.screen(panel.pairs(coint, 200)).collect()}
    assert out["AAA/BBB"]["qualifies"] and not out["CCC/DDD"]["qualifies"] and 0.5 < 1 / out["AAA/BBB"]["beta"] < 1.1
    assert pairs.selected(pairs.screen(panel.pairs(coint, 200)), "BBB", "AAA").count() == 1
    assert pairs.screen(panel.pairs(coint, 10_000)).count() == 0


def test_unit_root_equals_least_squares(spark, coint):
    s = pairs.spreads(panel.pairs(coint)).where("a = 'AAA' AND b = 'BBB'")
    got = stats.changes(s, ["a", "b"], "spread").groupBy("a", "b").agg(*stats.unit_root()).first()
    p = s.orderBy("i").toPandas()
    same = p["sess"].to_numpy()[1:] == p["sess"].to_numpy()[:-1]
    y0, dy = p["spread"].to_numpy()[:-1][same], np.diff(p["spread"])[same]
    x = np.column_stack([np.ones_like(y0), y0])
    b, *_ = np.linalg.lstsq(x, dy, rcond=None)
    e = dy - x @ b
    se = math.sqrt(e @ e / (len(dy) - 2) * np.linalg.inv(x.T @ x)[1, 1])
    assert math.isclose(got["gamma"], b[1], rel_tol=1e-8) and math.isclose(got["tau"], b[1] / se, rel_tol=1e-8) and math.isclose(got["sigma"], e.std(), rel_tol=1e-6)


def test_hurst_tells_reversion_from_a_walk():
    assert stats.hurst(models.simulate_ou(0.1, 0.5, 3000, 1)[0]) < 0.4
    assert abs(stats.hurst(walk(3000, 1, 4)) - 0.5) < 0.1
    assert stats.hurst(np.cumsum(np.cumsum(np.ones(300)))) > 0.6


def test_unit_root_p_values():
    assert abs(models.unit_root_p(-2.86154) - 0.05) < 0.002 and abs(models.unit_root_p(-3.43035) - 0.01) < 0.001
    assert models.unit_root_p(5) == 1 and models.unit_root_p(-30) == 0 and models.unit_root_critical(10**9) == pytest.approx(-2.86154)
    assert models.lagged_unit_root(models.simulate_ou(0.2, 1, 800, 1)[0])[3] < 0.01 and models.lagged_unit_root(walk(800, 1, 8))[3] > 0.05


def fold(z, rule=machine.Rule(), ok=None, last=None, side=None):
    n = len(z)
    z = np.array(z, float)
    return machine.fold(z, np.ones(n, bool) if ok is None else np.array(ok), np.zeros(n, bool) if last is None else np.array(last), np.zeros(n) if side is None else np.array(side, float), rule)


def test_machine_cases():
    z = np.zeros(20)
    z[5:10], z[10] = 2, -0.1
    pos, entry, why = fold(z)
    assert pos[5] == -1 and pos[9] == -1 and pos[10] == 0 and entry[10] == 5 and why[10] == "reversion"
    z = np.zeros(20)
    z[3:7], z[7] = -2, -4
    assert fold(z)[2][7] == "hard stop" and fold(z, machine.Rule(stop=None))[2][7] is None
    z = np.zeros(10)
    z[2:] = 2
    last = [False] * 9 + [True]
    assert fold(z, machine.Rule(flat_at_end=True), last=last)[2][9] == "end of day" and fold(z)[2] == [None] * 10
    ok = [True] * 5 + [False] * 15
    z = np.zeros(20)
    z[2:5], z[10] = 2, -2
    pos, _, why = fold(z, ok=ok)
    assert why[5] == "regime break" and not pos[5:].any()
    pos, _, _ = fold([2, math.nan, 2])
    assert pos.tolist() == [-1, 0, -1]
    one = machine.Rule(two_sided=False, flat_at_end=True)
    pos, _, why = fold([2, 1, 0.4, 2, 4, 2], one, last=[False] * 5 + [True], side=[1, 0, 0, -1, 0, 1])
    assert pos.tolist() == [1, 1, 0, -1, 0, 0] and why[2] == "vol normalized" and why[4] == "vol kept expanding"


@pytest.mark.parametrize("seed", range(5))
def test_machine_is_flat_at_every_end(seed):
    z = np.random.default_rng(seed).normal(0, 2, 90)
    last = [k % 15 == 14 for k in range(90)]
    assert not fold(z, machine.Rule(flat_at_end=True), last=last)[0][14::15].any()


def test_trade_profit_reconciles(spark):
    z = np.random.default_rng(1).normal(0, 2, 200)
    rows = spark.createDataFrame([("k", i, float(v), float(c)) for i, (v, c) in enumerate(zip(z, np.random.default_rng(2).normal(0, 1, 200), strict=True))], "k string, i long, z double, change double")
    rows = rows.withColumn("scale", F.lit(1.0)).withColumn("ts", F.col("i"))
    f = machine.positions(rows, ["k"], machine.Rule())
    book = machine.profit(rows.join(f, ["k", "i"]), ["k"])
    log = machine.trade_profit(machine.trades(f, book, ["k"]), book, ["k"]).toPandas()
    b = book.orderBy("i").toPandas()
    for t in log.itertuples():
        assert math.isclose(t.pnl, b["pnl"][t.entry + 1 : t.exit + 1].sum(), abs_tol=1e-9)


def test_variable_windows_equal_direct_sums(spark, coint):
    s = pairs.spreads(panel.pairs(coint).where("a = 'AAA' AND b = 'BBB'")).withColumn("zw", (F.col("i") % 37 + 5).cast("long"))
    p = pairs.variable_z(s).orderBy("i").toPandas()
    for i in range(0, len(p), 17):
        w = p["spread"][max(0, i - p["zw"][i]) : i]
        want = (p["spread"][i] - w.mean()) / w.std(ddof=0) if len(w) >= 10 else 0.0
        assert math.isclose(p["z"][i], want, rel_tol=1e-5, abs_tol=1e-6)


def trend_panel(spark):
    at = hourly_index(40)
    n = len(at)
    up = {k: np.exp(4 + d * np.arange(n) + walk(n, 0.003, s)) for s, (k, d) in enumerate({"UP1": 6e-4, "UP2": 5e-4, "FLAT": 0, "DOWN": -2e-3}.items())}
    return panel.indexed(long(spark, at, **up)), n


def test_rotation_holds_the_risers(spark):
    rows, n = trend_panel(spark)
    sig = rotation.signals(rows, 20, 10, 30)
    held = rotation.baskets(sig, F.col("roc"), F.col("ok"), 100, 24, 2, n)
    h = held.toPandas()
    assert "DOWN" not in set(h["symbol"]) and h.groupby("t0").size().max() <= 2 and h.groupby("t0")["weight"].sum().round(9).eq(1).all()
    parts = rotation.contributions(held, sig, 24, n)
    pnl = rotation.profit(parts, rows.select("bar").distinct(), 100).toPandas()
    assert len(pnl) == n - 100 and math.isclose(pnl["pnl"].sum(), parts.agg(F.sum("part")).first()[0], abs_tol=1e-9)
    phases = rotation.profit(rotation.contributions(rotation.baskets(sig, F.col("roc"), F.col("ok"), 100, 24, 2, n, 3), sig, 24, n), rows.select("bar").distinct(), 100, 3)
    assert np.allclose(phases.where("phase = 0").orderBy("bar").toPandas()["pnl"], pnl.sort_values("bar")["pnl"])
    log = rotation.trades(held, parts, 24, n).toPandas()
    assert (log["hold_bars"] > 0).all() and set(log["exit_reason"]) <= {"rebalance drop", "end of backtest"}


def test_rotation_does_not_look_ahead(spark):
    rows, n = trend_panel(spark)
    crash = rows.withColumn("close", F.when((F.col("bar") >= n - 5) & (F.col("symbol") == "UP1"), F.col("close") / 7).otherwise(F.col("close")))
    pick = lambda x: rotation.baskets(rotation.signals(x, 20, 10, 30), F.col("roc"), F.col("ok"), 100, 24, 2, n).where(F.col("t0") <= n - 5).select("t0", "symbol").toPandas().sort_values(["t0", "symbol"]).values.tolist()
    assert pick(rows) == pick(crash)


def test_drawdown_peak_and_performance(spark):
    rows = spark.createDataFrame([(0, "k", -1.0), (1, "k", 1.0), (2, "k", -0.5), (3, "k", 2.0)], "bar long, k string, pnl double")
    assert [r["drawdown"] for r in results.drawdown(rows, ["k"]).orderBy("bar").collect()] == [0, 0, 0.5, 0]
    assert [r["drawdown"] for r in results.drawdown(rows, ["k"], from_zero=True).orderBy("bar").collect()] == [1, 0, 0.5, 0]
    p = results.performance(rows, ["k"], 252).first()
    x = np.array([-1, 1, -0.5, 2])
    assert math.isclose(p["sharpe"], x.mean() / x.std() * math.sqrt(252)) and p["max_drawdown"] == 0.5
    costs = results.performance(results.costed(rows.withColumn("turnover", F.lit(1.0))), ["cost_bps"], 252).orderBy("cost_bps").toPandas()["ann_return"]
    assert costs.is_monotonic_decreasing
    flat = results.performance(rows.withColumn("pnl", F.lit(0.0)), ["k"], 252).first()
    assert flat["sharpe"] is None


def test_bootstrap_equals_direct_draws(spark):
    x = np.random.default_rng(3).normal(0.02, 0.05, 130)
    x[:7] = np.nan
    rows = spark.createDataFrame([(i, None if v != v else float(v)) for i, v in enumerate(x)], "bar long, pnl double")
    got = results.boot_sharpe(results.block_bootstrap(rows, ["pnl"], 24, 12), "pnl", 252).orderBy("boot").toPandas()["sharpe"]
    for b in range(12):
        at = np.concatenate([np.arange(24) + (b * 7919 + k * 104729) % (130 - 24 + 1) for k in range(6)])[:130]
        y = x[at]
        assert math.isclose(got[b], np.nanmean(y) / np.nanstd(y) * math.sqrt(252), rel_tol=1e-7)


def test_deflated_sharpe_is_monotonic(spark):
    rows = spark.createDataFrame([(0.01, 1000), (0.05, 1000), (0.1, 1000)], "sharpe_bar double, n long")
    few = [r["dsr"] for r in results.deflated(rows, 1, 0.02).orderBy("sharpe_bar").collect()]
    many = [r["dsr"] for r in results.deflated(rows, 50, 0.02).orderBy("sharpe_bar").collect()]
    assert few == sorted(few) and all(a > b for a, b in zip(few, many, strict=True)) and stats.expected_max_sharpe(1, 1) == 0


def test_garch_recovers_parameters():
    x = models.simulate_garch(3e-5, 0.08, 0.90, 3000, 3e-4, 1)
    m = models.fit_garch(x)
    assert 0.03 < m["alpha"] < 0.16 and 0.8 < m["beta"] < 0.96
    true = -0.5 * (np.log(2 * np.pi) + np.log(v := models.variances((x - x.mean()) ** 2, 3e-5, 0.08, 0.90)) + (x - x.mean()) ** 2 / v).sum()
    assert m["loglik"] >= true - 0.5
    f = models.forecast(x, m, 200)
    assert abs(f[-1] - m["omega"] / (1 - m["alpha"] - m["beta"])) < abs(f[0] - m["omega"] / (1 - m["alpha"] - m["beta"])) + 1e-12


def test_calibration_widens_with_cost():
    free, dear = models.calibrate_entry(0.05, 0.01, 0.0), models.calibrate_entry(0.05, 0.01, 0.05)
    assert 0.25 < free[0] < 3 and dear[0] > free[0] and models.calibrate_entry(-1, 0.1, 0) is None
    paths = models.simulate_ou(0.05, 1, 2000, 400)
    assert abs(paths[:, 500:].var() / (1 / (1 - 0.95**2)) - 1) < 0.1


def test_factor_residuals(spark):
    at = hourly_index(60)
    n, rng = len(at), np.random.default_rng(0)
    market = rng.normal(0, 0.01, n)
    series = {f"T{k}": np.exp(4 + np.cumsum(market * rng.uniform(0.5, 1.5) + rng.normal(0, 0.002, n))) for k in range(10)}
    rows = panel.indexed(long(spark, at, **series)).select("symbol", "bar", indicators.log_return().alias("ret"))
    out = factors.residuals(rows, 300, 200, 45, 1, 8)
    wide = out.toPandas().pivot(index="bar", columns="symbol", values="resid")
    raw = rows.toPandas().pivot(index="bar", columns="symbol", values="ret").loc[wide.index]
    off = ~np.eye(10, dtype=bool)
    assert len(wide) == n - 300 and np.abs(wide.corr().values[off]).mean() < 0.5 * np.abs(raw.corr().values[off]).mean()
    arb = factors.stat_arb(out).toPandas()
    assert set(arb["position"]) <= {-1.0, 0.0, 1.0} and (arb["n_open"] >= 0).all()
    assert factors.residuals(rows.where("symbol < 'T3'"), 300, 200, 45, 1, 8).count() == 0


@pytest.mark.parametrize("sep,decimal", [(";", ","), (",", "."), ("\t", ".")])
def test_importer_reads_dialects(spark, tmp_path, sep, decimal):
    num = lambda v: f"{v:.2f}".replace(".", decimal)
    wide = sep.join(["Date", "aaa", "bbb"]) + "\n" + "".join(sep.join([f"0{k + 1}.02.2024 10:00", num(10.5 + k), num(20 + k) if k else ""]) + "\n" for k in range(3))
    (tmp_path / "wide.csv").write_text(wide)
    got = importer.load_panel(spark, str(tmp_path / "wide.csv")).orderBy("symbol", "ts").collect()
    assert [(r["symbol"], r["ts"].day, r["close"]) for r in got] == [("AAA", 1, 10.5), ("AAA", 2, 11.5), ("AAA", 3, 12.5), ("BBB", 2, 21.0), ("BBB", 3, 22.0)]
    tidy = sep.join(["Tarih", "Sembol", "Kapanis"]) + "\n" + sep.join(["2024-02-01", " x ", num(1)]) + "\n" + sep.join(["2024-02-01", "X", num(2)]) + "\n" + sep.join(["bad", "X", num(3)]) + "\n"
    (tmp_path / "tidy.csv").write_text(tidy)
    got = importer.load_panel(spark, str(tmp_path / "tidy.csv")).collect()
    assert [(r["symbol"], r["close"]) for r in got] == [("X", 2.0)]


def test_importer_reads_folders_and_times(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for k in ("thyao", "akbnk"):
        (tmp_path / "f" / f"{k}.txt").write_text("Tarih,Saat,Kapanis\n01.02.2024,10:00,1.5\n01.02.2024,11:00,2.5\n")
    got = importer.load_panel(spark, str(tmp_path / "f")).orderBy("symbol", "ts").collect()
    assert [(r["symbol"], r["ts"].hour, r["close"]) for r in got] == [("AKBNK", 10, 1.5), ("AKBNK", 11, 2.5), ("THYAO", 10, 1.5), ("THYAO", 11, 2.5)]
    panel_path = str(tmp_path / "saved")
    importer.save_panel(importer.load_panel(spark, str(tmp_path / "f")), panel_path)
    assert spark.read.parquet(panel_path).count() == 4


def test_importer_refuses_short_panels(spark):
    with pytest.raises(ValueError):
        importer.check(long(spark, hourly_index(2), A=np.ones(18)))
    with pytest.raises(ValueError):
        importer.dialect([])


def test_streams_close_bars_once(spark, tmp_path, small):
    ticks = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = str(tmp_path / "ticks"), str(tmp_path / "bars")
    ticks.orderBy("ts").coalesce(1).write.parquet(src)
    stream = bar_stream(spark.readStream.schema(ticks.schema).parquet(src), "event_type", "ts", "value")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = bar_stream(ticks, "event_type", "ts", "value").where(F.col("ts") < got.agg(F.max("ts")).first()[0])
    assert want.join(got, ["symbol", "ts", "open", "close", "volume"], "left_anti").count() == 0 and got.count() == got.select("symbol", "ts").distinct().count()
    assert session_stream(ticks, "event_type", "ts", "value").agg(F.sum("n")).first()[0] == ticks.count()
    orders = []
    bars = spark.readStream.schema(got.schema).parquet(out)
    q = rotate(bars, Rotator(3, 2, 4, 5, 2, 1000.0, orders.extend), str(tmp_path / "rotation"))
    q.processAllAvailable()
    q.stop()
    held = {}
    for _, s, side, k in orders:
        held[s] = held.get(s, 0) + (k if side == "buy" else -k)
    assert orders and all(v >= 0 for v in held.values())


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda v: v.item() if hasattr(v, "item") else v)
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, small, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    if name in registry.ORACLE:
        db = duckdb.connect()
        for f in glob.glob(f"{small}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        assert _norm(got) == _norm(db.sql(registry.ORACLE[name]).df())


def test_entry_works_without_the_llm_subpackage():
    code = "import sys; sys.modules['barflow.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 60 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_amounts_use_whole_shares_and_survive_missing_prices(spark):
    from barflow.operators import sizing

    trades = spark.createDataFrame([("A", 1, 3), ("B", 1, 9)], "symbol string, entry long, exit long")
    prices = spark.createDataFrame([("A", 1, 30.0), ("A", 3, 40.0), ("B", 1, 7.0)], "symbol string, bar long, close double")
    held = spark.createDataFrame([(1, 2)], "bar long, n_held long")
    out = {r["symbol"]: r for r in sizing.amounts(trades, held, prices, sizing.dollar_per_unit(1000.0, 1.0)).collect()}
    assert out["A"]["amount"] == 500 and out["A"]["shares"] == 16 and out["B"]["exit_price"] is None and out["B"]["shares"] == 71
    scaled = spark.createDataFrame([(1, 0.5)], "bar long, scale double")
    assert {r["amount"] for r in sizing.amounts(trades, scaled, prices, 1000.0).collect()} == {500.0}
    assert sizing.dollar_per_unit(90.0, 3.0) == 30.0


def test_percentiles_skip_unknown_values(spark):
    from barflow.operators import sizing

    rows = spark.createDataFrame([(1, float(v)) for v in range(101)] + [(1, math.nan), (1, None)], "k long, v double")
    r = sizing.percentiles(rows, ["k"], "v").first()
    assert (r["lo"], r["p05"], r["p50"], r["p95"], r["hi"]) == (0, 5, 50, 95, 100)


def test_verdicts_and_flags(spark):
    from barflow.operators import sizing

    v = spark.createDataFrame([("x", 1.3, -0.2), ("y", 0.8, 0.1)], "variant string, sharpe double, worst double")
    assert [(r["fragile"], r["beats"]) for r in sizing.verdicts(v, 1.0).orderBy("variant").collect()] == [(True, True), (False, False)]
    perf = spark.createDataFrame([("p", 3.5), ("q", None)], "k string, sharpe double")
    flags = sizing.red_flags(perf, spark.createDataFrame([("p", True)], "k string, unstable boolean"), ["k"]).orderBy("k").collect()
    assert [(r["too_good"], r["unstable"]) for r in flags] == [(True, True), (False, False)]


def test_nan_prices_become_unknown(spark):
    from barflow.sources.bars import without_nan

    rows = spark.createDataFrame([("A", math.nan), ("A", 2.0)], "symbol string, close double")
    assert without_nan(rows).agg(F.avg("close")).first()[0] == 2.0


def test_runs_are_deterministic(spark, small):
    for name in ("pair_screen_full", "momentum_trades", "ou_moments"):
        a, b = (sorted(map(repr, registry.QUERIES[name](spark, small).collect())) for _ in range(2))
        assert a == b


def test_times_with_offsets(spark):
    from barflow.sources.importer import moment

    texts = ["2024-03-01 10:00:00+03:00", "2024-03-01T10:00:00Z", "2024-03-01 10:00", "01.03.2024 10:00 -0530", "01.03.2024", "2024-03-01", "soon", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    shown = lambda c: [str(r[0]) if r[0] else None for r in df.select(c.cast("timestamp_ntz")).collect()]
    c = F.col("t")
    day = "2024-03-01 "
    assert shown(moment(c)) == [day + "07:00:00", day + "10:00:00", day + "10:00:00", day + "15:30:00", day + "00:00:00", day + "00:00:00", None, None]
    assert shown(moment(c, "Europe/Istanbul")) == [day + "07:00:00", day + "10:00:00", day + "07:00:00", day + "15:30:00", "2024-02-29 21:00:00", "2024-02-29 21:00:00", None, None]
    assert shown(moment(c, drop_offset=True))[:4] == [day + "10:00:00"] * 4


def test_files_without_times_are_refused(spark, tmp_path):
    from barflow.sources.importer import load_panel, one_symbol, unread

    (tmp_path / "bad.csv").write_text("date,AAA\nsoon,1.5\nlater,2.5\n")
    with pytest.raises(ValueError, match="no time"):
        load_panel(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "good.csv").write_text("date,AAA,BBB\n2024-01-01 10:00:00+03:00,1.5,\nsoon,2.5,3\n")
    out = load_panel(spark, str(tmp_path / "good.csv"))
    assert [(r["symbol"], str(r["ts"]), r["close"]) for r in out.collect()] == [("AAA", "2024-01-01 07:00:00", 1.5)]
    assert [(r["rows"], r["without_time"]) for r in unread(spark, str(tmp_path / "good.csv"), "date").collect()] == [(2, 1)]
    assert one_symbol(out, "AAA").count() == 1
    with pytest.raises(ValueError):
        one_symbol(out, "BBB")


def test_trade_summary_and_numbers(spark):
    from barflow.operators import results

    rows = [("x", "2024-01-02 10:00:00", 3, 2.0), ("y", "2024-01-01 09:00:00", 1, -1.0), ("x", "2024-01-01 09:00:00", 2, 0.0), ("y", "2024-01-02 08:00:00", 4, 5.0)]
    t = spark.createDataFrame(rows, "k string, entry_ts string, hold_bars int, pnl double").withColumn("entry_ts", F.col("entry_ts").cast("timestamp"))
    assert tuple(results.summary(t).first()) == (4, 0.5, 2.5, 5.0, -1.0)
    assert {(r["number"], r["k"], r["pnl"]) for r in results.numbered(t, ["k"]).collect()} == {(1, "x", 0.0), (2, "y", -1.0), (3, "y", 5.0), (4, "x", 2.0)}
    assert results.summary(t.where("false")).first()["n"] == 0
