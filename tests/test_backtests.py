"""Whole backtests against plain loops, volatility forecasts in closed form, and a rotation that goes on after a restart."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.functions import models, stats
from barflow.operators import backtests, machine, panel
from barflow.session import drop_stored
from barflow.streaming.bars import Rotator, orders_of, rotate


@pytest.fixture(scope="module")
def prices(spark):
    """Three symbols of 8 hours on 40 days; A and B revert to each other, C wanders."""
    at = [d + pd.Timedelta(hours=9 + h) for d in pd.date_range("2024-01-01", periods=40) for h in range(8)]
    rng = np.random.default_rng(3)
    base = np.cumsum(rng.normal(0, 0.01, len(at)))
    logs = {"A": 3 + base, "B": 3 + 0.8 * base + models.simulate_ou(0.3, 0.01, len(at), 1, 1)[0], "C": 2 + np.cumsum(rng.normal(0, 0.01, len(at)))}
    rows = pd.concat(pd.DataFrame({"symbol": s, "ts": at, "close": np.exp(x)}) for s, x in logs.items())
    return spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def line(y, x):
    b = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return y.mean() - b * x.mean(), b


def test_mean_reversion_equals_a_loop(spark, prices):
    p = backtests.PairParams(top=None, lookback=8, cost_bps=5.0)
    got = backtests.mean_reversion(prices, p).book.toPandas()
    rows = panel.pairs(prices).toPandas()
    assert {tuple(k) for k in got[["a", "b"]].drop_duplicates().values} == {("A", "B"), ("A", "C"), ("B", "C")}
    for (a, b), x in rows.groupby(["a", "b"]):
        x = x.sort_values("i")
        la, lb, sess = np.log(x["pa"].to_numpy()), np.log(x["pb"].to_numpy()), x["sess"].to_numpy()
        split, want = int((sess.max() + 1) * 0.6), []
        fit = None
        for t in np.flatnonzero(sess >= split):
            if (sess[t] - split) % p.every == 0 and sess[t] != sess[t - 1]:
                m = (sess >= sess[t] - p.lookback) & (sess < sess[t])
                alpha, beta = line(la[m], lb[m])
                y = la[m] - beta * lb[m] - alpha
                same = np.diff(sess[m]) == 0
                d, y0 = np.diff(y)[same], y[:-1][same]
                g = line(d, y0)[1]
                e = d - d.mean() - g * (y0 - y0.mean())
                tau = g / np.sqrt((e @ e) / (len(d) - 2) / ((y0 - y0.mean()) ** 2).sum())
                half = np.log(2) / -g if g < 0 else None
                ok = tau < p.critical and stats.hurst(y) < 0.5 and half is not None
                zw = min(max(round(3 * half), 10), 500) if half else 500
                found = models.calibrate_entry(-g, np.sqrt((e @ e) / len(d)), 5e-4) if ok else None
                fit = alpha, beta, ok, zw, found[0] if found else np.nan
            alpha, beta, ok, zw, entry = fit
            w = slice(max(0, t - zw), t)
            y = la[w] - beta * lb[w]
            want.append(((la[t] - beta * lb[t] - y.mean()) / y.std(), ok, entry))
        z, ok, entry = (np.array(c) for c in zip(*want, strict=True))
        g = got[(got["a"] == a) & (got["b"] == b)].sort_values("i")
        assert np.allclose(g["z"], z, atol=1e-6) and (g["qualified"].to_numpy(bool) == ok).all() and np.allclose(g["entry_z"].to_numpy(float), entry, equal_nan=True)
        rule = machine.Rule()
        none = np.zeros(len(z))
        assert (g["position"].to_numpy() == machine.fold(z, ok, none.astype(bool), none, rule, entry.astype(float), entry.astype(float) * 3.5 / 1.5)[0]).all()
    assert got["entry_z"].notna().any()


def test_pairs_are_chosen_in_sample(spark, prices):
    b = backtests.mean_reversion(prices, backtests.PairParams(top=1))
    assert b.book.select("a", "b").distinct().collect()[0][:] == ("A", "B") and b.book.select("a", "b").distinct().count() == 1
    s = b.stats(252.0 * 8).first()
    assert s["n"] == 16 * 8 and s["n_trades"] == b.trades.count() > 0 and b.costs(252.0).count() == 6
    named = backtests.mean_reversion(prices, pair=("C", "A"))
    assert {tuple(r) for r in named.book.select("a", "b").distinct().collect()} == {("A", "C")}
    ended = b.trades.agg(F.sum("pnl")).first()[0]
    assert ended is not None
    e = backtests.evaluate(prices, lambda x: backtests.mean_reversion(x, backtests.PairParams(top=None)), 252.0).first()
    assert e["units"] == 3 and 0 <= e["pct_profitable"] <= 100
    flat = prices.where("symbol = 'A'")
    assert backtests.mean_reversion(flat).stats(252.0).count() == 0
    drop_stored(spark)


def test_forecasts_in_closed_form(spark):
    x = models.simulate_garch(1e-5, 0.1, 0.8, 400, seed=2)
    m = models.fit_garch(x, constant=False)
    omega, persistence, v1 = backtests.garch_state(x)
    rows = spark.range(12).select("id", F.lit(omega).alias("omega"), F.lit(persistence).alias("persistence"), F.lit(v1).alias("v1"))
    got = rows.select(backtests.forecast_deviation(F.col("id")).alias("s")).toPandas()["s"]
    assert np.allclose(got, np.sqrt(models.forecast(x, m, 12))) and backtests.garch_state(x[:10]) is None and backtests.garch_state(np.zeros(50)) is None


def test_intraday_is_flat_at_the_end(spark, prices):
    b = backtests.intraday(prices, backtests.PairParams(lookback=10, every=1, top=None, min_window=2, z_window=6, entry=1.0))
    got = b.book.toPandas()
    assert (got.loc[got["is_last"], "position"] == 0).all() and (got["sess"] >= 24).all() and got["sigma"].notna().all() and len(got) == 3 * 16 * 8
    one = got[(got["a"] == "A") & (got["b"] == "B") & (got["sess"] == 30)].sort_values("i")
    rows = panel.pairs(prices).where("a = 'A' AND b = 'B' AND sess >= 20 AND sess < 30").toPandas().sort_values("i")
    alpha, beta = line(np.log(rows["pa"].to_numpy()), np.log(rows["pb"].to_numpy()))
    y = np.log(rows["pa"].to_numpy()) - beta * np.log(rows["pb"].to_numpy()) - alpha
    d = np.diff(y)[np.diff(rows["sess"].to_numpy()) == 0]
    assert np.allclose(one["sigma"], np.sqrt(models.forecast(d, models.fit_garch(d, constant=False), 8)), rtol=1e-6)


def test_daily_checks_equal_a_loop(spark, prices):
    p = backtests.DailyParams(lookback=60, every=21, top=None)
    got = backtests.daily(prices, p).book.toPandas()
    for (a, b), x in panel.pairs(prices).toPandas().groupby(["a", "b"]):
        x = x.sort_values("i")
        la, lb = np.log(x["pa"].to_numpy()), np.log(x["pb"].to_numpy())
        split = int(len(x) * 0.6)
        g = got[(got["a"] == a) & (got["b"] == b)].sort_values("i").reset_index(drop=True)
        assert len(g) == len(x) - split
        for t in range(split, len(x)):
            w = slice(t - 60, t)
            alpha, beta = line(la[w], lb[w])
            y = la[w] - beta * lb[w] - alpha
            if (t - split) % 21 == 0:
                ok = models.lagged_unit_root(y)[3] < 0.10 and stats.hurst(y) < 0.5
                d = np.diff(y)
                ahead = np.sqrt(models.forecast(d, models.fit_garch(d, constant=False), 21))
            r = g.loc[t - split]
            assert abs(r["z"] - (la[t] - beta * lb[t] - alpha) / y.std()) < 1e-6 and bool(r["qualified"]) == ok and abs(r["sigma"] / ahead[(t - split) % 21] - 1) < 1e-6


def test_rotation_goes_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(0)
    at = pd.date_range("2024-01-01", periods=40, freq="h")
    rows = pd.concat(pd.DataFrame({"symbol": s, "ts": at, "close": np.exp(3 + np.cumsum(rng.normal(0.01, 0.02, 40)))}) for s in "ABCD")
    src, folder = tmp_path / "bars", str(tmp_path / "state")
    src.mkdir()
    schema = "symbol string, ts timestamp, close double"
    kinds = Rotator(3, 2, 4, 5, 2, 1000.0)
    plain = kinds.resumed(None)
    for t, g in rows.groupby("ts"):
        plain.bar(t.to_pydatetime(), dict(zip(g["symbol"], g["close"], strict=True)))

    def feed(name, part):
        part.assign(ts=part["ts"].dt.tz_localize("UTC").astype("datetime64[us, UTC]")).to_parquet(src / f"{name}.parquet")
        q = rotate(spark.readStream.schema(schema).parquet(str(src)), kinds, folder, {"availableNow": True})
        q.awaitTermination(120)
        assert q.exception() is None

    feed("a", rows[rows["ts"] < at[17]])  # each call is a restart
    feed("b", rows[(rows["ts"] == at[17]) & (rows["symbol"] < "C")])  # a bar in two batches is decided once
    feed("c", rows[(rows["ts"] == at[17]) & (rows["symbol"] >= "C")])
    feed("d", rows[rows["ts"] > at[17]])
    got = [(r["symbol"], r["side"], r["shares"]) for r in orders_of(spark, folder).orderBy("ts", "side", "symbol").collect()]
    assert got and sorted(got) == sorted((s, side, n) for _, s, side, n in plain.orders)
    assert orders_of(spark, folder).groupBy("batch").count().count() >= 2
