"""The volatility book's walk forward against a plain loop over sessions and bars."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions import stats
from barflow.operators import backtests, indicators, panel, volatility
from barflow.sources.bars import hourly

P = volatility.VolParams(window=4, lookback=3, z_window=8, least=3)


def plain_unit_root(x, sess):
    y0 = [a for a, s, t in zip(x, sess, sess[1:]) if s == t]
    dy = [b - a for a, b, s, t in zip(x, x[1:], sess, sess[1:]) if s == t]
    if len(y0) < 3:
        return len(y0), None
    m = np.column_stack([np.ones(len(y0)), y0])
    beta, *_ = np.linalg.lstsq(m, np.array(dy), rcond=None)
    e = np.array(dy) - m @ beta
    sxx = np.var(y0) * len(y0)
    return len(y0), beta[1] / math.sqrt(e @ e / (len(y0) - 2) / sxx)


@pytest.fixture(scope="module")
def bars(spark):
    rnd, out = random.Random(8), []
    for k in range(3):
        level, vol = 3.0, 0.01
        for d in range(14):
            for h in range(9):
                vol = 0.004 + 0.7 * vol + 0.01 * rnd.random()
                level += rnd.gauss(0, vol)
                if not (k == 1 and rnd.random() < 0.2) and not (k == 2 and d in (3, 4)):
                    out.append((f"s{k}", f"2024-02-{d + 1:02d} {h:02d}:00:00", math.exp(level) * 1.01, math.exp(level) * 0.99, math.exp(level)))
    return spark.createDataFrame(out, "symbol string, ts string, high double, low double, close double").withColumn("ts", F.to_timestamp_ntz("ts")).cache()


def test_regimes_against_unfolded_windows(bars):
    x = indicators.realized_vol(panel.indexed(bars), P.window)
    rows = sorted(x.select("symbol", "sess", "bar", "rv").collect())
    got = {(r.symbol, r.sess): r for r in volatility.regimes(x, P).collect()}
    assert len(got) == len({(r.symbol, r.sess) for r in rows})
    checked = 0
    for (symbol, s), g in got.items():
        win = [(r.rv, r.sess) for r in rows if r.symbol == symbol and s - P.lookback <= r.sess < s and r.rv is not None]
        n, tau = plain_unit_root([v for v, _ in win], [q for _, q in win])
        h = stats.hurst(np.array([v for v, _ in win])) if len(win) > 2 else math.nan
        assert g.n == n and (g.tau is None) == (tau is None) and (g.h is None) == math.isnan(h), (symbol, s)
        if tau is not None:
            assert g.tau == pytest.approx(tau, rel=1e-9)
        if not math.isnan(h):
            assert g.h == pytest.approx(h, rel=1e-8)
            checked += 1
        assert g.qualified == bool(tau is not None and not math.isnan(h) and tau < P.critical and h < P.cutoff + P.slack)
    assert checked > 20


def test_book_against_a_loop_over_bars(bars):
    got = volatility.book(bars, P)
    rows = sorted(got.book.collect(), key=lambda r: (r.symbol, r.bar))
    all_rows = sorted(indicators.realized_vol(panel.indexed(bars), P.window).collect(), key=lambda r: (r.symbol, r.bar))
    for symbol in ("s0", "s1", "s2"):
        own, every = [r for r in rows if r.symbol == symbol], [r for r in all_rows if r.symbol == symbol]
        assert [r.bar for r in own] == [r.bar for r in every if r.sess >= 8]  # 14 sessions, 0.6 of them in sample
        pos, entry, before, closed = 0.0, None, None, []
        for r in own:
            past = [q for q in every if q.sess == r.sess and q.bar < r.bar][-P.z_window :]
            known = [q.rv for q in past if q.rv is not None]
            z = 0.0
            if r.rv is not None and len(past) >= P.least and len(known) >= P.least and np.std(known) > 0:
                z = float(np.clip((r.rv - np.mean(known)) / np.std(known), -P.limit, P.limit))
            assert r.z == pytest.approx(z, abs=1e-9)
            change = math.log(r.close / before.close) if before else 0.0
            assert r.pnl == pytest.approx(pos * change * r.scale, abs=1e-12)
            why = None
            if not r.qualified:
                why = "regime break" if pos else None
            elif pos == 0.0:
                if z > P.entry and not r.is_last and r.side:
                    pos, entry = r.side, r.bar
            elif z <= P.leave:
                why = "vol normalized"
            elif z > P.stop:
                why = "vol kept expanding"
            if why is None and r.is_last and pos:
                why = "end of day"
            if why:
                closed.append((entry, r.bar, why))
                pos = 0.0
            assert r.position == pos, (symbol, r.bar)
            before = r
        assert sorted((t.entry, t.exit, t.exit_reason) for t in got.trades.where(F.col("symbol") == symbol).collect()) == sorted(closed)
        inside = [(q.sess, math.log(q.close / p.close)) for p, q in zip(every, every[1:]) if p.sess == q.sess and q.bar == p.bar + 1]
        for s in {r.sess for r in own}:
            state = backtests.garch_state(np.array([x for q, x in inside if s - P.lookback <= q < s]), 30)
            for k, r in enumerate([r for r in own if r.sess == s]):
                if state:
                    level = state[0] / (1 - state[1])
                    assert r.sigma == pytest.approx(math.sqrt(level + state[1] ** k * (state[2] - level)), rel=1e-9)
                else:
                    assert r.sigma is None and r.scale == 1.0


def test_volatility_on_no_bars_and_on_the_given_ones(spark, small):
    bars = hourly(spark, small)
    assert not volatility.walk_forward(panel.indexed(bars.where("false")), P).count()
    assert volatility.book(bars, P).book.count()
