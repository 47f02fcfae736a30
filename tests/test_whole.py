"""Queries that must do their whole job: every pair, session, start, rule and draw."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.functions import models
from barflow.operators import pairs, panel, rotation
from barflow.plans import registry
from barflow.sources.bars import hourly


@pytest.fixture
def events(tmp_path):
    """Writes one tick an hour for each name, and gives the folder."""

    def write(days, names=("AAA", "BBB", "CCC"), per_day=24, seed=0):
        at = [d + pd.Timedelta(hours=h) for d in pd.date_range("2024-01-01", periods=days) for h in range(per_day)]
        rng = np.random.default_rng(seed)
        common = np.cumsum(rng.normal(0, 0.01, len(at)))
        rows = [pd.DataFrame({"event_type": s, "ts": at, "value": np.exp(4 + common * (1 - 0.2 * k) + models.simulate_ou(0.2, 0.01, len(at), 1, seed + k)[0])}) for k, s in enumerate(names)]
        pd.concat(rows).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
        return str(tmp_path)

    return write


def test_garch_scale_covers_every_pair(spark, events):
    d = events(17)
    got = registry.intraday_garch_scale(spark, d).toPandas()
    rows = registry._intraday(spark, d)[0].select("a", "b", "i", "sess", "change").toPandas()
    want = {}
    for key, p in rows.groupby(["a", "b"]):
        p = p.sort_values("i")
        sessions = [g for _, g in p.groupby("sess")]
        sigma, model = [np.full(len(sessions[0]), np.nan)], None
        for k in range(1, len(sessions)):
            past = np.concatenate([g["change"].to_numpy() for g in sessions[max(0, k - 5) : k]])
            if len(past) >= 30 and past.std() > 0:
                model = models.fit_garch(past, constant=False)
            sigma.append(np.sqrt(models.forecast(past, model, len(sessions[k]))) if model else np.full(len(sessions[k]), np.nan))
        sigma = np.concatenate(sigma)
        scale = np.where(np.isnan(sigma), 1.0, np.clip(np.nanmedian(sigma) / sigma, 0.2, 3.0))
        want |= {(*key, i): s for i, s in zip(p["i"], scale, strict=True)}
    assert {k[:2] for k in want} == {("AAA", "BBB"), ("AAA", "CCC"), ("BBB", "CCC")} and len(got) == len(want)
    assert all(abs(r.scale - want[r.a, r.b, r.i]) < 2e-6 for r in got.itertuples())


@pytest.mark.parametrize("days,inside", [(10, 6), (45, 27)])
def test_intraday_screen_splits_where_the_panel_says(spark, events, days, inside):
    d = events(days)
    got = registry.pair_screen_intraday(spark, d).toPandas().set_index("pair")
    rows = panel.pairs(hourly(spark, d)).where(F.col("ts") < F.lit(pd.Timestamp("2024-01-01") + pd.Timedelta(days=inside)))
    want = pairs.screen(rows).toPandas().set_index("pair")
    assert len(got) == 3 and np.allclose(got["adf_stat"], want.loc[got.index, "adf_stat"], atol=2e-6) and np.allclose(got["beta"], want.loc[got.index, "beta"], atol=2e-6)


def test_start_sweep_reaches_the_end_of_the_panel(spark, events):
    d = events(60)
    got = registry.start_date_sweep_full(spark, d).toPandas().sort_values("start").reset_index(drop=True)
    bars = 60 * 24
    want = np.linspace(25, bars - 400, num=min(24, (bars - 425) // 45)).astype(int).tolist()
    assert got["start"].tolist() == want and got["n"].tolist() == [bars - s for s in want] and len(want) == 22
    for s in (want[0], want[11], want[-1]):
        one = registry.results.performance(registry.Rotation(spark, d, start=s).pnl(), ["phase"], registry.PER_YEAR).first()
        row = got[got["start"] == s].iloc[0]
        assert abs(row["ann_return"] - one["ann_return"]) < 2e-6 and abs(row["sharpe"] - one["sharpe"]) < 2e-6
    assert rotation.sweep_starts(425, 20) == [] and len(rotation.sweep_starts(100_000, 20)) == 24


def test_variant_summary_has_every_rule_and_the_benchmark(spark, events):
    d = events(20, ("AAA", "BBB", "CCC", "DDD"))
    got = registry.variant_summary(spark, d).toPandas().set_index("variant")
    assert set(got.index) == {*rotation.variants(), "buy_and_hold"}
    mask, score = rotation.variants()["ma_and_di"]
    x = registry.Rotation(spark, d, phases=registry.EVERY, score=score, mask=F.coalesce(mask, F.lit(False)), extra=registry._features)
    p = x.pnl().where(F.col("bar") >= x.start + registry.EVERY).groupBy("bar").agg(F.avg("pnl").alias("pnl"), F.avg("n_held").alias("held")).toPandas()
    one = got.loc["ma_and_di"]
    assert abs(one["ann_return"] - p["pnl"].mean() * registry.PER_YEAR) < 2e-6 and abs(one["held"] - p["held"].mean()) < 2e-6
    hold = rotation.buy_and_hold(x.signal, x.start).toPandas()["pnl"]
    assert abs(got.loc["buy_and_hold", "ann_return"] - hold.mean() * registry.PER_YEAR) < 2e-6 and got.loc["buy_and_hold", "held"] == 4


def test_draws_are_those_of_the_reference(spark, events):
    d = events(20)
    p = registry.permutation_significance(spark, d).first()
    totals = registry._permuted(registry.Rotation(spark, d), 400).toPandas()["total"]
    real = registry.Rotation(spark, d).pnl().agg(F.sum("pnl")).first()[0]
    assert p["sims"] == len(totals) == 400 and abs(p["p_value"] - (totals >= real - 1e-12).mean()) < 2e-6 and abs(p["real"] - real) < 2e-6
    sharpes = registry.block_bootstrap_full(spark, d).toPandas()["sharpe"]
    assert len(sharpes) == 2000 and sharpes.nunique() > 1900 and registry.paired_bootstrap_full(spark, d).count() == 5000
    got = registry.ou_calibration(spark, d).toPandas()
    fit = registry.stats.changes(pairs.spreads(registry.joint(spark, d)), ["a", "b"], "spread").groupBy("a", "b").agg(*registry.stats.unit_root()).toPandas()
    want = {(f.a, f.b): models.calibrate_entry(-f.gamma, f.sigma, 5e-4, sims=300) for f in fit.itertuples()}
    assert len(got) == 3 and all(g.entry_z == want[g.a, g.b][0] and abs(g.expected - want[g.a, g.b][1]) < 2e-6 for g in got.itertuples())
