"""Bootstrap draws against plain resamples, over keys, chunks, gaps and unknown values."""

import hashlib
import math
import random

import numpy as np
import pytest

from barflow.operators import resampling


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_draws_against_resampled_rows(spark, chunk):
    rnd = random.Random(11)
    series = {("a", 1): 50, ("a", 2): 9, ("b", 1): 3, (None, 1): 20}
    rows = [(*k, t * 3 + rnd.randrange(3), rnd.gauss(0, 1) if rnd.random() > 0.1 else None, rnd.gauss(1, 2)) for k, n in series.items() for t in range(n)]
    df = spark.createDataFrame(rows, "k string, j long, bar long, x double, y double").where("k IS NOT NULL").repartition(5)
    got = {(r.k, r.j, r.boot): r for r in resampling.draws(df, ["k", "j"], ["x", "y"], 6, 15, chunk=chunk).collect()}
    assert len(got) == 3 * 15
    for (k, j), n in series.items():
        if k is None:
            continue
        own = sorted((r[2:] for r in rows if r[:2] == (k, j)))
        size = min(6, n)
        for boot in range(15):
            at = []
            for b in range(-(-n // size)):
                first = int(hashlib.md5(f"{k}|{j}|{boot}|{b}".encode()).hexdigest()[:8], 16) % (n - size + 1)
                at += range(first, first + size)
            for c, col in (("x", 1), ("y", 2)):
                v = [own[i][col] for i in at[:n] if own[i][col] is not None]
                r = got[(k, j, boot)]
                assert r[f"c_{c}"] == len(v) and r[f"s_{c}"] == pytest.approx(sum(v), abs=1e-9) and r[f"q_{c}"] == pytest.approx(sum(z * z for z in v), abs=1e-9)


def test_pairs_share_their_draws_and_empty_series_give_none(spark):
    rows = [("p", t, math.sin(t), 2 * math.sin(t)) for t in range(60)]
    df = spark.createDataFrame(rows, "k string, bar long, x double, y double")
    out = resampling.paired(df, ["k"], "x", "y", 10, 40, 252.0).collect()
    assert len(out) == 40 and all(abs(r["diff"]) < 1e-9 and r["lower"] for r in out)
    one = resampling.interval(resampling.paired(df, ["k"], "x", "y", 10, 40, 252.0), ["k"]).first()
    assert one["p_vol_lower"] == 1.0 and abs(one["mid"]) < 1e-9
    assert not resampling.draws(df.where("false"), ["k"], ["x"], 10, 5).count()
    flat = resampling.moments(resampling.draws(df.selectExpr("k", "bar", "1.0 AS x"), ["k"], ["x"], 10, 5), ["k"], "x", 252.0)
    s = resampling.significance(flat, ["k"]).first()
    assert s["degenerate"] == 5 and s["p_positive"] == 0.0 and s["p50"] is None


def test_quantiles_are_those_of_plain_draws(spark):
    x = np.random.default_rng(5).normal(0.1, 1, 80)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, bar long, x double")
    s = resampling.moments(resampling.draws(df, ["k"], ["x"], 8, 100), ["k"], "x", 252.0)
    v = [r.sharpe for r in s.collect()]
    got = resampling.significance(s, ["k"]).first()
    assert got.p05 == pytest.approx(np.percentile(v, 5)) and got.p_positive == pytest.approx(np.mean(np.array(v) > 0))
