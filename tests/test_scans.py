"""Recurrences over blocks equal those over whole series, wherever the cuts fall."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import indicators, machine, scans
from barflow.operators.indicators import recurrence


@pytest.mark.parametrize("seed", range(30))
def test_means_composed_over_blocks(seed):
    rnd = random.Random(seed)
    alpha = rnd.choice([0.07, 0.5, 1 / 14])
    x = np.array([np.nan if rnd.random() < rnd.choice([0.1, 0.8]) else rnd.gauss(0, 1) for _ in range(rnd.randint(1, 60))])
    if seed % 3 == 0:
        x[: rnd.randint(0, len(x))] = np.nan
    cuts = sorted({0, len(x), *(rnd.randint(0, len(x)) for _ in range(rnd.randint(0, 8)))})
    y, gap, out = np.nan, 0, []
    for a, b in zip(cuts, cuts[1:]):
        part = x[a:b]
        out.append(scans.replayed_mean(part, alpha, y, gap))
        first, value, slope, offset, rest = scans.mean_map(part, alpha)
        y, gap = (y, gap + rest) if first < 0 else (slope * scans.entered_mean(y, gap, first, value, alpha) + offset, rest)
    np.testing.assert_allclose(np.concatenate(out), recurrence(x, alpha), rtol=1e-12, atol=1e-12)


def same(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, w in want.items():
        for c, v in w.items():
            g = got[k][c]
            assert g == v or (isinstance(v, float) and g is not None and (abs(g - v) < 1e-9 or g != g and v != v)), (k, c, g, v)


@pytest.fixture(scope="module")
def bars(spark):
    rnd, rows = random.Random(2), []
    for k in range(3):
        p = 10.0
        for t in range(150):
            p *= 1 + rnd.gauss(0, 0.02)
            if not (k == 1 and (rnd.random() < 0.3 or 40 <= t < 75)) and not (k == 2 and t < 60):
                rows.append((f"s{k}", t, p * 1.01, p * 0.99, p if rnd.random() > 0.05 else None))
    return spark.createDataFrame(rows, "symbol string, bar long, high double, low double, close double").cache()


@pytest.mark.parametrize("block", [1, 16, 1000])
def test_indicators_over_blocks(bars, block):
    keys = ["symbol", "bar"]
    same(indicators.ema(bars, 12, block=block), indicators.ema(bars, 12), keys)
    same(indicators.macd(bars, block=block), indicators.macd(bars), keys)
    same(indicators.dmi(bars, 14, "panel", block), indicators.dmi(bars, 14, "panel"), keys)


def test_levels_follow_what_means_need():
    steps = [("a", "x", 0.1), ("b", lambda v: v["x"] * 2, 0.2), ("c", lambda v: v["a"] - v["b"], None), ("d", "c", 0.3)]
    assert [[n for n, _, _ in level] for level in scans.levels(steps, ["x"])] == [["a", "b"], ["c", "d"]]


@pytest.mark.parametrize("seed,two_sided,flat", [(1, True, False), (2, True, True), (3, False, True), (4, False, False)])
def test_positions_over_blocks(spark, seed, two_sided, flat):
    rnd = random.Random(seed)
    rows = [
        (k, i, None if rnd.random() < 0.1 else rnd.gauss(0, 2), rnd.random() > 0.1, rnd.random() < 0.1, rnd.choice([-1.0, 0.0, 1.0]), rnd.choice([None, 1.0]), rnd.choice([None, 3.0]))
        for k in range(3) for i in range(0, 120, 1 if k else 3)
    ]
    df = spark.createDataFrame(rows, "k long, i long, z double, qualified boolean, is_last boolean, side double, entry_z double, stop_z double")
    rule = machine.Rule(two_sided=two_sided, flat_at_end=flat)
    for block in (1, 7, 500):
        same(machine.positions(df, ["k"], rule, block=block), machine.positions(df, ["k"], rule), ["k", "i"])
    assert not machine.positions(df.where("false"), ["k"], rule, block=7).count()


def test_one_long_series_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.sin(F.col("id") / 37) * 3).alias("z"))
    same(machine.positions(df, ["k"], machine.Rule(), block=1000), machine.positions(df, ["k"], machine.Rule()), ["k", "i"])
