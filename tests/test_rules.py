"""Rules over their windows and thresholds: one plan for all settings equals one plan for each."""

import random

from pyspark.sql import functions as F

from barflow.operators import indicators, rotation


def signal(spark):
    rnd, rows = random.Random(6), []
    for k in range(5):
        for t in range(90):
            if rnd.random() > 0.1:
                rows.append((f"s{k}", t, rnd.gauss(0, 0.01), rnd.choice([None, rnd.gauss(0, 1)]), rnd.random() > 0.3, rnd.random(), *(rnd.choice([None, rnd.uniform(0, 40)]) for _ in range(9)), *(rnd.choice([None, rnd.uniform(0.4, 0.7)]) for _ in range(3))))
    names = ", ".join(f"{c}_{w} double" for w in (14, 45, 126) for c in ("plus_di", "minus_di", "adx")) + ", " + ", ".join(f"hurst_{w} double" for w in (150, 250, 400))
    return spark.createDataFrame(rows, f"symbol string, bar long, ret double, roc double, ok boolean, vol double, {names}").cache()


def test_settings_of_each_rule(spark):
    of = rotation.cells()
    assert len(of) == 91 and len({(c.variant, c.di, c.hurst, c.level) for c in of}) == 91
    grid = [c for c in of if c.grid]
    assert len(grid) == 81 and {c.variant for c in of if c.own} == set(rotation.rules())
    near = {v: sum(c.near for c in of if c.variant == v) for v in rotation.rules()}
    assert near == {"baseline": 1, "risk_adjusted": 1, "di_gate": 3, "ma_and_di": 3, "rank_by_di": 3, "risk_adjusted_di": 3, "ma_and_adx": 12, "ma_di_adx": 12, "rank_by_adx_weighted": 12, "ma_and_hurst": 4, "hurst_and_di": 12}


def test_cells_equal_one_plan_for_each(spark):
    s, of = signal(spark), rotation.cells()
    got = {}
    for r in rotation.cell_baskets(s, of, 30, 6, 2, 90).collect():
        got.setdefault(r.cell, set()).add((r.phase, r.t0, r.symbol, r.weight))
    for k in (0, 1, 5, 11, 17, 24, 40, 60, 75, 88):
        c = of[k]
        mask, score, gate = rotation.rules(f"_{c.di}" if c.di else "", f"_{c.hurst}" if c.hurst else "")[c.variant]
        mask = F.coalesce(mask if gate is None else mask & (gate >= c.level), F.lit(False))
        want = rotation.baskets(s, score, mask, 30, 6, 2, 90, phases=6).where("t0 >= 30").collect()
        assert got.get(k, set()) >= {(r.phase, r.t0, r.symbol, r.weight) for r in want} and {x for x in got.get(k, set()) if x[1] >= 30 + x[0]} == {(r.phase, r.t0, r.symbol, r.weight) for r in want}, c


def test_all_windows_in_one_pass(spark):
    rnd, rows = random.Random(4), []
    for k in range(2):
        for t in range(60):
            if rnd.random() > 0.1:
                p = 10 + rnd.random()
                rows.append((f"s{k}", t, p + 0.1, p - 0.1, p))
    bars = spark.createDataFrame(rows, "symbol string, bar long, high double, low double, close double").cache()
    both = {(r.symbol, r.bar): r for r in indicators.dmi_windows(bars, (5, 14)).collect()}
    for w in (5, 14):
        for r in indicators.dmi(bars, w, "panel").collect():
            x = both[(r.symbol, r.bar)]
            assert (x[f"plus_di_{w}"], x[f"minus_di_{w}"], x[f"adx_{w}"]) == (r.plus_di, r.minus_di, r.adx)
