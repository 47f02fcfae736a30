"""The factor book's trades against a loop over bars."""

import random

import numpy as np
import pytest

from barflow.operators import factors


def plain(rows, window, least, last):
    """Bars in order; a bar's profit is shared by the names open before it."""
    cum, seen, position, entry, log, part = {}, {}, {}, {}, [], {}
    for bar in sorted({b for _, b, _ in rows}):
        here = {s: x for s, b, x in rows if b == bar}
        weight, z = 1 / max(len(position), 1), {}
        for s, x in here.items():
            cum[s] = cum.get(s, 0.0) + x
            seen.setdefault(s, []).append(cum[s])
            v = np.array(seen[s][-window:])
            z[s] = (v[-1] - v.mean()) / v.std() if len(v) >= least and v.std() > 0 else 0.0
            if s in position:
                part[(s, bar)] = position[s] * x * weight
        for s in here:
            if s not in position:
                if abs(z[s]) > 1.5:
                    position[s], entry[s] = -np.sign(z[s]), (bar, z[s])
            elif position[s] * z[s] >= 0 or abs(z[s]) > 3.5:
                log.append((s, entry[s][0], bar, "long" if position[s] > 0 else "short", entry[s][1], z[s], "reversion" if position[s] * z[s] >= 0 else "hard stop"))
                del position[s], entry[s]
    log += [(s, t, last, "long" if position[s] > 0 else "short", z0, None, "end of backtest") for s, (t, z0) in entry.items()]
    return {(s, a): (b, side, z0, z1, why, sum(part.get((s, t), 0.0) for t in range(a + 1, b + 1))) for s, a, b, side, z0, z1, why in log}


@pytest.mark.parametrize("seed", [1, 2])
def test_trades_against_a_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"s{k}", t, rnd.gauss(0, 1)) for k in range(4) for t in range(120) if not (k == 1 and 50 <= t < 80) and not (k == 2 and t > 90)]
    book = factors.stat_arb(spark.createDataFrame(rows, "symbol string, bar long, resid double"), 20, 8)
    got = {(r.symbol, r.entry): r for r in factors.trades(book, 130).collect()}
    want = plain(rows, 20, 8, 130)
    assert got.keys() == want.keys() and len(want) > 15 and any(w[4] == "end of backtest" for w in want.values())
    for k, (exit_, side, z0, z1, why, pnl) in want.items():
        g = got[k]
        assert (g.exit, g.direction, g.exit_reason, g.hold_bars) == (exit_, side, why, exit_ - k[1])
        assert g.entry_z == pytest.approx(z0) and g.pnl == pytest.approx(pnl, abs=1e-12) and (g.exit_z == pytest.approx(z1) if z1 is not None else g.exit_z is None)
