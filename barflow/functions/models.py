"""Small numeric models: volatility recursion, mean-reverting simulation and calibration, lagged unit-root test."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barflow.session import ship

#: Published response-surface coefficients for the p-value of a unit-root test with constant (fixed values).
_TAU_MIN, _TAU_STAR, _TAU_MAX = -18.83, -1.61, 2.74
_SMALL = (2.1659, 1.4412, 0.038269)
_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
#: Critical values at 1, 5 and 10 per cent: constant, 1/n, 1/n^2, 1/n^3 (fixed values).
_CRITICAL = {1: (-3.43035, -6.5393, -16.786, -79.433), 5: (-2.86154, -2.8903, -4.234, -40.040), 10: (-2.56677, -1.5384, -2.809, 0.0)}


def unit_root_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    c = _SMALL if tau <= _TAU_STAR else _LARGE
    return NormalDist().cdf(sum(a * tau**k for k, a in enumerate(c)))


def unit_root_critical(n: int, level: int = 5) -> float:
    return sum(a / n**k for k, a in enumerate(_CRITICAL[level]))


def lagged_unit_root(x: np.ndarray, extra: int = 1) -> tuple[float, float, float, float]:
    """gamma, its error, tau, p-value: change on constant, level and `extra` earlier changes."""
    d = np.diff(x)
    y = d[extra:]
    m = np.column_stack([np.ones(len(y)), x[extra:-1], *(d[extra - k : len(d) - k] for k in range(1, extra + 1))])
    if len(y) <= m.shape[1]:
        return (float("nan"),) * 4
    beta, *_ = np.linalg.lstsq(m, y, rcond=None)
    e = y - m @ beta
    cov = (e @ e) / (len(y) - m.shape[1]) * np.linalg.pinv(m.T @ m)
    se = math.sqrt(cov[1, 1])
    tau = beta[1] / se if se else float("nan")
    return float(beta[1]), se, float(tau), unit_root_p(tau) if tau == tau else float("nan")


def variances(eps2: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    out = np.empty(len(eps2))
    v = eps2.mean()
    for t, e in enumerate(eps2):
        out[t] = v
        v = omega + alpha * e + beta * v
    return out


def minimum(f, x: np.ndarray, step: float = 0.5, rounds: int = 400, tol: float = 1e-9) -> np.ndarray:
    """Downhill simplex."""
    n = len(x)
    s = np.vstack([x, *(x + step * np.eye(n)[i] for i in range(n))])
    v = np.array([f(p) for p in s])
    for _ in range(rounds):
        o = np.argsort(v)
        s, v = s[o], v[o]
        if abs(v[-1] - v[0]) < tol * (abs(v[0]) + tol):
            break
        mid = s[:-1].mean(axis=0)
        r = mid + (mid - s[-1])
        fr = f(r)
        if fr < v[0]:
            e = mid + 2 * (mid - s[-1])
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            c = mid + 0.5 * ((r if fr < v[-1] else s[-1]) - mid)
            fc = f(c)
            if fc < min(fr, v[-1]):
                s[-1], v[-1] = c, fc
            else:
                s[1:] = s[0] + 0.5 * (s[1:] - s[0])
                v[1:] = [f(p) for p in s[1:]]
    return s[np.argmin(v)]


def fit_garch(x: np.ndarray, constant: bool = True) -> dict[str, float]:
    """Normal likelihood of GARCH(1, 1): mu, omega, alpha, beta, loglik. alpha and beta are kept positive with sum under 1."""
    scale = x.std() or 1.0
    y = (x - (x.mean() if constant else 0.0)) / scale
    e2 = y * y

    def free(p: np.ndarray) -> tuple[float, float, float]:
        total = 0.9999 / (1 + math.exp(-max(min(p[1], 30), -30)))
        part = 1 / (1 + math.exp(-max(min(p[2], 30), -30)))
        return math.exp(max(min(p[0], 10), -30)), total * part, total * (1 - part)

    def loss(p: np.ndarray) -> float:
        v = variances(e2, *free(p))
        return float(0.5 * (np.log(v) + e2 / v).sum())

    best = min((minimum(loss, np.array(p)) for p in ((math.log(0.05), 3.0, -2.2), (math.log(0.3), 1.0, -1.0))), key=loss)
    omega, alpha, beta = free(best)
    ll = -loss(best) - 0.5 * len(x) * math.log(2 * math.pi) - len(x) * math.log(scale)
    return {"mu": float(x.mean()) if constant else 0.0, "omega": omega * scale**2, "alpha": alpha, "beta": beta, "loglik": ll}


def forecast(x: np.ndarray, m: dict[str, float], horizon: int) -> np.ndarray:
    """Variances of the next bars."""
    e2 = (x - m["mu"]) ** 2
    v = variances(e2, m["omega"], m["alpha"], m["beta"])[-1]
    out = [m["omega"] + m["alpha"] * e2[-1] + m["beta"] * v]
    for _ in range(horizon - 1):
        out.append(m["omega"] + (m["alpha"] + m["beta"]) * out[-1])
    return np.array(out)


def simulate_garch(omega: float, alpha: float, beta: float, n: int, mu: float = 0.0, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    v, out = omega / max(1 - alpha - beta, 1e-12), np.empty(n)
    for t in range(n):
        e = math.sqrt(v) * rng.standard_normal()
        out[t] = mu + e
        v = omega + alpha * e * e + beta * v
    return out


def simulate_ou(kappa: float, sigma: float, bars: int, sims: int, seed: int = 0) -> np.ndarray:
    """Paths around 0 from 0: x + (-kappa x) + sigma e, a row for each simulation."""
    rng = np.random.default_rng(seed)
    out = np.zeros((sims, bars))
    for t in range(1, bars):
        out[:, t] = out[:, t - 1] * (1 - kappa) + sigma * rng.standard_normal(sims)
    return out


def trade_paths(paths: np.ndarray, entry: float, stop: float, cost: float) -> tuple[float, float]:
    """Mean profit for each bar and mean trades of the two-sided machine on all paths at once."""
    side, profit, count = np.zeros(len(paths)), np.zeros(len(paths)), np.zeros(len(paths))
    for before, now in zip(paths.T[:-1], paths.T[1:], strict=True):
        profit += side * (now - before)
        enter = (side == 0) & (np.abs(now) > entry)
        count += enter
        side = np.where(enter, -np.sign(now), side)
        leave = ((side > 0) & (now >= 0)) | ((side < 0) & (now <= 0)) | (np.abs(now) > stop)
        side = np.where(leave, 0.0, side)
    return float((profit - count * cost).mean() / paths.shape[1]), float(count.mean())


def calibrate_entry(kappa: float, sigma: float, cost: float, ratio: float = 3.5 / 1.5, bars: int = 500, sims: int = 300, seed: int = 0) -> tuple[float, float] | None:
    """The entry threshold (in stationary deviations, from 0.25 to 3) with the best mean profit, and that profit."""
    if not (kappa > 0 and sigma > 0 and math.isfinite(kappa)):
        return None
    dev, paths = sigma / math.sqrt(2 * kappa), simulate_ou(kappa, sigma, bars, sims, seed)
    grid = [0.25 * k for k in range(1, 13)]
    score = [trade_paths(paths, z * dev, z * ratio * dev, cost)[0] for z in grid]
    k = int(np.argmax(score))
    return grid[k], score[k]


def by_key(rows: DataFrame, keys: list[str], value: str, f, columns: str, order: str = "i") -> DataFrame:
    """One row of numbers for each series: f(values in order) gives them, or None for unknown ones."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.split()[0] for c in columns.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values(order)[value].dropna().to_numpy(float))
        return pd.DataFrame([[*pdf[keys].iloc[0], *(out if out is not None else [None] * len(names))]], columns=[*keys, *names])

    ship(rows.sparkSession)
    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, {columns}")
