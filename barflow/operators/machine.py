"""Position state machines: a fold over each key's rows in time order, then relational trade logs and profits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators import scans
from barflow.session import ship


@dataclass(frozen=True)
class Rule:
    """Thresholds of a machine.

    two_sided: enter against |z| > entry, leave when z crosses 0. Else enter when z > entry in the direction of `side`, leave
    at z <= leave; no entry on a session's last row. flat_at_end closes every position on a session's last row. stop=None: none.
    """

    entry: float = 1.5
    stop: float | None = 3.5
    leave: float = 0.5
    two_sided: bool = True
    flat_at_end: bool = False


def fold(z: np.ndarray, ok: np.ndarray, last: np.ndarray, side: np.ndarray, rule: Rule, enter: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[np.ndarray, list, list]:
    """Position of each row, and where a position closes the entry's row and the reason. enter, stop: thresholds of each row, NaN for the rule's."""
    return fold_from(z, ok, last, side, enter, stop, rule)[:3]


def fold_from(
    z: np.ndarray, ok: np.ndarray, last: np.ndarray, side: np.ndarray, enter: np.ndarray | None, stop: np.ndarray | None, rule: Rule, pos: float = 0.0, at: int | None = None
) -> tuple[np.ndarray, list, list, float, int | None]:
    """fold() from a position `pos` that began at row `at`, and the position and its row after the last row."""
    n = len(z)
    limit = np.inf if rule.stop is None else rule.stop
    enter = np.full(n, rule.entry) if enter is None else np.where(np.isnan(enter), rule.entry, enter)
    stop = np.full(n, limit) if stop is None else np.where(np.isnan(stop), limit, stop)
    position, entered, reason = np.zeros(n), [None] * n, [None] * n
    for t in range(n):
        why = None
        x = z[t]
        if not ok[t]:
            why = "regime break" if pos else None
        elif x != x:
            if rule.two_sided and not rule.flat_at_end:
                continue  # the row shows no position, the position itself goes on
        elif pos == 0.0:
            if rule.two_sided:
                pos = -1.0 if x > enter[t] else 1.0 if x < -enter[t] else 0.0
            elif x > enter[t] and not last[t]:
                pos = float(side[t])
            if pos:
                at = t
        elif rule.two_sided and ((pos > 0 and x >= 0) or (pos < 0 and x <= 0)):
            why = "reversion"
        elif not rule.two_sided and x <= rule.leave:
            why = "vol normalized"
        elif (abs(x) if rule.two_sided else x) > stop[t]:
            why = "hard stop" if rule.two_sided else "vol kept expanding"
        if why is None and rule.flat_at_end and last[t] and pos:
            why = "end of day"
        if why:
            entered[t], reason[t] = at, why
            pos, at = 0.0, None
        position[t] = pos
    return position, entered, reason, pos, at


def arrays(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """What fold_from() reads, of rows in order."""
    flag = lambda c: p[c].fillna(False).to_numpy(bool)
    return p["z"].to_numpy(float), flag("qualified"), flag("is_last"), p["side"].fillna(0).to_numpy(float), p["entry_z"].to_numpy(float), p["stop_z"].to_numpy(float)


def positions(rows: DataFrame, keys: list[str], rule: Rule, order: str = "i", block: int | None = None) -> DataFrame:
    """keys, order, position, entry (row at which a position that closes here began), reason. rows: z, and if there qualified, is_last, side, entry_z, stop_z.

    block: order numbers of a stretch that one task folds; a series is then many tasks (see `scans`). None: a series is one.
    """
    has = rows.columns
    src = rows.select(
        *keys, order, "z", (F.col("qualified") if "qualified" in has else F.lit(True)).alias("qualified"),
        (F.col("is_last") if "is_last" in has else F.lit(False)).alias("is_last"), (F.col("side") if "side" in has else F.lit(0)).cast("double").alias("side"),
        *((F.col(c) if c in has else F.lit(None)).cast("double").alias(c) for c in ("entry_z", "stop_z")),
    )
    if block:
        return scans.positions(src, keys, rule, order, block)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        pos, entered, reason, *_ = fold_from(*arrays(p), rule)
        at = p[order].to_numpy()
        out = p[[*keys, order]].reset_index(drop=True)
        out["position"] = pos
        out["entry"] = pd.array([None if e is None else int(at[e]) for e in entered], "Int64")
        out["reason"] = reason
        return out

    ship(rows.sparkSession)
    return src.groupBy(*keys).applyInPandas(run, f"{kinds}, {order} long, position double, entry long, reason string")


def trades(folded: DataFrame, rows: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """A row for each closed position: keys, entry, exit, entry_ts, exit_ts, direction, entry_z, exit_z, hold_bars, exit_reason."""
    done = folded.where("reason IS NOT NULL").select(*keys, "entry", F.col(order).alias("exit"), F.col("reason").alias("exit_reason"))
    entry = rows.select(*keys, F.col(order).alias("entry"), F.col("ts").alias("entry_ts"), F.col("z").alias("entry_z"))
    leave = rows.select(*keys, F.col(order).alias("exit"), F.col("ts").alias("exit_ts"), F.col("z").alias("exit_z"))
    side = folded.select(*keys, F.col(order).alias("entry"), F.when(F.col("position") > 0, "long").otherwise("short").alias("direction"))
    out = done.join(entry, [*keys, "entry"]).join(leave, [*keys, "exit"]).join(side, [*keys, "entry"])
    return out.withColumn("hold_bars", F.col("exit") - F.col("entry"))


def vol_scale(rows: DataFrame, sigma: str, keys: list[str], low: float = 0.2, high: float = 3.0) -> DataFrame:
    """Adds scale = median sigma of the key / sigma, within bounds; 1 where sigma is unknown."""
    target = rows.groupBy(*keys).agg(F.median(sigma).alias("target"))
    s = F.col("target") / F.nullif(F.col(sigma), F.lit(0.0))
    s = F.when(F.col(sigma) == 0, F.lit(high)).when(s.isNotNull(), F.least(F.greatest(s, F.lit(low)), F.lit(high)))
    return rows.join(target, keys).withColumn("scale", F.coalesce(s, F.lit(1.0)))


def spread_vol(rows: DataFrame, value: str, keys: list[str], w: int = 30, least: int = 5, order: str = "i") -> DataFrame:
    """Adds change (0 on the first row) and sigma, the deviation of the last w changes."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("change", F.coalesce(F.col(value) - F.lag(value).over(by), F.lit(0.0)))
    frame = by.rowsBetween(-(w - 1), 0)
    return rows.withColumn("sigma", F.when(F.count("change").over(frame) >= least, F.stddev_samp("change").over(frame)))


def profit(rows: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Adds pnl = position of the row before * change * scale; 0 on the first row."""
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("pnl", F.coalesce(F.lag("position").over(by) * F.col("change") * F.col("scale"), F.lit(0.0)))


def trade_profit(log: DataFrame, rows: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Adds pnl to trades: the sum over entry < row <= exit, as a difference of running sums (two equi-joins, no range join)."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.select(*keys, order, F.sum(F.coalesce("pnl", F.lit(0.0))).over(run).alias("total"))
    a = total.select(*keys, F.col(order).alias("entry"), F.col("total").alias("t0"))
    b = total.select(*keys, F.col(order).alias("exit"), F.col("total").alias("t1"))
    return log.join(a, [*keys, "entry"]).join(b, [*keys, "exit"]).withColumn("pnl", F.col("t1") - F.col("t0")).drop("t0", "t1")


def trade_prices(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the prices of both legs at entry and exit to trades of pairs (a, b)."""
    e = rows.select("a", "b", F.col("i").alias("entry"), F.col("pa").alias("entry_price_a"), F.col("pb").alias("entry_price_b"))
    x = rows.select("a", "b", F.col("i").alias("exit"), F.col("pa").alias("exit_price_a"), F.col("pb").alias("exit_price_b"))
    return log.join(e, ["a", "b", "entry"], "left").join(x, ["a", "b", "exit"], "left")


def legs(log: DataFrame, unit: float, beta: str = "beta") -> DataFrame:
    """Two rows for each trade of a pair: symbol, side, prices, move_pct (sign of the side), amount, shares (whole)."""
    long = F.col("direction") == "long"
    one = F.struct(F.lit("a").alias("leg"), F.col("a").alias("symbol"), F.when(long, "buy").otherwise("sell").alias("side"), F.col("entry_price_a").alias("p0"), F.col("exit_price_a").alias("p1"), F.lit(float(unit)).alias("amount"))
    two = F.struct(F.lit("b").alias("leg"), F.col("b").alias("symbol"), F.when(long, "sell").otherwise("buy").alias("side"), F.col("entry_price_b").alias("p0"), F.col("exit_price_b").alias("p1"), (F.lit(float(unit)) * F.abs(F.col(beta))).alias("amount"))
    out = log.select("a", "b", "entry", "exit", F.explode(F.array(one, two)).alias("l")).select("a", "b", "entry", "exit", "l.*")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return out.withColumn("move_pct", sign * (F.col("p1") / F.nullif("p0", F.lit(0.0)) - 1) * 100).withColumn("shares", F.floor(F.col("amount") / F.nullif("p0", F.lit(0.0))))


def labelled(direction: str = "direction") -> F.Column:
    return F.when(F.col(direction) == "long", F.concat(F.lit("buy "), "a", F.lit(" / sell "), "b")).otherwise(F.concat(F.lit("sell "), "a", F.lit(" / buy "), "b"))


def garch_sigma(rows: DataFrame, keys: list[str], change: str = "change", lookback: int = 5, every: int = 1, order: str = "i") -> DataFrame:
    """keys, order, sigma: the deviation forecast for each bar of a session by a model fitted on the `lookback` sessions before.

    Refitted every `every` sessions; the horizon is the bar's place in its session. NULL before the first fit.
    """
    from barflow.functions import models

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order).reset_index(drop=True)
        sigma = np.full(len(p), np.nan)
        by = {s: g.index.to_numpy() for s, g in p.groupby("sess")}
        names, model, past = sorted(by), None, None
        for k, s in enumerate(names):
            if k and (model is None or k % every == 0):
                past = np.concatenate([p[change].to_numpy(float)[by[q]] for q in names[max(0, k - lookback) : k]])
                past = past[np.isfinite(past)]
                model = models.fit_garch(past, constant=False) if len(past) >= 30 and past.std() > 0 else model
            if model is not None:
                sigma[by[s]] = np.sqrt(models.forecast(past, model, len(by[s])))
        out = p[[*keys, order]].copy()
        out["sigma"] = sigma
        return out

    ship(rows.sparkSession)
    return rows.select(*keys, order, "sess", change).groupBy(*keys).applyInPandas(run, f"{kinds}, {order} long, sigma double")
