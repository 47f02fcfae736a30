"""Top-N rotation as a relational plan.

Every `every` bars the best `top` eligible symbols are held with equal weight. The decision at bar t uses values of t and acts
from t + 1 on. A bar t + 1 >= start belongs to the rebalance clock with phase (t + 1 - start) mod every, so all phases of a
clock are one plan: each signal row is a decision of exactly one phase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.indicators import log_return, roc, trend


def signals(rows: DataFrame, lookback: int, fast: int, slow: int) -> DataFrame:
    """symbol, bar, ret, roc, ok (trend) of indexed bars."""
    return rows.select("symbol", "bar", log_return().alias("ret"), roc("close", lookback).alias("roc"), trend("close", fast, slow).alias("ok"))


def baskets(signal: DataFrame, score: Column, mask: Column, start: int, every: int, top: int, bars: int, phases: int = 1) -> DataFrame:
    """phase, t0 (first bar held), symbol, weight. Phase p starts at bar start + p. Ties go to the smaller symbol."""
    t0 = F.col("bar") + 1
    rows = signal.select("symbol", t0.alias("t0"), F.pmod(t0 - start, F.lit(every)).alias("phase"), score.alias("score"), mask.alias("mask"))
    rows = rows.where("mask AND score IS NOT NULL AND NOT isnan(score)").where((F.col("phase") < phases) & (F.col("t0") >= start + F.col("phase")) & (F.col("t0") < bars))
    best = Window.partitionBy("phase", "t0").orderBy(F.desc("score"), "symbol")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("phase", "t0"))).select("phase", "t0", "symbol", "rank", "weight")


def sweep_starts(bars: int, lookback: int, most: int = 24, step: int = 45, rest: int = 400) -> list[int]:
    """Starts from lookback + 5 to bars - rest, evenly spaced, at most `most` and about `step` bars apart; none on a short panel."""
    first, last = lookback + 5, bars - rest
    return [] if last <= first else np.linspace(first, last, num=min(most, max(2, (last - first) // step))).astype(int).tolist()


def start_baskets(signal: DataFrame, score: Column, mask: Column, starts: list[int], every: int, top: int, bars: int) -> DataFrame:
    """baskets() of a clock for each start in one plan; phase is the start. A signal row is unfolded to the starts it decides for."""
    t0 = F.col("bar") + 1
    at = F.array(*(F.lit(s) for s in starts)).cast("array<int>")
    rows = signal.select("symbol", t0.alias("t0"), F.explode(F.filter(at, lambda s: (t0 >= s) & (F.pmod(t0 - s, F.lit(every)) == 0))).alias("phase"), score.alias("score"), mask.alias("mask"))
    rows = rows.where("mask AND score IS NOT NULL AND NOT isnan(score)").where(F.col("t0") < bars)
    best = Window.partitionBy("phase", "t0").orderBy(F.desc("score"), "symbol")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("phase", "t0"))).select("phase", "t0", "symbol", "rank", "weight")


def start_profit(parts: DataFrame, clock: DataFrame, starts: list[int]) -> DataFrame:
    """profit() of start_baskets(): phase (the start), bar, pnl, n_held for every bar from the start on."""
    sums = parts.groupBy("phase", "bar").agg(F.sum("part").alias("pnl"), F.count("*").alias("n_held"))
    at = clock.select("bar").withColumn("phase", F.explode(F.array(*(F.lit(s) for s in starts)).cast("array<int>"))).where("bar >= phase")
    return at.join(sums, ["phase", "bar"], "left").select("phase", "bar", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.coalesce("n_held", F.lit(0)).alias("n_held"))


def variant_baskets(signal: DataFrame, rules: dict[str, tuple[Column, Column]], start: int, every: int, top: int, bars: int, phases: int = 1) -> DataFrame:
    """baskets() of several rules (name -> mask, score) in one plan: each signal row is unfolded to the rules that admit it."""
    choice = F.array(*(F.struct(F.lit(k).alias("variant"), F.when(F.coalesce(mask, F.lit(False)), score).cast("double").alias("score")) for k, (mask, score) in rules.items()))
    t0 = F.col("bar") + 1
    rows = signal.select("symbol", t0.alias("t0"), F.pmod(t0 - start, F.lit(every)).alias("phase"), F.explode(F.filter(choice, lambda c: c["score"].isNotNull() & ~F.isnan(c["score"]))).alias("c"))
    rows = rows.where((F.col("phase") < phases) & (F.col("t0") >= start + F.col("phase")) & (F.col("t0") < bars)).select("c.variant", "phase", "t0", "symbol", "c.score")
    best = Window.partitionBy("variant", "phase", "t0").orderBy(F.desc("score"), "symbol")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    weight = 1 / F.count("*").over(Window.partitionBy("variant", "phase", "t0"))
    return rows.withColumn("weight", weight).select("variant", "phase", "t0", "symbol", "rank", "weight")


#: Parameters of a grid cell.
CELL = ("lookback", "top")


def grid_baskets(signal: DataFrame, scores: dict[int, Column], mask: Column, tops: tuple[int, ...], start: int, every: int, bars: int, phases: int = 1) -> DataFrame:
    """baskets() of every cell of a grid in one plan: lookback, top, phase, t0, symbol, rank, weight.

    A signal row is unfolded to the lookbacks it has a score for and ranked once for each; a ranked row is unfolded to the tops
    that hold it.
    """
    t0 = F.col("bar") + 1
    choice = F.array(*(F.struct(F.lit(k).cast("long").alias("lookback"), c.cast("double").alias("score")) for k, c in scores.items()))
    known = F.filter(choice, lambda c: c["score"].isNotNull() & ~F.isnan(c["score"]))
    rows = signal.where(mask).select("symbol", t0.alias("t0"), F.pmod(t0 - start, F.lit(every)).alias("phase"), F.explode(known).alias("c"))
    rows = rows.where((F.col("phase") < phases) & (F.col("t0") >= start + F.col("phase")) & (F.col("t0") < bars)).select("c.lookback", "phase", "t0", "symbol", "c.score")
    best = Window.partitionBy("lookback", "phase", "t0").orderBy(F.desc("score"), "symbol")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(tops))
    held = F.filter(F.array(*(F.lit(t).cast("long") for t in tops)), lambda t: t >= F.col("rank"))
    rows = rows.select("*", F.explode(held).alias("top"))
    return rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*CELL, "phase", "t0"))).drop("score")


def grid_profit(held: DataFrame, signal: DataFrame, clock: DataFrame, lookbacks: list[int], tops: tuple[int, ...], start: int, every: int, bars: int, phases: int = 1) -> DataFrame:
    """profit() of every cell: lookback, top, phase, bar, pnl for every bar from the phase's start."""
    keys = [*CELL, "phase", "bar"]
    sums = contributions(held, signal, every, bars, (*CELL, "phase")).groupBy(*keys).agg(F.sum("part").alias("pnl"))
    cells = F.array(*(F.struct(F.lit(x).cast("long").alias("lookback"), F.lit(t).cast("long").alias("top")) for x in lookbacks for t in tops))
    at = clock.select("bar", F.explode(cells).alias("c")).select("bar", "c.*").withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(phases - 1)))).where(F.col("bar") >= start + F.col("phase"))
    return at.join(sums, keys, "left").select(*keys, F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


def contributions(held: DataFrame, signal: DataFrame, every: int, bars: int, keys: tuple[str, ...] = ("phase",)) -> DataFrame:
    """keys, bar, symbol, t0, part = weight * return; a missing return gives 0 but keeps its weight."""
    days = held.withColumn("bar", F.explode(F.sequence(F.col("t0"), F.least(F.col("t0") + every - 1, F.lit(bars - 1)))))
    ret = signal.select("symbol", "bar", "ret")
    return days.join(ret, ["symbol", "bar"], "left").select(*keys, "bar", "symbol", "t0", (F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("part"))


def profit(parts: DataFrame, clock: DataFrame, start: int, phases: int = 1) -> DataFrame:
    """phase, bar, pnl, n_held for every bar from the phase's start; clock: the calendar."""
    sums = parts.groupBy("phase", "bar").agg(F.sum("part").alias("pnl"), F.count("*").alias("n_held"))
    at = clock.select("bar").withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(phases - 1)))).where(F.col("bar") >= start + F.col("phase"))
    return at.join(sums, ["phase", "bar"], "left").select("phase", "bar", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.coalesce("n_held", F.lit(0)).alias("n_held"))


def turnover(held: DataFrame, every: int, top: int, bars: int, keys: tuple[str, ...] = ("phase",)) -> DataFrame:
    """keys, bar, dropped, added, turnover at the rebalances with a change."""
    w = Window.partitionBy(*keys, "symbol").orderBy("t0")
    x = held.withColumn("before", F.lag("t0").over(w)).withColumn("after", F.lead("t0").over(w))
    added = x.where(F.col("before").isNull() | (F.col("before") != F.col("t0") - every)).select(*keys, F.col("t0").alias("bar"), F.lit(0).alias("d"), F.lit(1).alias("a"))
    out = x.where((F.col("after").isNull() | (F.col("after") != F.col("t0") + every)) & (F.col("t0") + every < bars))
    dropped = out.select(*keys, (F.col("t0") + every).alias("bar"), F.lit(1).alias("d"), F.lit(0).alias("a"))
    return added.unionByName(dropped).groupBy(*keys, "bar").agg(F.sum("d").alias("dropped"), F.sum("a").alias("added"), (F.sum(F.col("d") + F.col("a")) / F.lit(top)).alias("turnover"))


def trades(held: DataFrame, parts: DataFrame, every: int, bars: int) -> DataFrame:
    """phase, symbol, entry, exit, hold_bars, exit_reason, pnl: runs of consecutive baskets; pnl over entry < bar <= exit."""
    w = Window.partitionBy("phase", "symbol").orderBy("t0")
    runs = held.withColumn("island", F.col("t0") - every * F.row_number().over(w)).groupBy("phase", "symbol", "island")
    runs = runs.agg(F.min("t0").alias("entry"), (F.max("t0") + every).alias("end"))
    runs = runs.withColumn("exit", F.least("end", F.lit(bars - 1))).withColumn("exit_reason", F.when(F.col("end") < bars, "rebalance drop").otherwise("end of backtest"))
    # a position's own bars carry its island, so its profit is one aggregate
    island = held.withColumn("island", F.col("t0") - every * F.row_number().over(w)).select("phase", "symbol", "t0", "island")
    own = parts.join(island, ["phase", "symbol", "t0"]).join(runs, ["phase", "symbol", "island"]).where("bar > entry AND bar <= exit")
    pnl = own.groupBy("phase", "symbol", "island").agg(F.sum("part").alias("pnl"))
    return runs.join(pnl, ["phase", "symbol", "island"], "left").select(
        "phase", "symbol", "entry", "exit", (F.col("exit") - F.col("entry")).alias("hold_bars"), "exit_reason", F.coalesce("pnl", F.lit(0.0)).alias("pnl")
    )


def buy_and_hold(signal: DataFrame, start: int) -> DataFrame:
    """bar, pnl: mean of the known returns."""
    return signal.where(F.col("bar") >= start).groupBy("bar").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("pnl"))


def rules(di: str = "", hurst: str = "") -> dict[str, tuple[Column, Column, Column | None]]:
    """Selection rules: name -> (mask, score, what a threshold is held against, if any), over signal columns roc, ok, vol, plus_di,
    minus_di, adx (these with the suffix `di`) and hurst (with the suffix `hurst`)."""
    c, yes = F.col, F.col("ok") & F.col("roc").isNotNull()
    plus, minus, adx, lasting = c(f"plus_di{di}"), c(f"minus_di{di}"), c(f"adx{di}"), c(f"hurst{hurst}")
    up, risk = plus > minus, F.when(c("vol") > 0, c("roc") / c("vol"))
    return {
        "baseline": (yes, c("roc"), None), "di_gate": (up, c("roc"), None), "ma_and_di": (yes & up, c("roc"), None), "ma_and_adx": (yes, c("roc"), adx),
        "ma_di_adx": (yes & up, c("roc"), adx), "rank_by_di": (yes & up, plus - minus, None), "rank_by_adx_weighted": (yes, c("roc") * adx / 100, adx),
        "risk_adjusted": (yes, risk, None), "ma_and_hurst": (yes, c("roc"), lasting), "hurst_and_di": (up, c("roc"), lasting), "risk_adjusted_di": (yes & up, risk, None),
    }


def variants(adx_min: float = 20.0, hurst_min: float = 0.5) -> dict[str, tuple[Column, Column]]:
    """The rules at one setting: name -> (mask, score)."""
    return {k: (mask if gate is None else mask & (gate >= (hurst_min if "hurst" in k else adx_min)), score) for k, (mask, score, gate) in rules().items()}


#: Rules by what they depend on.
BY_ADX, BY_HURST = ("ma_and_adx", "ma_di_adx", "rank_by_adx_weighted"), ("ma_and_hurst", "hurst_and_di")
BY_DI = ("di_gate", "ma_and_di", "rank_by_di", "risk_adjusted_di", "hurst_and_di", *BY_ADX)


@dataclass(frozen=True)
class Axes:
    """Windows and thresholds around each rule's own setting, and that setting."""

    di: tuple[int, ...] = (14, 45, 126)
    adx: tuple[float, ...] = (10.0, 15.0, 20.0, 25.0, 30.0)
    near_adx: tuple[float, ...] = (15.0, 20.0, 25.0, 30.0)
    hurst: tuple[int, ...] = (150, 250, 400)
    level: tuple[float, ...] = (0.45, 0.50, 0.55, 0.60)
    base: tuple[int, int, float, float] = (45, 250, 20.0, 0.5)


@dataclass(frozen=True)
class Cell:
    """A rule at one setting; in its grid (the plateau view), in its neighbourhood (median and worst), its own setting."""

    variant: str
    di: int | None
    hurst: int | None
    level: float | None
    grid: bool
    near: bool
    own: bool


def cells(a: Axes = Axes()) -> list[Cell]:
    """Every setting that grid, neighbourhood or summary of a rule needs, each once."""
    di, window, adx, level = a.base
    out = []
    for v in rules():
        if v in BY_HURST:
            for d in a.di if v in BY_DI else (di,):
                for w in a.hurst:
                    if d == di or w == window:
                        out += [Cell(v, d, w, x, d == di, w == window, (d, w, x) == (di, window, level)) for x in a.level]
        elif v in BY_DI:
            for d in a.di:
                out += [Cell(v, d, None, x, True, x in (None, *a.near_adx), d == di and x in (None, adx)) for x in (a.adx if v in BY_ADX else (None,))]
        else:
            out.append(Cell(v, None, None, None, False, True, True))
    return out


def _reaches(gate: Column):
    return lambda x: F.coalesce(gate >= x["level"], F.lit(False))


def cell_baskets(signal: DataFrame, of: list[Cell], start: int, every: int, top: int, bars: int) -> DataFrame:
    """cell (place in `of`), phase, t0, symbol, rank, weight of every setting and phase in one plan.

    Rows are dealt by time once and unfolded afterwards: to the rules and windows that admit them, then to the thresholds that they
    reach; ranking needs no further shuffle.
    """
    t0 = F.col("bar") + 1
    rows = signal.where((t0 >= start) & (t0 < bars)).withColumn("t0", t0).repartition("t0")
    groups: dict[tuple, list[int]] = {}
    for k, c in enumerate(of):
        groups.setdefault((c.variant, c.di, c.hurst), []).append(k)
    choice = []
    for (v, d, w), own in groups.items():
        mask, score, gate = rules(f"_{d}" if d else "", f"_{w}" if w else "")[v]
        reached = F.array(*(F.struct(F.lit(k).alias("cell"), F.lit(of[k].level).cast("double").alias("level")) for k in own))
        if gate is not None:
            reached = F.filter(reached, _reaches(gate))
        choice.append(F.struct(F.when(F.coalesce(mask, F.lit(False)), score).cast("double").alias("score"), F.transform(reached, lambda x: x["cell"]).alias("at")))
    rows = rows.select("symbol", "t0", F.explode(F.filter(F.array(*choice), lambda c: c["score"].isNotNull() & ~F.isnan(c["score"]))).alias("c"))
    rows = rows.select("symbol", "t0", "c.score", F.explode("c.at").alias("cell"))
    best = Window.partitionBy("t0", "cell").orderBy(F.desc("score"), "symbol")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    weight = 1 / F.count("*").over(Window.partitionBy("t0", "cell"))
    return rows.select("cell", F.pmod(F.col("t0") - start, F.lit(every)).alias("phase"), "t0", "symbol", "rank", weight.alias("weight"))


def neutral_profit(held: DataFrame, signal: DataFrame, clock: DataFrame, count: int, start: int, every: int, bars: int) -> DataFrame:
    """cell, bar, pnl: the mean over all phases at each bar from which on all have begun; 0 where nothing is held."""
    sums = contributions(held, signal, every, bars, ("cell",)).groupBy("cell", "bar").agg((F.sum("part") / every).alias("pnl"))
    at = clock.where(F.col("bar") >= start + every).select("bar", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("cell"))
    return at.join(sums, ["cell", "bar"], "left").select("cell", "bar", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


def nudged(signal: DataFrame, clock: DataFrame, scores: dict[int, Column], mask: Column, cells_: list[tuple[int, int]], start: int, top: int, bars: int) -> DataFrame:
    """cell (place in the list of (lookback, every)), bar, pnl: the rotation under several lookbacks and clocks in one plan."""
    t0 = F.col("bar") + 1
    rows = signal.where(mask & (t0 >= start) & (t0 < bars)).withColumn("t0", t0).repartition("t0")
    choice = [F.struct(F.lit(k).alias("cell"), F.lit(every).alias("every"), scores[look].cast("double").alias("score")) for k, (look, every) in enumerate(cells_)]
    due = F.filter(F.array(*choice), lambda c: c["score"].isNotNull() & ~F.isnan(c["score"]) & (F.pmod(F.col("t0") - start, c["every"]) == 0))
    rows = rows.select("symbol", "t0", F.explode(due).alias("c")).select("symbol", "t0", "c.*")
    best = Window.partitionBy("t0", "cell").orderBy(F.desc("score"), "symbol")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    held = rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("t0", "cell")))
    days = held.withColumn("bar", F.explode(F.sequence("t0", F.least(F.col("t0") + F.col("every") - 1, F.lit(bars - 1)))))
    sums = days.join(signal.select("symbol", "bar", "ret"), ["symbol", "bar"], "left").groupBy("cell", "bar").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("pnl"))
    at = clock.where(F.col("bar") >= start).select("bar", F.explode(F.sequence(F.lit(0), F.lit(len(cells_) - 1))).alias("cell"))
    return at.join(sums, ["cell", "bar"], "left").select("cell", "bar", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))
