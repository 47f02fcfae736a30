"""Recurrences in time over blocks: one long series is many tasks.

A series is cut into blocks of consecutive order numbers. What a block does to the state that enters it is a small map: a position
machine sends each of three positions to another one, an exponential mean with gaps sends a value to an affine function of it. First
every block's map is computed, all blocks in parallel; then a series' maps are composed in order (one row for each block, so a series
of 10^8 bars in blocks of 10^5 is a thousand rows); at last every block is replayed from the state that enters it, again in parallel.
Both passes over the rows deal them by the same keys, so that the shuffle is shared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.session import ship

#: Order numbers of a block, unless told otherwise.
BLOCK = 100_000


def scan(
    rows: DataFrame, keys: list[str], order: str, summary: Callable[[pd.DataFrame], dict], summary_schema: str,
    compose: Callable[[pd.DataFrame], pd.DataFrame], state_schema: str, replay: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str,
) -> DataFrame:
    """replay(block's rows in order, the state that enters it) for all blocks; rows have `block` beside keys and order.

    summary(rows in order) gives a block's map; compose(a series' maps in order) gives the state that enters each block.
    """
    by = [*keys, "block"]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", block long"

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, **summary(pdf.sort_values(order).reset_index(drop=True))}])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("block").reset_index(drop=True)
        return pd.concat([p[by], compose(p)], axis=1)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return replay(left.sort_values(order).reset_index(drop=True), right.iloc[0].to_dict())

    ship(rows.sparkSession)
    entered = rows.groupBy(*by).applyInPandas(maps, f"{kinds}, {summary_schema}").groupBy(*keys).applyInPandas(states, f"{kinds}, {state_schema}")
    return rows.groupBy(*by).cogroup(entered.groupBy(*by)).applyInPandas(run, schema)


# --- position machines ------------------------------------------------------------------------------------------------------

#: Positions that can enter a block.
_SIDES = (-1.0, 0.0, 1.0)


def positions(src: DataFrame, keys: list[str], rule, order: str, block: int) -> DataFrame:
    """What `machine.positions` gives, over blocks; src has its columns."""
    from barflow.operators.machine import arrays, fold_from

    kinds = ", ".join(f"{k} {src.schema[k].dataType.simpleString()}" for k in keys)

    def summary(p: pd.DataFrame) -> dict:
        at, out = p[order].to_numpy(), {}
        for k, side in enumerate(_SIDES):
            # -1 stands for the row at which the entering position began
            *_, pos, entry = fold_from(*arrays(p), rule, side, -1 if side else None)
            out[f"p{k}"] = pos
            out[f"e{k}"] = -1 if entry is None or entry < 0 else int(at[entry])
        return out

    def compose(p: pd.DataFrame) -> pd.DataFrame:
        pos, entry, states = 0.0, -1, []
        for row in p.to_dict("records"):
            states.append((pos, entry))
            k = _SIDES.index(pos)
            pos, began = row[f"p{k}"], row[f"e{k}"]
            entry = -1 if not pos else began if began >= 0 else entry
        return pd.DataFrame(states, columns=["pos", "entered"])

    def replay(p: pd.DataFrame, state: dict) -> pd.DataFrame:
        at = p[order].to_numpy()
        began = int(state["entered"])
        pos, entered, reason, *_ = fold_from(*arrays(p), rule, float(state["pos"]), -1 if state["pos"] else None)
        out = p[[*keys, order]].copy()
        out["position"] = pos
        out["entry"] = pd.array([None if e is None else began if e < 0 else int(at[e]) for e in entered], "Int64")
        out["reason"] = reason
        return out

    shape = ", ".join(f"p{k} double, e{k} long" for k in range(3))
    rows = src.withColumn("block", F.floor(F.col(order) / block).cast("long"))
    return scan(rows, keys, order, summary, shape, compose, "pos double, entered long", replay, f"{kinds}, {order} long, position double, entry long, reason string")


# --- exponential means ------------------------------------------------------------------------------------------------------


def levels(steps: list, inputs: list[str]) -> list[list]:
    """Steps in groups of which each needs means of earlier groups alone."""
    held, pending, out = {c: np.zeros(0) for c in inputs}, {}, [[]]
    for name, source, alpha in steps:
        try:
            x = held[source] if isinstance(source, str) else source(held)
        except KeyError:
            held |= pending
            pending = {}
            out.append([])
            x = held[source] if isinstance(source, str) else source(held)
        (held if alpha is None else pending)[name] = x
        out[-1].append((name, source, alpha))
    return out


def mean_map(x: np.ndarray, alpha: float) -> tuple[int, float, float, float, int]:
    """What rows do to an exponential mean: rows before the first known value (-1: none is known), that value, slope and offset of
    the last mean in the first one, rows after the last known value."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return -1, 0.0, 1.0, 0.0, len(x)
    gain = alpha / (alpha + (1 - alpha) ** np.diff(at))
    slope, offset = float(np.prod(1 - gain)), 0.0
    for g, v in zip(gain.tolist(), x[at[1:]].tolist(), strict=True):
        offset += g * (v - offset)
    return int(at[0]), float(x[at[0]]), slope, offset, len(x) - 1 - int(at[-1])


def entered_mean(y: float, gap: int, first: int, value: float, alpha: float) -> float:
    """The mean at a block's first known value, `gap` rows after the last known one before the block (y; NaN: none)."""
    return value if np.isnan(y) else y + alpha / (alpha + (1 - alpha) ** (gap + first + 1)) * (value - y)


def replayed_mean(x: np.ndarray, alpha: float, y: float, gap: int) -> np.ndarray:
    """The means of a block's rows from the mean that enters it."""
    from barflow.operators.indicators import recurrence

    if np.isnan(y):
        return recurrence(x, alpha)
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return np.full(len(x), y)
    seeded = x.copy()
    seeded[at[0]] = entered_mean(y, gap, int(at[0]), float(x[at[0]]), alpha)
    out = recurrence(seeded, alpha)
    out[: at[0]] = y
    return out


def smoothed(rows: DataFrame, steps: list, block: int, dense: bool = False) -> DataFrame:
    """What `indicators.smoothed` gives, over blocks: one scan for each level of means of means."""
    inputs = [c for c in rows.columns if c not in ("symbol", "bar")]
    span = rows.agg(F.min("bar").alias("b0"), F.max("bar").alias("b1"))
    rows = rows.withColumn("block", F.floor(F.col("bar") / block).cast("long")).withColumn("b0", F.lit(None).cast("long")).withColumn("b1", F.lit(None).cast("long"))
    if dense:  # a row without bar for each block of each symbol carries the panel's first and last bar; the absent bars between are filled in
        names = rows.select("symbol").distinct().crossJoin(F.broadcast(span))  # one row
        blank = names.withColumn("block", F.explode(F.sequence(*(F.floor(F.col(c) / block).cast("long") for c in ("b0", "b1")))))
        rows = rows.unionByName(blank, allowMissingColumns=True)
    kind = rows.schema["symbol"].dataType.simpleString()
    have = list(inputs)
    for level in levels(steps, inputs):
        rows = _level(rows, level, list(have), block, dense, kind)
        have += [n for n, _, _ in level]
        dense = False  # filled in by the first level
    return rows.select("symbol", "bar", *(n for n, _, _ in steps))


def _level(rows: DataFrame, level: list, have: list[str], block: int, dense: bool, kind: str) -> DataFrame:
    means = [(n, a) for n, _, a in level if a is not None]
    names = [n for n, _, _ in level]

    def frame(p: pd.DataFrame) -> pd.DataFrame:
        if dense:
            b0, b1 = (int(p[c].dropna().iloc[0]) for c in ("b0", "b1"))
            k, symbol = int(p["block"].iloc[0]), p["symbol"].iloc[0]
            at = pd.RangeIndex(max(b0, k * block), min(b1, (k + 1) * block - 1) + 1, name="bar")
            p = p[p["bar"].notna()].set_index("bar").reindex(at).reset_index()
            p["symbol"], p["block"] = symbol, k
        return p

    def sources(p: pd.DataFrame) -> dict[str, np.ndarray]:
        held = {c: p[c].to_numpy(float) for c in have}
        with np.errstate(divide="ignore", invalid="ignore"):
            for name, source, alpha in level:
                x = held[source] if isinstance(source, str) else source(held)
                held[name if alpha is None else f"of {name}"] = x
        return held

    def summary(p: pd.DataFrame) -> dict:
        p = frame(p)
        held, out = sources(p), {}
        for k, (n, alpha) in enumerate(means):
            out |= dict(zip((f"f{k}", f"v{k}", f"s{k}", f"o{k}", f"g{k}"), mean_map(held[f"of {n}"], alpha), strict=True))
        return out

    def compose(p: pd.DataFrame) -> pd.DataFrame:
        state, out = [(np.nan, 0)] * len(means), []
        for row in p.to_dict("records"):
            out.append([v for s in state for v in s])
            for k, (_, alpha) in enumerate(means):
                (y, gap), first = state[k], int(row[f"f{k}"])
                if first < 0:
                    state[k] = (y, gap + int(row[f"g{k}"]))
                else:
                    start = entered_mean(y, gap, first, row[f"v{k}"], alpha)
                    state[k] = (row[f"s{k}"] * start + row[f"o{k}"], int(row[f"g{k}"]))
        return pd.DataFrame(out, columns=[c for k in range(len(means)) for c in (f"y{k}", f"g{k}")])

    def replay(p: pd.DataFrame, state: dict) -> pd.DataFrame:
        p = frame(p)
        held = sources(p)
        for k, (n, alpha) in enumerate(means):
            y = state[f"y{k}"]
            held[n] = replayed_mean(held[f"of {n}"], alpha, np.nan if y is None else float(y), int(state[f"g{k}"]))
        out = p[["symbol", "bar", "block"]].copy()
        out["b0"] = out["b1"] = pd.array([None] * len(out), "Int64")
        for c in [*have, *names]:
            out[c] = held[c]
        return out

    shape = ", ".join(f"f{k} long, v{k} double, s{k} double, o{k} double, g{k} long" for k in range(len(means)))
    states = ", ".join(f"y{k} double, g{k} long" for k in range(len(means)))
    columns = ", ".join(f"{c} double" for c in [*have, *names])
    return scan(rows.select("symbol", "bar", "block", "b0", "b1", *have), ["symbol"], "bar", summary, shape, compose, states, replay, f"symbol {kind}, bar long, block long, b0 long, b1 long, {columns}")
