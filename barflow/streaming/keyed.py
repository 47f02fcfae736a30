"""Rotation of many portfolios as keyed state: ticks in, orders out, no driver in between.

Each portfolio is a key. Its state is the ticks of bars that are still open (map), the last closes of each symbol (map), the shares
held and the clock (values). A timer at the end of every bar fires when the watermark has passed it: the bar closes with the last tick
of each symbol, and the rotation decides as `Rotator` does. Ticks of a closed bar are late and left out. A symbol without a close in
the whole window that is not held is forgotten, so delisted names do not stay in the state. Portfolios run in parallel, and a restart
goes on from the checkpointed state. Needs the RocksDB state store, which `barflow.session.session` sets.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barflow.session import ship
from barflow.streaming.bars import Rotator

ORDERS = "portfolio string, ts timestamp, symbol string, side string, shares long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _of_ms(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class Portfolios(StatefulProcessor):
    """The state of one portfolio: ticks of open bars, rings of closes, holdings and clock."""

    def __init__(self, rotator: Rotator, width_ms: int) -> None:
        self.rotator, self.width = rotator, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "symbol string, bar long", "at long, close double")
        self.closes = handle.getMapState("closes", "symbol string", "x array<double>")
        self.held = handle.getMapState("held", "symbol string", "shares long")
        self.clock = handle.getValueState("clock", "index long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, bars = timerValues.getCurrentWatermarkInMs(), set()
        for part in rows:
            part = part[part["close"] > 0]
            at = pd.to_datetime(part["ts"], utc=True).astype("datetime64[ms, UTC]").astype("int64")
            part = part.assign(at=at, bar=at - at % self.width)
            part = part[part["bar"] + self.width > mark]
            # the last tick of each symbol and bar; of two at one time the higher
            for x in part.sort_values(["at", "close"]).groupby(["symbol", "bar"]).tail(1).itertuples():
                k = (x.symbol, int(x.bar))
                now = (int(x.at), float(x.close))
                if not self.open.containsKey(k) or now >= tuple(self.open.getValue(k)):
                    self.open.updateValue(k, now)
                bars.add(int(x.bar) + self.width)
        known = {int(t) for t in self.handle.listTimers()}
        for end in bars - known:
            self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        bars: dict[int, dict[str, float]] = {}
        for (symbol, bar), (_, close) in list(self.open.iterator()):
            if bar + self.width <= until:
                bars.setdefault(bar, {})[symbol] = close
        if not bars:
            return
        index, last = self.clock.get() if self.clock.exists() else (-1, None)
        rings = {k[0]: [None if pd.isna(v) else v for v in x[0]] for k, x in self.closes.iterator()}
        held = {k[0]: int(x[0]) for k, x in self.held.iterator()}
        r = self.rotator.resumed((index, None if last is None else _of_ms(last), rings, held))
        for bar in sorted(bars):
            r.bar(_of_ms(bar), bars[bar])
            for symbol in bars[bar]:
                self.open.removeKey((symbol, bar))
        self.clock.update((r.index, max(bars)))
        for s in [*r.closes]:
            if not any(x is not None for x in r.closes[s]) and s not in r.held:
                del r.closes[s]
        self._replace(self.closes, rings, {s: (list(x),) for s, x in r.closes.items()})
        self._replace(self.held, held, {s: (n,) for s, n in r.held.items()})
        if r.orders:
            ts, symbol, side, shares = zip(*r.orders, strict=True)
            yield pd.DataFrame({"portfolio": key[0], "ts": pd.to_datetime(ts, utc=True), "symbol": symbol, "side": side, "shares": shares})

    @staticmethod
    def _replace(state, before: dict, after: dict) -> None:
        for s in before.keys() - after.keys():
            state.removeKey((s,))
        for s, x in after.items():
            state.updateValue((s,), x)

    def close(self) -> None:
        pass


def rotate(ticks: DataFrame, rotator: Rotator, portfolio: str = "portfolio", symbol: str = "symbol", ts: str = "ts", value: str = "value", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """A stream of orders (portfolio, ts of the bar, symbol, side, shares) from a stream of ticks."""
    spark = ticks.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        raise ValueError(f"keyed rotation needs the RocksDB state store: set {_PROVIDER}")
    ship(spark)
    ms = int(pd.Timedelta(width).total_seconds() * 1000)
    rows = ticks.select(F.coalesce(F.col(portfolio).cast("string"), F.lit("")).alias("portfolio"), F.col(symbol).cast("string").alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("close"))
    rows = rows.where("symbol IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return rows.groupBy("portfolio").transformWithStateInPandas(Portfolios(rotator, ms), ORDERS, "Append", "EventTime")
