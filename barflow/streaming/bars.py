"""Bars from a stream of ticks, and a rotation that decides on each closed bar.

Tumbling windows with a watermark close bars; late ticks are dropped by the watermark. The rotation keeps the last closes of
each symbol and the positions in a table of state: micro-batch n reads what n - 1 left and writes its own state and orders
under its number. A batch that is run again after a failure or a restart overwrites its own rows, so every bar is decided once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bar_stream(ticks: DataFrame, symbol: str, ts: str, value: str, width: str = "1 hour", delay: str = "2 hours", slide: str | None = None) -> DataFrame:
    """symbol, ts (start of the bar), open, high, low, close, volume; works on streams and tables."""
    at = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    return (
        ticks.where(F.col(value) > 0).withWatermark(ts, delay).groupBy(at.alias("w"), F.col(symbol).alias("symbol"))
        .agg(F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def session_stream(ticks: DataFrame, symbol: str, ts: str, value: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Activity sessions: symbol, start, finish, n, total."""
    return (
        ticks.withWatermark(ts, delay).groupBy(F.session_window(F.col(ts), gap).alias("w"), F.col(symbol).alias("symbol"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n", "total")
    )


@dataclass
class Rotator:
    """Decides on closed bars in order: ranks symbols by rate of change over a gapless window, sizes whole shares, emits orders.

    A bar is decided once, with its first rows; more rows of the newest bar fill in its closes, older bars are late and left
    out. A symbol with a gap in its window is not ranked.
    """

    lookback: int
    fast: int
    slow: int
    every: int
    top: int
    capital: float
    emit: Callable[[list[tuple]], None] | None = None
    index: int = -1
    closes: dict[str, deque] = field(default_factory=dict)
    held: dict[str, int] = field(default_factory=dict)
    last: object = None
    orders: list[tuple] = field(default_factory=list)

    def bar(self, ts: object, prices: dict[str, float]) -> None:
        if self.last is not None and ts <= self.last:
            if ts == self.last:
                for s, x in prices.items():
                    if s in self.closes:
                        self.closes[s][-1] = x  # every known symbol has a place for the newest bar
                    else:
                        self.closes[s] = deque([x], maxlen=max(self.lookback + 1, self.slow))
            return
        self.index += 1
        self.last = ts
        need = max(self.lookback + 1, self.slow)
        if self.index >= need and (self.index - need) % self.every == 0:
            self.decide(ts, prices)
        for s in {*self.closes, *prices}:
            self.closes.setdefault(s, deque(maxlen=need)).append(prices.get(s))

    def decide(self, ts: object, prices: dict[str, float]) -> None:
        need = max(self.lookback + 1, self.slow)
        ranked = []
        for s, x in self.closes.items():
            if len(x) < need or None in x or not prices.get(s):
                continue
            x = list(x)
            if sum(x[-self.fast :]) / self.fast > sum(x[-self.slow :]) / self.slow:
                ranked.append((-(x[-1] / x[-1 - self.lookback] - 1), s))
        chosen = [s for _, s in sorted(ranked)[: self.top]]
        orders = [(ts, s, "sell", n) for s, n in sorted(self.held.items()) if s not in chosen and n]
        target = {s: int(self.capital / len(chosen) / prices[s]) for s in chosen}
        for s in chosen:
            d = target[s] - self.held.get(s, 0)
            if d:
                orders.append((ts, s, "buy" if d > 0 else "sell", abs(d)))
        self.held = target
        self.orders += orders

    def state(self) -> tuple:
        return self.index, self.last, {s: list(x) for s, x in self.closes.items()}, dict(self.held)

    def resumed(self, state: tuple | None) -> Rotator:
        """A rotator of the same parameters that goes on from a state; from none, a fresh one."""
        index, last, closes, held = state or (-1, None, {}, {})
        need = max(self.lookback + 1, self.slow)
        return replace(self, index=index, last=last, closes={s: deque(x, maxlen=need) for s, x in closes.items()}, held=dict(held), orders=[])


#: The state that a batch leaves, one row, and the orders it gives.
STATE = "index long, last timestamp, closes map<string,array<double>>, held map<string,long>"
ORDERS = "ts timestamp, symbol string, side string, shares long"


def orders_of(spark: SparkSession, folder: str) -> DataFrame:
    """All orders that a rotation has given: batch, ts, symbol, side, shares."""
    return spark.read.schema(f"{ORDERS}, batch long").parquet(f"{folder}/orders")


def rotate(bars: DataFrame, rotator: Rotator, folder: str, trigger: dict | None = None):
    """Runs the rotation on a stream of closed bars; state, orders and checkpoint are in `folder`, which executors and driver share.

    One small table of prices for each bar comes to the driver. A new call on the same folder goes on where the last one ended.
    rotator.emit is called with a batch's orders after they are written (again if the batch is run again).
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = None
        if number:
            row = spark.read.schema(STATE).parquet(f"{folder}/state/batch={number - 1}").first()
            before = (row["index"], row["last"], row["closes"], row["held"])
        r = rotator.resumed(before)
        # one row for each bar; its prices are as many as the portfolio's symbols, the higher of two for one symbol
        last = df.groupBy("ts", "symbol").agg(F.max("close").alias("close"))
        rows = last.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("prices")).orderBy("ts")
        for x in rows.toLocalIterator():
            r.bar(x["ts"], x["prices"])
        spark.createDataFrame(r.orders, ORDERS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/orders/batch={number}")
        spark.createDataFrame([r.state()], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        if rotator.emit:
            rotator.emit(r.orders)

    out = bars.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (out.trigger(**trigger) if trigger else out).start()
