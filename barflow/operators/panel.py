"""Calendar, sessions and row positions of a panel.

Positions count the panel's distinct times, not a symbol's own rows. Windows over `bar` use RANGE frames, so a gap takes its
place in a window without a dense grid of symbols and times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def calendar(bars: DataFrame) -> DataFrame:
    """ts, bar, sess (both from 0), pos (bar in session), is_first, is_last. One row for each time, however many symbols."""
    days = bars.select("ts").distinct().withColumn("day", F.to_date("ts"))
    # bars are numbered within their day; only the list of days is numbered as a whole
    size = days.groupBy("day").agg(F.count("*").alias("size"))
    order = Window.orderBy("day")
    size = size.select(
        "day", "size", (F.row_number().over(order) - 1).cast("long").alias("sess"),
        F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    pos = (F.row_number().over(Window.partitionBy("day").orderBy("ts")) - 1).cast("long")
    out = days.withColumn("pos", pos).join(size, "day")
    return out.select(
        "ts", (F.col("before") + F.col("pos")).alias("bar"), "sess", "pos", (F.col("pos") == 0).alias("is_first"), (F.col("pos") == F.col("size") - 1).alias("is_last")
    )


def indexed(bars: DataFrame) -> DataFrame:
    """bars with bar, sess, pos, is_first, is_last."""
    return bars.join(calendar(bars), "ts")


def trail(first: int, last: int = 0, *keys: str) -> WindowSpec:
    """Panel rows from `first` to `last` relative to the current bar (0), of one symbol."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("bar").rangeBetween(first, last)


def shifted(column: str | Column, rows: int, *keys: str) -> Column:
    """The value `rows` panel rows before; NULL where the symbol has no bar there."""
    return F.max(column).over(trail(-rows, -rows, *keys))


def bars_per_year(bars: DataFrame, days: int = 252) -> DataFrame:
    """One row: bars, days, bars_per_year (NULL under two bars)."""
    at = bars.select("ts").distinct()
    n, d = F.count("*"), F.countDistinct(F.to_date("ts"))
    return at.agg(n.alias("n_bars"), d.alias("n_days"), F.when(n >= 2, n / d * days).alias("bars_per_year"))


def split(bars: DataFrame, fraction: float) -> DataFrame:
    """One row: n_sessions, split_session = floor(n_sessions * fraction), split_bar (first bar of that session)."""
    if not 0 < fraction < 1:
        raise ValueError("the in-sample fraction must lie between 0 and 1")
    at = calendar(bars).groupBy("sess").agg(F.min("bar").alias("bar"))
    n = at.agg((F.max("sess") + 1).alias("n_sessions")).withColumn("split_session", F.floor(F.col("n_sessions") * F.lit(float(fraction))))
    return n.join(at, F.col("sess") == F.col("split_session")).select("n_sessions", "split_session", F.col("bar").alias("split_bar"))


def profile(bars: DataFrame) -> DataFrame:
    """Bars, first and last time of each symbol."""
    return bars.groupBy("symbol").agg(F.count("close").alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def pairs(bars: DataFrame, least: int = 0, only: DataFrame | None = None) -> DataFrame:
    """Joint rows of every two symbols (a < b): a, b, ts, pa, pb, i (joint row from 0), sess (joint session from 0).

    only: pairs (a, b) of interest; no other rows are joined then.
    """
    from pyspark.sql import Window as W

    one = bars.where("close > 0").select(F.col("symbol").alias("a"), "ts", F.col("close").alias("pa"))
    two = bars.where("close > 0").select(F.col("symbol").alias("b"), "ts", F.col("close").alias("pb"))
    both = one.join(two, "ts").where("a < b") if only is None else one.join(only.select("a", "b").distinct(), "a").join(two, ["b", "ts"]).where("a < b")
    w = W.partitionBy("a", "b")
    if least:  # the numbering below needs the same partitioning, so the count costs no further shuffle
        both = both.withColumn("total", F.count("*").over(w)).where(F.col("total") >= least)
    return both.select(
        "a", "b", "ts", "pa", "pb", (F.row_number().over(w.orderBy("ts")) - 1).cast("long").alias("i"), (F.dense_rank().over(w.orderBy(F.to_date("ts"))) - 1).cast("long").alias("sess")
    )
