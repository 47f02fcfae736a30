"""Capital, amounts and shares of trades, and verdicts on results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dollar_per_unit(capital: float, scale_max: float) -> float:
    """Money behind one unit of position, so that the largest scale never exceeds the capital."""
    return capital / scale_max


def risk_unit(rows: DataFrame, keys: list[str], sigma: str, capital: float, risk_pct: float) -> DataFrame:
    """keys, unit = capital * risk share / median sigma."""
    return rows.groupBy(*keys).agg((F.lit(capital * risk_pct / 100) / F.nullif(F.median(sigma), F.lit(0.0))).alias("unit"))


def multiplier(columns: list[str]) -> Column:
    """Share of a unit held at a bar: its scale, else one part of the names held or active, else 1."""
    if "scale" in columns:
        return F.coalesce("scale", F.lit(1.0))
    for name in ("n_held", "n_active"):
        if name in columns:
            return F.coalesce(1 / F.nullif(F.col(name), F.lit(0)), F.lit(1.0)).cast("double")
    return F.lit(1.0)


def amounts(trades: DataFrame, results: DataFrame, prices: DataFrame, unit: float, keys: list[str] | None = None) -> DataFrame:
    """trades (symbol, entry, exit) with entry_price, exit_price, amount and whole shares; a missing price leaves them NULL."""
    keys = keys or []
    size = results.select(*keys, F.col("bar").alias("entry"), multiplier(results.columns).alias("m"))
    p = prices.select("symbol", "bar", "close")
    a = p.select("symbol", F.col("bar").alias("entry"), F.col("close").alias("entry_price"))
    b = p.select("symbol", F.col("bar").alias("exit"), F.col("close").alias("exit_price"))
    out = trades.join(size, [*keys, "entry"], "left").join(a, ["symbol", "entry"], "left").join(b, ["symbol", "exit"], "left")
    amount = F.coalesce("m", F.lit(1.0)) * F.lit(float(unit))
    return out.withColumn("amount", amount).withColumn("shares", F.floor(F.col("amount") / F.nullif("entry_price", F.lit(0.0)))).drop("m")


def percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, 5 %, median, 95 %, largest of the known values."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(*keys).agg(F.min(v).alias("lo"), q.alias("q"), F.max(v).alias("hi")).select(*keys, "lo", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "hi")


def verdicts(variants: DataFrame, benchmark: float) -> DataFrame:
    """variant, sharpe, worst (over its grid) -> fragile, beats."""
    return variants.withColumn("fragile", F.col("worst") < 0).withColumn("beats", F.col("sharpe") > F.lit(benchmark))


def red_flags(performance: DataFrame, stability: DataFrame, keys: list[str]) -> DataFrame:
    """keys, too_good (Sharpe ratio above 3), unstable (hedge ratio)."""
    return performance.join(stability, keys, "left").select(*keys, F.coalesce(F.col("sharpe") > 3, F.lit(False)).alias("too_good"), F.coalesce("unstable", F.lit(False)).alias("unstable"))


def change_pct(rows: DataFrame, order: str = "bar") -> DataFrame:
    """symbol, last close, change against the close before and against the first, in per cent."""
    w = Window.partitionBy("symbol").orderBy(order)
    x = rows.withColumn("before", F.lag("close").over(w))
    out = x.groupBy("symbol").agg(F.max_by("close", order).alias("last"), F.max_by("before", order).alias("before"), F.min_by("close", order).alias("first"))
    return out.select("symbol", "last", ((F.col("last") / F.nullif("before", F.lit(0.0)) - 1) * 100).alias("day_pct"), ((F.col("last") / F.nullif("first", F.lit(0.0)) - 1) * 100).alias("total_pct"))


def padded_range(rows: DataFrame, value: str, skip: int = 0, pad: float = 0.05) -> DataFrame:
    """symbol, lo, hi of a value after a warm-up, widened by a share of their distance."""
    x = rows.where(F.col("bar") >= skip).groupBy("symbol").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    gap = (F.col("b") - F.col("a")) * pad
    return x.select("symbol", (F.col("a") - gap).alias("lo"), (F.col("b") + gap).alias("hi"))
