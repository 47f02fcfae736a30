"""Panels of bars in long form: symbol, ts, open, high, low, close, volume. A missing bar is a missing row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_from_ticks(ticks: DataFrame, symbol: str, ts: str, value: str, unit: str = "hour") -> DataFrame:
    """Aggregates ticks to bars of one calendar unit; values that are not positive are no prices."""
    at = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return (
        ticks.where(F.col(value) > 0)
        .groupBy(F.col(symbol).alias("symbol"), at.alias("ts"))
        .agg(
            F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"),
            F.count("*").alias("volume"),
        )
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of `events`: one symbol for each event type."""
    return bars_from_ticks(table(spark, folder, "events"), "event_type", "ts", "value")


def by_user(spark: SparkSession, folder: str, hours: int = 6) -> DataFrame:
    """Last value of each user of `events` in every so many hours: symbol, ts, close. A wide panel with gaps."""
    events = table(spark, folder, "events").where("value > 0")
    at = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.floor(F.hour("ts") / hours) * hours).cast("int"))
    bars = events.groupBy("user_id", at.alias("at")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    return bars.select(F.col("user_id").cast("string").alias("symbol"), F.col("at").alias("ts"), "close")  # names of symbols are not shuffled


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order price for each priority and day: symbol, ts, close."""
    orders = table(spark, folder, "orders")
    at = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), at.alias("ts")).agg(F.avg("o_totalprice").alias("close"))


def complete(bars: DataFrame) -> DataFrame:
    """Rows of the times at which every symbol has a bar."""
    n = bars.agg(F.countDistinct("symbol").alias("n"))
    full = bars.groupBy("ts").agg(F.countDistinct("symbol").alias("k")).crossJoin(n).where("k = n").select("ts")  # n is one row
    return bars.join(full, "ts", "left_semi")


def walks(bars: DataFrame, scale: float = 0.05) -> DataFrame:
    """Bars whose logs are the running sums of each symbol's deviations from its mean log price: prices that wander instead of noise."""
    w = Window.partitionBy("symbol")
    x = bars.withColumn("x", F.lit(scale) * (F.ln("close") - F.avg(F.ln("close")).over(w)))
    x = x.withColumn("close", F.exp(F.sum("x").over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))))
    x = x.withColumn("open", F.coalesce(F.lag("close").over(w.orderBy("ts")), "close"))
    return x.select("symbol", "ts", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", "volume")


def without_nan(bars: DataFrame) -> DataFrame:
    """NaN prices become NULL: aggregates then skip them."""
    return bars.select(*(F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in bars.dtypes))
