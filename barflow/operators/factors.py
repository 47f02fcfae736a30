"""Factor residuals of a panel and the basket that trades them.

Every refit is one group: its window's complete returns give the loadings, its block's returns the residuals. A name's
cumulative residual, its z-score and its positions depend on that name alone; only the weight of a bar counts all open names,
and is a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.machine import Rule, positions
from barflow.session import ship


def loadings(returns: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors of the columns' sample covariance."""
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(returns, rowvar=False)))
    return vectors[:, np.argsort(values)[::-1][:k]]


def residuals(rows: DataFrame, start: int, window: int = 500, every: int = 45, factors: int = 3, least: int = 8) -> DataFrame:
    """symbol, bar, refit, resid. rows: symbol, bar, ret.

    A refit at bar t uses the complete names of [t - window, t) and holds to t + every; bars where one of them is unknown have
    no residuals, refits with too few names neither. A row goes to the refits whose window or block holds it.
    """
    low = F.greatest(F.ceil((F.col("bar") - start - (every - 1)) / every), F.lit(0))
    high = F.floor((F.col("bar") - start + window) / every)
    src = rows.select("symbol", "bar", "ret").where((F.col("bar") >= start - window) & F.col("ret").isNotNull()).withColumn("low", low).withColumn("high", high)
    src = src.where("high >= low").withColumn("refit", F.explode(F.sequence("low", "high"))).select("refit", "symbol", "bar", "ret")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = start + int(pdf["refit"].iloc[0]) * every
        wide = pdf.pivot(index="bar", columns="symbol", values="ret").sort_index()
        first = max(0, at - window)
        seen = wide.loc[(wide.index >= first) & (wide.index < at)].reindex(range(first, at))
        names = [c for c in wide.columns if seen[c].notna().all()] if at > first else []
        block = wide.loc[(wide.index >= at) & (wide.index < at + every)]
        if len(names) < max(factors + 1, least) or block.empty:
            return pd.DataFrame({"symbol": np.array([], object), "bar": np.array([], np.int64), "refit": np.array([], np.int64), "resid": np.array([], float)})
        v = loadings(seen[names].to_numpy(), factors)
        r = block[names].dropna()
        out = r.to_numpy() - r.to_numpy() @ v @ v.T
        return pd.DataFrame({
            "symbol": np.tile(np.array(names, object), len(r)), "bar": np.repeat(r.index.to_numpy(np.int64), len(names)),
            "refit": np.full(out.size, pdf["refit"].iloc[0], np.int64), "resid": out.ravel(),
        })

    kind = rows.schema["symbol"].dataType.simpleString()
    ship(rows.sparkSession)
    return src.groupBy("refit").applyInPandas(run, f"symbol {kind}, bar long, refit long, resid double")


def stat_arb(resid: DataFrame, window: int = 90, least: int = 10, rule: Rule | None = None) -> DataFrame:
    """symbol, bar, resid, z, position, n_open, part: z of the cumulative residual over its last `window` active bars.

    part = position before the bar * residual / names open before the bar.
    """
    w = Window.partitionBy("symbol").orderBy("bar")
    cum = resid.withColumn("cum", F.sum("resid").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = w.rowsBetween(-(window - 1), 0)
    z = (F.col("cum") - F.avg("cum").over(f)) / F.nullif(F.stddev_pop("cum").over(f), F.lit(0.0))
    rows = cum.withColumn("z", F.when(F.count("cum").over(f) >= least, F.coalesce(z, F.lit(0.0))).otherwise(0.0))
    folded = positions(rows, ["symbol"], rule or Rule(), "bar").select("symbol", "bar", "position", "entry", "reason")
    rows = rows.join(folded, ["symbol", "bar"]).withColumn("before", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    # a name outside the fit keeps its position: it is open on every bar between two rows of its own
    end = F.lead("bar").over(w)
    last = resid.agg(F.max("bar").alias("last_bar"))
    spans = rows.withColumn("until", end).crossJoin(F.broadcast(last)).where("position <> 0 AND bar < coalesce(until, last_bar)")  # last is one row
    open_ = spans.select(F.explode(F.sequence(F.col("bar") + 1, F.coalesce("until", "last_bar"))).alias("bar")).groupBy("bar").agg(F.count("*").alias("n_open"))
    out = rows.join(open_, "bar", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))
    part = F.col("before") * F.col("resid") / F.greatest(F.col("n_open"), F.lit(1))
    return out.select("symbol", "bar", "resid", "z", "position", "entry", "reason", "n_open", part.alias("part"))


def trades(book: DataFrame, last_bar: int | DataFrame) -> DataFrame:
    """symbol, entry, exit (bars), direction, entry_z, exit_z, hold_bars, exit_reason, pnl of stat_arb()'s positions.

    A position that is open at the end leaves with the panel's last bar (`last_bar`, a number or a frame of one row), without exit_z.
    pnl is the sum of the name's own parts after the entry up to the exit, as a difference of running sums.
    """
    w = Window.partitionBy("symbol").orderBy("bar")
    rows = book.withColumn("total", F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("opens", (F.col("position") != 0) & (F.coalesce(F.lag("position").over(w), F.lit(0.0)) == 0))
    starts = rows.where("opens").select("symbol", F.col("bar").alias("entry"), F.col("z").alias("entry_z"), F.col("total").alias("t0"), F.when(F.col("position") > 0, "long").otherwise("short").alias("direction"))
    closed = rows.where("reason IS NOT NULL").select("symbol", "entry", F.col("bar").alias("exit"), F.col("z").alias("exit_z"), F.col("reason").alias("exit_reason"), F.col("total").alias("t1"))
    held = rows.groupBy("symbol").agg(F.max(F.when(F.col("opens"), F.col("bar"))).alias("entry"), F.max_by("position", "bar").alias("position"), F.max_by("total", "bar").alias("t1")).where("position <> 0")
    if isinstance(last_bar, DataFrame):
        held = held.crossJoin(F.broadcast(last_bar.toDF("exit")))  # one row
    else:
        held = held.withColumn("exit", F.lit(last_bar).cast("long"))
    open_ = held.select("symbol", "entry", "exit", F.lit(None).cast("double").alias("exit_z"), F.lit("end of backtest").alias("exit_reason"), "t1")
    out = closed.unionByName(open_).join(starts, ["symbol", "entry"])
    return out.select("symbol", "entry", "exit", "direction", "entry_z", "exit_z", (F.col("exit") - F.col("entry")).alias("hold_bars"), "exit_reason", (F.col("t1") - F.col("t0")).alias("pnl"))
