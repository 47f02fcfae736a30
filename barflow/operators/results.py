"""Statistics of profit series, costs, capital, and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.stats import expected_max_sharpe, normal_cdf, sharpe_error

#: Costs in basis points of turnover (fixed values).
COSTS = (0, 1, 2, 5, 10, 20)


def _run(keys: list[str], order: str) -> tuple:
    w = Window.partitionBy(*keys).orderBy(order)
    return w, w.rowsBetween(Window.unboundedPreceding, 0)


def equity(rows: DataFrame, keys: list[str], capital: float, unit: float, order: str = "bar") -> DataFrame:
    """Adds equity = capital + running sum of pnl * unit; an unknown pnl counts 0."""
    _, run = _run(keys, order)
    return rows.withColumn("equity", F.lit(float(capital)) + F.sum(F.coalesce("pnl", F.lit(0.0)) * F.lit(float(unit))).over(run))


def drawdown(rows: DataFrame, keys: list[str], order: str = "bar", from_zero: bool = False) -> DataFrame:
    """Adds cum and drawdown = running maximum of cum - cum; from_zero lets the maximum start at 0 instead of the first value."""
    _, run = _run(keys, order)
    rows = rows.withColumn("cum", F.sum(F.coalesce("pnl", F.lit(0.0))).over(run))
    top = F.max("cum").over(run)
    return rows.withColumn("drawdown", (F.greatest(top, F.lit(0.0)) if from_zero else top) - F.col("cum"))


def sharpe(mean: Column, dev: Column, per_year: Column | float) -> Column:
    return mean * per_year / F.nullif(dev * F.sqrt(F.lit(per_year) if isinstance(per_year, float | int) else per_year), F.lit(0.0))


def performance(rows: DataFrame, keys: list[str], per_year: float, order: str = "bar", from_zero: bool = False) -> DataFrame:
    """A row for each key: n, ann_return, ann_vol (population), sharpe (NULL without deviation), max_drawdown."""
    d = drawdown(rows, keys, order, from_zero)
    mean, dev = F.avg("pnl"), F.stddev_pop("pnl")
    return d.groupBy(*keys).agg(
        F.count("pnl").alias("n"), (mean * per_year).alias("ann_return"), (dev * F.sqrt(F.lit(float(per_year)))).alias("ann_vol"),
        sharpe(mean, dev, float(per_year)).alias("sharpe"), F.max("drawdown").alias("max_drawdown"),
    )


def costed(rows: DataFrame, grid: tuple[int, ...] = COSTS) -> DataFrame:
    """rows (pnl, turnover) once for each cost: cost_bps, pnl less turnover * cost."""
    bps = F.explode(F.array(*(F.lit(c) for c in grid)))
    return rows.withColumn("cost_bps", bps).withColumn("pnl", F.col("pnl") - F.coalesce("turnover", F.lit(0.0)) * F.col("cost_bps") / F.lit(1e4))


def position_turnover(rows: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    w, _ = _run(keys, order)
    return rows.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))


def breakeven(table: DataFrame, keys: list[str]) -> DataFrame:
    """The least cost at which the Sharpe ratio is not positive."""
    return table.groupBy(*keys).agg(F.min(F.when(F.col("sharpe") <= 0, F.col("cost_bps"))).alias("breakeven_bps"))


def by_symbol(trades: DataFrame) -> DataFrame:
    """Trades, mean profit, total profit, share with profit of each symbol."""
    return trades.groupBy("symbol").agg(
        F.count("*").alias("n_trades"), F.avg("pnl").alias("mean_pnl"), F.sum("pnl").alias("pnl"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("hold_bars").alias("mean_hold")
    )


def summary(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trades, share with profit, mean hold, best and worst profit; one row without keys."""
    return trades.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("hold_bars").alias("avg_hold"),
        F.max("pnl").alias("best"), F.min("pnl").alias("worst"),
    )


def by_ticker(legs: DataFrame) -> DataFrame:
    """Legs, buys and sells, mean amount, mean move (signed by the side) and money won of each symbol. legs: symbol, side, amount, move_pct."""
    side = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0))
    return legs.groupBy("symbol").agg(
        F.count("*").alias("legs"), side("buy").alias("longs"), side("sell").alias("shorts"), F.avg("amount").alias("mean_amount"), F.avg("move_pct").alias("mean_move"),
        F.sum(F.col("amount") * F.col("move_pct") / 100).alias("won"),
    )


def numbered(trades: DataFrame, ties: list[str], at: str = "entry_ts") -> DataFrame:
    """Adds number: 1, 2, 3 … in the order of entry, over all keys.

    Trades are numbered within the day of their entry; only the list of days is ordered as a whole.
    """
    days = trades.withColumn("day", F.to_date(at))
    size = days.groupBy("day").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("day").orderBy(at, *ties))
    return days.withColumn("within", within).join(size.select("day", before.alias("before")), "day").withColumn("number", F.col("before") + F.col("within")).drop("day", "within", "before")


def activity(rows: DataFrame, keys: list[str], per_year: float, order: str = "i") -> DataFrame:
    """Share of bars that are not qualified, share without a position, and turnover a year. rows: position, qualified."""
    t = position_turnover(rows, keys, order)
    return t.groupBy(*keys).agg(
        F.avg(F.when(F.col("qualified"), 0.0).otherwise(1.0)).alias("disqualified"), F.avg(F.when(F.col("position") == 0, 1.0).otherwise(0.0)).alias("idle"),
        (F.sum("turnover") * F.lit(float(per_year)) / F.count("*")).alias("turnover_year"),
    )


def capital(rows: DataFrame, keys: list[str], units: DataFrame, start: float) -> DataFrame:
    """Final equity and total return in per cent of a starting capital. units: keys, unit (money behind one unit of profit)."""
    won = rows.groupBy(*keys).agg(F.sum(F.coalesce("pnl", F.lit(0.0))).alias("won")).join(units, keys)
    final = F.lit(float(start)) + F.col("won") * F.col("unit")
    return won.select(*keys, "unit", final.alias("final"), ((final / F.lit(float(start)) - 1) * 100).alias("total_return_pct"))


def reasons(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return trades.groupBy(*(keys or []), "exit_reason").agg(F.count("*").alias("n"))


def block_bootstrap(rows: DataFrame, values: list[str], length: int, boots: int, order: str = "bar") -> DataFrame:
    """Moving-block bootstrap without materialising resamples: boot, and for each value its sum, sum of squares and count.

    Block k of draw b starts at row (7919 b + 104729 k) mod (n - length + 1), a fixed sequence that any engine can repeat; the
    last block is cut so that a draw has n rows. A block is the difference of two running sums. That sequence gives n - length + 1
    different draws at most; `resampling` has more, and many series at once.
    """
    n = rows.count()
    length = min(length, n)
    blocks = -(-n // length)
    # rows are numbered once; the running sums of the whole series are small next to what the draws would be
    w = Window.orderBy(order)
    base = rows.select((F.row_number().over(w)).cast("long").alias("r"), *values)
    run = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    sums = [f(v).alias(f"{p}{v}") for v in values for p, f in (("s_", lambda v: F.sum(F.coalesce(v, F.lit(0.0))).over(run)), ("q_", lambda v: F.sum(F.coalesce(F.col(v) * F.col(v), F.lit(0.0))).over(run)), ("c_", lambda v: F.count(v).over(run)))]
    acc = base.select("r", *sums)
    names = [f"{p}{v}" for v in values for p in ("s_", "q_", "c_")]
    zero = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("r"), *(F.lit(0.0 if x[0] != "c" else 0).cast("double" if x[0] != "c" else "long").alias(x) for x in names))
    acc = acc.unionByName(zero)
    draws = rows.sparkSession.range(boots * blocks).select(F.floor(F.col("id") / blocks).alias("boot"), (F.col("id") % blocks).alias("k"))
    first = F.pmod(F.col("boot") * 7919 + F.col("k") * 104729, F.lit(n - length + 1))
    draws = draws.withColumn("r0", first).withColumn("r1", first + F.least(F.lit(length), n - F.col("k") * length))
    a = acc.select(F.col("r").alias("r0"), *(F.col(x).alias(f"{x}0") for x in names))
    b = acc.select(F.col("r").alias("r1"), *(F.col(x).alias(f"{x}1") for x in names))
    return draws.join(a, "r0").join(b, "r1").groupBy("boot").agg(*(F.sum(F.col(f"{x}1") - F.col(f"{x}0")).alias(x) for x in names))


def boot_sharpe(draws: DataFrame, value: str, per_year: float) -> DataFrame:
    """boot, sharpe of each draw (NULL where it has no deviation)."""
    n = F.nullif(F.col(f"c_{value}"), F.lit(0))
    mean = F.col(f"s_{value}") / n
    var = F.greatest(F.col(f"q_{value}") / n - mean * mean, F.lit(0.0))
    return draws.select("boot", (mean * F.sqrt(F.lit(float(per_year))) / F.nullif(F.sqrt(F.when(var > 1e-24, var).otherwise(0.0)), F.lit(0.0))).alias("sharpe"))


def significance(sharpes: DataFrame) -> DataFrame:
    """p05, p50, p95, share of positive draws (degenerate ones count as not positive), degenerate draws."""
    q = F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return sharpes.agg(q.alias("q"), F.avg(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0)).alias("p_positive"), F.sum(F.when(F.col("sharpe").isNull(), 1).otherwise(0)).alias("degenerate")).select(
        F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "p_positive", "degenerate"
    )


def deflated(rows: DataFrame, trials: int, deviation: float, sharpe_col: str = "sharpe_bar", n_col: str = "n", skew: float = 0.0, kurtosis: float = 3.0) -> DataFrame:
    """Adds dsr: the chance that a Sharpe ratio (for one bar) beats the best of so many trials without skill."""
    best = expected_max_sharpe(trials, deviation)
    s, n = F.col(sharpe_col), F.col(n_col)
    return rows.withColumn("dsr", normal_cdf((s - F.lit(best)) / sharpe_error(s, n, skew, kurtosis)))


def leaderboard(evaluations: DataFrame) -> DataFrame:
    return evaluations.orderBy(F.desc_nulls_last("dsr"), F.desc_nulls_last("pct_profitable"), "family")
