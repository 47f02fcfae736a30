"""Pair screens and z-scores of spreads. A pair's rows are those of panel.pairs(): a, b, ts, pa, pb, i, sess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions import stats
from barflow.operators.indicators import realized_vol

KEY = ["a", "b"]


def spreads(rows: DataFrame) -> DataFrame:
    """Adds la, lb (logs), alpha, beta of the whole sample, and spread = la - beta * lb - alpha."""
    w = Window.partitionBy(*KEY)  # the partitioning that the rows already have
    rows = rows.withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb"))
    rows = rows.withColumn("alpha", F.regr_intercept("la", "lb").over(w)).withColumn("beta", F.regr_slope("la", "lb").over(w))
    return rows.withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))


def screen(rows: DataFrame, critical: float = -2.86, cutoff: float = 0.45, bars_per_day: float | None = None, beta_range: tuple[float, float] | None = None) -> DataFrame:
    """A row for each pair: beta, n_bars, gamma, adf_stat, sigma, h, half_life_bars, half_life_days, qualifies."""
    s = spreads(rows)
    tests = stats.changes(s, KEY, "spread").groupBy(*KEY).agg(F.first("beta").alias("beta"), F.count("*").alias("n_bars"), *stats.unit_root())
    return ranked(tests.join(stats.hurst_by(s, KEY, "spread"), KEY), critical, cutoff, bars_per_day, beta_range)


def verdicts(tests: DataFrame, critical: float, cutoff: float, bars_per_day: float | None = None, beta_range: tuple[float, float] | None = None) -> DataFrame:
    """The verdict on each pair's a, b, beta, n_bars, gamma, tau, sigma, h."""
    out = tests.withColumn("half_life_bars", stats.half_life())
    good = (F.col("tau") < critical) & (F.col("h") < cutoff) & F.col("half_life_bars").isNotNull()
    if beta_range:
        good &= (F.col("beta") > beta_range[0]) & (F.col("beta") < beta_range[1])
    return out.select(
        F.concat_ws("/", *KEY).alias("pair"), *KEY, "beta", "n_bars", "gamma", F.col("tau").alias("adf_stat"), "sigma", "h", "half_life_bars",
        (F.col("half_life_bars") / F.lit(bars_per_day)).alias("half_life_days"), F.coalesce(good, F.lit(False)).alias("qualifies"),
    )


def ranked(tests: DataFrame, critical: float, cutoff: float, bars_per_day: float | None = None, beta_range: tuple[float, float] | None = None) -> DataFrame:
    """The same, best unit-root statistic first."""
    return verdicts(tests, critical, cutoff, bars_per_day, beta_range).orderBy("adf_stat", "pair")


def selected(screened: DataFrame, a: str | None = None, b: str | None = None, prefer_qualified: bool = True) -> DataFrame:
    """One pair: the named one in either order, else the best qualifying one (or simply the best)."""
    if a is not None:
        return screened.where(((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a))).limit(1)
    order = [F.col("qualifies").desc()] if prefer_qualified else []
    return screened.orderBy(*order, "adf_stat", "pair").limit(1)


def vol_screen(rows: DataFrame, w: int = 12, critical: float = -2.86, cutoff: float = 0.45) -> DataFrame:
    """The same tests on each symbol's own realised volatility; rows: indexed bars."""
    rv = realized_vol(rows, w).where("rv IS NOT NULL").withColumnRenamed("bar", "i")
    tests = stats.changes(rv, ["symbol"], "rv").groupBy("symbol").agg(*stats.unit_root())
    out = tests.join(stats.hurst_by(rv, ["symbol"], "rv"), "symbol")
    good = (F.col("tau") < critical) & (F.col("h") < cutoff)
    return out.select("symbol", F.col("tau").alias("adf_stat"), "h", F.coalesce(good, F.lit(False)).alias("qualifies")).orderBy("adf_stat", "symbol")


def z_of(value: Column, mean: Column, dev: Column) -> Column:
    return (value - mean) / F.nullif(dev, F.lit(0.0))


def session_z(rows: DataFrame, value: str, keys: list[str], window: int = 60, least: int = 10, limit: float | None = None, order: str = "i") -> DataFrame:
    """Adds z against the last `window` rows before, of the same session; 0 under `least` known values or without deviation.

    limit clips z on both sides; it also asks for `least` rows, known or not.
    """
    w = Window.partitionBy(*keys, "sess").orderBy(order).rowsBetween(-window, -1)
    z = z_of(F.col(value), F.avg(value).over(w), F.stddev_pop(value).over(w))
    z = F.when(F.count(value).over(w) >= least, F.coalesce(z, F.lit(0.0))).otherwise(0.0)
    if limit is not None:
        z = F.least(F.greatest(z, F.lit(-limit)), F.lit(limit))
    return rows.withColumn("z", z)


def rolling_z(rows: DataFrame, value: str, keys: list[str], window: int, order: str = "i") -> DataFrame:
    """Adds z against the last `window` rows with the current one, sample deviation; NULL until the window is full."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    z = z_of(F.col(value), F.avg(value).over(w), F.stddev_samp(value).over(w))
    return rows.withColumn("z", F.when(F.count(value).over(w) == window, z))


def ols_z(rows: DataFrame, window: int) -> DataFrame:
    """Adds alpha, beta of la on lb over the `window` rows before, and the z of the current residual against theirs."""
    w = Window.partitionBy(*KEY).orderBy("i").rowsBetween(-window, -1)
    beta, alpha = F.regr_slope("la", "lb").over(w), F.regr_intercept("la", "lb").over(w)
    n, syy, sxy = (f("la", "lb").over(w) for f in (F.regr_count, F.regr_syy, F.regr_sxy))
    rows = rows.withColumn("beta", F.when(n == window, beta)).withColumn("alpha", F.when(n == window, alpha))
    dev = F.sqrt(F.greatest(syy - F.col("beta") * sxy, F.lit(0.0)) / F.nullif(n, F.lit(0)))
    # residuals of a regression with intercept have mean 0
    return rows.withColumn("z", z_of(F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"), F.lit(0.0), dev))


def variable_z(rows: DataFrame, window: str = "zw", least: int = 10) -> DataFrame:
    """Adds z of the spread la - beta lb - alpha against the `window` rows before, each row with its own window, alpha and beta.

    The window's moments are differences of running sums (of logs centred by pair), looked up at two rows: no frame for each row.
    """
    w = Window.partitionBy(*KEY)
    c = rows.withColumn("ca", F.col("la") - F.avg("la").over(w)).withColumn("cb", F.col("lb") - F.avg("lb").over(w))
    run = w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    terms = {"sa": "ca", "sb": "cb", "saa": "ca * ca", "sbb": "cb * cb", "sab": "ca * cb"}
    for name, x in terms.items():
        c = c.withColumn(name, F.coalesce(F.sum(F.expr(x)).over(run), F.lit(0.0)))
    c = c.withColumn("from_i", F.greatest(F.col("i") - F.col(window), F.lit(0)))
    base = c.select(*KEY, F.col("i").alias("from_i"), *(F.col(k).alias(f"{k}0") for k in terms))
    c = c.join(base, [*KEY, "from_i"])
    n = (F.col("i") - F.col("from_i")).cast("double")
    m = {k: (F.col(k) - F.col(f"{k}0")) / F.nullif(n, F.lit(0.0)) for k in terms}
    mean = m["sa"] - F.col("beta") * m["sb"]
    var = (m["saa"] - m["sa"] * m["sa"]) + F.col("beta") * F.col("beta") * (m["sbb"] - m["sb"] * m["sb"]) - 2 * F.col("beta") * (m["sab"] - m["sa"] * m["sb"])
    value = F.col("ca") - F.col("beta") * F.col("cb")
    z = F.when((n >= least) & (var > 1e-18), (value - mean) / F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)
    return c.withColumn("z", z).drop("ca", "cb", "from_i", *terms, *(f"{k}0" for k in terms))


def window_length(half: Column, least: int = 10, most: int = 500) -> Column:
    """Three half-lives, rounded half to even, within bounds; the upper bound without a half-life."""
    return F.coalesce(F.least(F.greatest(F.bround(3 * half).cast("long"), F.lit(least)), F.lit(most)), F.lit(most)).cast("long")


def windows(rows: DataFrame, lookback: int, every: int, start: int | str = 0, least: int = 50) -> DataFrame:
    """The rows behind each refit: those of the `lookback` sessions before it, with refit (session), rows (their number), alpha, beta, spread.

    Refits come every `every` sessions from session `start` on, a number or a column of rows. Windows of sessions are unfolded to
    single sessions so that the join is by equality. Refits with under `least` rows are left out.
    """
    s = rows.withColumn("la", F.ln("pa")).withColumn("lb", F.ln("pb"))
    first = F.col(start) if isinstance(start, str) else F.lit(start)
    at = s.select(*KEY, F.col("sess").alias("refit"), first.alias("first")).distinct()
    at = at.where((F.col("refit") >= F.col("first")) & ((F.col("refit") - F.col("first")) % every == 0) & (F.col("refit") > 0)).drop("first")
    need = at.withColumn("sess", F.explode(F.sequence(F.greatest(F.col("refit") - lookback, F.lit(0)), F.col("refit") - 1)))
    win = need.join(s, [*KEY, "sess"])
    key = [*KEY, "refit"]
    fit = win.groupBy(*key).agg(F.count("*").alias("rows"), *stats.hedge("la", "lb")).where(F.col("rows") >= least)
    return win.join(fit, key).withColumn("spread", F.col("la") - F.col("beta") * F.col("lb") - F.col("alpha"))


def walk_forward(rows: DataFrame, lookback: int = 20, every: int = 5, start: int | str = 0, critical: float = -2.86, cutoff: float = 0.5, least: int = 50, min_window: int = 10, max_window: int = 500) -> DataFrame:
    """Refits of every pair, on windows(): a, b, refit (session), n, alpha, beta, adf_stat, h, half_life, zw, gamma, sigma, qualified.

    Where a refit is left out, the fit before stays in force.
    """
    key = [*KEY, "refit"]
    win = windows(rows, lookback, every, start, least)
    tests = stats.changes(win, key, "spread").groupBy(*key).agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.first("rows").alias("n_rows"), *stats.unit_root())
    out = tests.join(stats.hurst_by(win, key, "spread"), key).withColumn("half_life", stats.half_life())
    good = (F.col("tau") < critical) & (F.col("h") < cutoff) & F.col("half_life").isNotNull()
    return out.select(
        *key, F.col("n_rows").alias("n"), "alpha", "beta", F.col("tau").alias("adf_stat"), "h", "half_life",
        window_length(F.col("half_life"), min_window, max_window).alias("zw"), "gamma", "sigma", F.coalesce(good, F.lit(False)).alias("qualified"),
    )


def held(rows: DataFrame, fits: DataFrame, names: tuple[str, ...] = ("alpha", "beta", "zw", "qualified")) -> DataFrame:
    """rows with `names` of the last refit at or before each row's session."""
    state = F.struct(*names)
    first = rows.groupBy(*KEY, "sess").agg(F.min("i").alias("i"))
    marks = first.join(fits.withColumnRenamed("refit", "sess").select(*KEY, "sess", state.alias("fit")), [*KEY, "sess"], "left")
    carried = marks.withColumn("fit", F.last("fit", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("sess"))).select(*KEY, "sess", "fit")
    out = rows.join(carried, [*KEY, "sess"], "left")
    return out.select("*", *(F.col(f"fit.{n}").alias(n) for n in names)).drop("fit")
