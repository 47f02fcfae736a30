"""Moving-block bootstrap of many series at once, without resamples and without a window over a whole series.

Rows are numbered and summed in two levels: running sums within chunks of order numbers, and the sums of the chunks before, which are
one row a chunk. A block is the difference of two running sums, found by two equi-joins. Where a block starts is taken from the md5 of
(key, draw, block), which any engine can repeat, so that all pairs, rules or families are one plan and their draws are independent of
how the rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order numbers of a chunk.
CHUNK = 4096


def running(rows: DataFrame, keys: list[str], values: list[str], order: str = "bar", chunk: int = CHUNK) -> DataFrame:
    """keys, r (0 to n) and, for each value, its sum s_, sum of squares q_ and count c_ over the first r rows of the key."""
    terms = {f"s_{v}": F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values} | {f"q_{v}": F.coalesce(F.col(v) * F.col(v), F.lit(0.0)) for v in values}
    terms |= {f"c_{v}": F.when(F.col(v).isNotNull(), 1).otherwise(0).cast("long") for v in values}
    base = rows.select(*keys, order, F.floor(F.col(order) / chunk).alias("chunk"), F.lit(1).cast("long").alias("r"), *(e.alias(c) for c, e in terms.items()))
    names = ["r", *terms]
    # both levels are dealt by (keys, chunk); only the rows of chunks are ordered key by key
    inside = Window.partitionBy(*keys, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = base.groupBy(*keys, "chunk").agg(*(F.sum(c).alias(f"{c}_all") for c in names))
    offset = chunks.select(*keys, "chunk", *(F.coalesce(F.sum(f"{c}_all").over(before), F.lit(0)).alias(f"{c}_0") for c in names))
    own = base.select(*keys, "chunk", *(F.sum(c).over(inside).alias(c) for c in names)).join(offset, [*keys, "chunk"])
    out = own.select(*keys, *((F.col(c) + F.col(f"{c}_0")).alias(c) for c in names))
    zero = chunks.select(*keys).distinct().select(*keys, *(F.lit(0).cast(out.schema[c].dataType).alias(c) for c in names))
    return out.unionByName(zero)


def draws(rows: DataFrame, keys: list[str], values: list[str], length: int, boots: int, order: str = "bar", chunk: int = CHUNK) -> DataFrame:
    """keys, boot, and s_, q_, c_ of each value: a draw has as many rows as its series, in blocks of `length` (the last one cut)."""
    acc = running(rows, keys, values, order, chunk)
    names = [f"{p}_{v}" for v in values for p in ("s", "q", "c")]
    n, size, at = F.col("__n"), F.col("__size"), F.col("__block")  # keys may have any other name
    block = rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__size", F.least(F.lit(length).cast("long"), n))
    block = block.withColumn("boot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(boots - 1).cast("long"))))
    block = block.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / size) - 1)))
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys), F.col("boot").cast("string"), at.cast("string"))
    first = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % (n - size + 1)
    block = block.withColumn("r0", first).withColumn("r1", F.col("r0") + F.least(size, n - at * size)).select(*keys, "boot", "r0", "r1")
    side = lambda i: acc.select(*keys, F.col("r").alias(f"r{i}"), *(F.col(c).alias(f"{c}{i}") for c in names))
    found = block.join(side(0), [*keys, "r0"]).join(side(1), [*keys, "r1"])
    return found.groupBy(*keys, "boot").agg(*(F.sum(F.col(f"{c}1") - F.col(f"{c}0")).alias(c) for c in names))


def moments(drawn: DataFrame, keys: list[str], value: str, per_year: float, tag: str = "") -> DataFrame:
    """keys, boot, vol and sharpe of each draw (sharpe NULL where there is no deviation), the names with `tag`."""
    n = F.nullif(F.col(f"c_{value}"), F.lit(0))
    mean = F.col(f"s_{value}") / n
    var = F.greatest(F.col(f"q_{value}") / n - mean * mean, F.lit(0.0))
    dev = F.sqrt(F.when(var > 1e-24, var).otherwise(0.0))
    year = F.sqrt(F.lit(float(per_year)))
    return drawn.select(*keys, "boot", (dev * year).alias(f"vol{tag}"), (mean * year / F.nullif(dev, F.lit(0.0))).alias(f"sharpe{tag}"))


def significance(of: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p05, p50, p95, share of positive draws (degenerate ones count as not positive), degenerate draws."""
    q = lambda p: F.percentile("sharpe", F.lit(p))
    share = F.avg(F.when(F.col("sharpe") > 0, 1.0).otherwise(0.0))
    return of.groupBy(*keys).agg(q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), share.alias("p_positive"), F.sum(F.when(F.col("sharpe").isNull(), 1).otherwise(0)).alias("degenerate"))


def paired(rows: DataFrame, keys: list[str], one: str, two: str, length: int, boots: int, per_year: float, order: str = "bar") -> DataFrame:
    """keys, boot, diff (Sharpe ratio of `one` less that of `two`), lower (volatility of `one` under that of `two`): the same rows drawn for both."""
    drawn = draws(rows, keys, [one, two], length, boots, order)
    both = moments(drawn, keys, one, per_year).join(moments(drawn, keys, two, per_year, "2"), [*keys, "boot"])
    return both.select(*keys, "boot", (F.col("sharpe") - F.col("sharpe2")).alias("diff"), (F.col("vol") < F.col("vol2")).alias("lower"))


def interval(of: DataFrame, keys: list[str], level: float = 0.9) -> DataFrame:
    """keys, lo, mid, hi (median and interval of the difference), p_better, p_vol_lower of paired() draws."""
    q = lambda p: F.percentile("diff", F.lit(p))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return of.groupBy(*keys).agg(q((1 - level) / 2).alias("lo"), q(0.5).alias("mid"), q((1 + level) / 2).alias("hi"), share(F.col("diff") > 0).alias("p_better"), share(F.col("lower")).alias("p_vol_lower"))
