"""Delimited price files of unknown dialect as panels, and files of results.

The head of a file decides separator, decimal sign and columns on the driver; rows are then read as text by Spark and parsed
in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names that are looked for, in this order (fixed values).
DATE = ("datetime", "date", "timestamp", "time", "tarih", "tarih_saat", "gun")
TIME = ("time", "saat", "hour")
TICKER = ("ticker", "symbol", "sembol", "hisse", "kod", "code", "name", "isim")
CLOSE = ("close", "adj close", "adjclose", "kapanis", "kapanış", "kapanis_fiyat", "son", "son_fiyat", "price", "fiyat", "c")
SEPARATORS = (";", ",", "\t", "|")
#: Date forms: year first, then day first (fixed values).
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")


def pick(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    """The first wanted name among the columns, without regard to case and blanks."""
    own = {c.strip().lower(): c for c in columns}
    return next((own[w] for w in wanted if w in own), None)


def dialect(head: list[str]) -> tuple[str, str]:
    """Separator and decimal sign of some first lines: the separator with the most columns that all lines share."""
    lines = [x for x in head if x.strip()]
    if not lines:
        raise ValueError("the file is empty")
    best = max(SEPARATORS, key=lambda s: (min(x.count(s) for x in lines), -SEPARATORS.index(s)))
    if not lines[0].count(best):
        raise ValueError("no separator found")
    cells = [c.strip() for x in lines[1:] for c in x.split(best)]
    comma = sum(c.replace(",", "", 1).lstrip("-").isdigit() and "," in c for c in cells)
    point = sum(c.replace(".", "", 1).lstrip("-").isdigit() and "." in c for c in cells)
    return best, "," if comma > point and best != "," else "."


def number(c: Column, decimal: str) -> Column:
    """A price as double; what is no number, or not finite, is NULL."""
    text = F.trim(c)
    text = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".") if decimal == "," else text
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


#: An offset at the end of a time: Z, or hours and minutes.
OFFSET = r"\s*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def moment(c: Column, zone: str | None = None, drop_offset: bool = False) -> Column:
    """A time from any known form, as a UTC wall clock; NULL if it has none.

    A time with an offset is an instant. One without is local to `zone` if given. drop_offset keeps the wall clock as it is
    written and ignores offset and zone.
    """
    text = F.trim(c)
    offset = F.regexp_extract(text, OFFSET, 1)
    bare = F.regexp_replace(text, OFFSET, "")
    has = (offset != "") & (F.instr(bare, ":") > 0)  # a date alone has no offset: its last digits are a year
    wall = F.coalesce(*(F.try_to_timestamp(F.when(has, bare).otherwise(text), F.lit(f)) for f in FORMATS))
    if drop_offset:
        return wall
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = F.when(digits == "", 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    return F.when(has, wall - F.make_dt_interval(mins=minutes)).otherwise(F.to_utc_timestamp(wall, zone) if zone else wall)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, in any store, is a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def load_panel(
    spark: SparkSession, path: str, zone: str | None = None, date_col: str | None = None, ticker_col: str | None = None, close_col: str | None = None,
    drop_offset: bool = False,
) -> DataFrame:
    """symbol, ts, close from a wide file (a column for each symbol), a long file, or a folder of files of one symbol each.

    Files of a folder are named by their symbol and share one dialect. A second column may hold the time of day; offsets and
    `zone` as in moment(). The last quote of a bar and symbol counts; rows without time, symbol or price are left out, and
    unread() counts them. A file in which no time can be read is refused.
    """
    head = [r[0] for r in spark.read.text(path).limit(20).collect()]
    sep, decimal = dialect(head)
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("enforceSchema", False).csv(path).withColumn("__at", F.monotonically_increasing_id())
    columns = [c for c in raw.columns if c != "__at"]
    date = date_col or pick(columns, DATE) or columns[0]
    ticker, close = ticker_col or pick(columns, TICKER), close_col or pick(columns, CLOSE)
    time = pick([c for c in columns if c != date], TIME)
    others = [c for c in columns if c not in (date, time)]
    raw = raw.withColumn("__d", F.concat_ws(" ", F.trim(date), F.trim(time)) if time else F.trim(date))
    if is_folder(spark, path):
        close = close or (others[0] if len(others) == 1 else None)
        if close is None:
            raise ValueError(f"no close column in {columns}")
        symbol, price = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1), F.col(close)
        rows = raw.select(symbol.alias("symbol"), "__d", price.alias("p"), "__at")
    elif ticker and close:
        rows = raw.select(F.col(ticker).alias("symbol"), "__d", F.col(close).alias("p"), "__at")
    else:
        rows = raw.unpivot(["__d", "__at"], others, "symbol", "p")
    rows = rows.select(F.upper(F.trim("symbol")).alias("symbol"), moment(F.col("__d"), zone, drop_offset).cast("timestamp_ntz").alias("ts"), number(F.col("p"), decimal).alias("close"), "__at")
    if not rows.isEmpty() and rows.where("ts IS NOT NULL").isEmpty():
        raise ValueError(f"no time can be read in column {date}")
    rows = rows.where("symbol IS NOT NULL AND ts IS NOT NULL AND close IS NOT NULL")
    return rows.groupBy("symbol", "ts").agg(F.max_by("close", "__at").alias("close"))


def unread(spark: SparkSession, path: str, column: str, zone: str | None = None) -> DataFrame:
    """file, rows, without_time of a file or folder with a header: rows whose `column` has no time that moment() knows."""
    sep, _ = dialect([r[0] for r in spark.read.text(path).limit(20).collect()])
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    bad = F.sum(F.when(moment(F.col(column), zone).isNull(), 1).otherwise(0))
    return raw.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), bad.alias("without_time"))


def one_symbol(bars: DataFrame, symbol: str) -> DataFrame:
    """The bars of one symbol in the order of time, without rows that have no price at all; a symbol without bars is refused."""
    prices = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    out = bars.where(F.col("symbol") == symbol).where(F.coalesce(*prices).isNotNull())
    if out.isEmpty():
        raise ValueError(f"no bars of {symbol}")
    return out.orderBy("ts")


def check(bars: DataFrame, least: int = 300) -> dict[str, float]:
    """Bars, days and bars a day of a panel; too short a panel is refused."""
    n, days = bars.agg(F.countDistinct("ts"), F.countDistinct(F.to_date("ts"))).first()
    if n < least:
        raise ValueError(f"{n} bars; at least {least} are needed")
    return {"bars": n, "days": days, "bars_per_day": n / days}


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_panel(df: DataFrame, path: str) -> None:
    """Parquet, dealt by symbol so that a scan of few symbols reads few files."""
    df.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").parquet(path)
