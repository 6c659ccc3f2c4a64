"""Loading bars for backtests and pages: views over markets, selections, cleaning and summaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.indicators import in_time

BAR_SCHEMA = (
    "market string, ticker string, date date, open double, high double, low double, close double, volume double"
)
PRICES = ["open", "high", "low", "close"]


def market_view(frame: DataFrame, market: str) -> DataFrame:
    """A market's own bars with its label."""
    return frame.withColumn("market", F.lit(market))


def unified_view(spark: SparkSession, frames: dict[str, DataFrame | None], schema: str = BAR_SCHEMA) -> DataFrame:
    """All markets that are there, by column name, with their labels; an empty typed view when none is."""
    present = [market_view(f, m) for m, f in frames.items() if f is not None]
    if not present:
        return spark.createDataFrame([], schema)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present).select(*names)


def select_tickers(frame: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows of the tickers in a list; a ticker listed twice does not repeat its rows."""
    return frame.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def clean_history(frame: DataFrame, version: str, fill: str | None = "ffill") -> DataFrame:
    """One row a (ticker, date), the one with the largest ``version``, of equal ones that of the first market; gaps filled forward or
    backward within a ticker; rows without any price dropped."""
    last = Window.partitionBy("ticker", "date").orderBy(F.desc(version), *in_time(frame))
    rows = frame.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", version)
    if fill:
        by = Window.partitionBy("ticker").orderBy("date")
        ends = (Window.unboundedPreceding, 0) if fill == "ffill" else (0, Window.unboundedFollowing)
        take = F.last if fill == "ffill" else F.first
        rows = rows.withColumns({c: take(c, ignorenulls=True).over(by.rowsBetween(*ends)) for c in [*PRICES, "volume"]})
    return rows.dropna("all", subset=PRICES)


def backtest_load(
    frames: DataFrame, tickers: DataFrame | None, start: str, end: str, version: str, fill: str | None = "ffill"
) -> DataFrame:
    """The bars of a ticker list between two dates, cleaned."""
    chosen = frames if tickers is None else select_tickers(frames, tickers)
    return clean_history(chosen.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), version, fill)


def tickers_as_of(bars: DataFrame, date: str) -> DataFrame:
    return bars.where(F.col("date") <= F.lit(date).cast("date")).select("market", "ticker").distinct()


def date_range(bars: DataFrame, *by: str) -> DataFrame:
    return bars.groupBy(*by).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def feature_check(bars: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Rows, tickers and latest date of the days before ``as_of``, and whether there are any."""
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    seen = bars.where(F.col("date") >= start).agg(
        F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("tickers"), F.max("date").alias("latest_date")
    )
    return seen.withColumn("status", F.when(F.col("n_rows") > 0, "ok").otherwise("empty"))


def dataset_summary(frames: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(dataset, n_rows, symbols, latest) of named frames, given with their symbol and date columns."""
    parts = [
        f.agg(
            F.lit(name).alias("dataset"), F.count("*").alias("n_rows"), F.countDistinct(symbol).alias("symbols"),
            F.max(date).cast("date").cast("string").alias("latest"),
        )
        for name, (f, symbol, date) in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def browse_latest(bars: DataFrame, k: int = 100) -> DataFrame:
    """The newest rows; equal dates by market and ticker."""
    return bars.orderBy(F.desc("date"), "market", "ticker").limit(k)


def present_on(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, n_rows, present): whether bars exist for each asked date."""
    n = F.coalesce("n_rows", F.lit(0))
    counts = bars.groupBy("date").agg(F.count("*").alias("n_rows"))
    return dates.join(counts, "date", "left").select("date", n.alias("n_rows"), (n > 0).alias("present"))


def newest(history: DataFrame, on: str, *ties: str, k: int = 20) -> DataFrame:
    """The last ``k`` entries of a history."""
    return history.orderBy(F.desc(on), *ties).limit(k)


def walks_of(bars: DataFrame) -> DataFrame:
    """(market, ticker, id, first, drift, spread, size) of each ticker's bars: its last close, mean and deviation of its log returns, and mean
    log volume, from which walks like its own go on."""
    step = F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")))
    rows = bars.withColumn("_step", step)
    return rows.groupBy("market", "ticker").agg(
        F.max_by("close", "date").alias("first"), F.coalesce(F.avg("_step"), F.lit(0.0)).alias("drift"),
        F.coalesce(F.stddev_samp("_step"), F.lit(0.015)).alias("spread"), F.avg(F.ln(F.greatest("volume", F.lit(1.0)))).alias("size"),
    ).withColumn("id", F.xxhash64("ticker"))


def synthetic_bars(spark: SparkSession, tickers: int, days: int, start: str = "2020-01-01", seed: int = 42) -> DataFrame:
    """Bars of ``tickers`` walks of usual drift, spread and volume."""
    ids, ticker = F.col("id"), F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 6, "0"))
    first = F.lit(20.0) + F.pmod(F.xxhash64(ids, F.lit(seed)), F.lit(180))
    usual = {"drift": 0.0003, "spread": 0.015, "size": 13.0}
    walks = spark.range(tickers).select(F.lit("us").alias("market"), ticker.alias("ticker"), "id", first.alias("first"), *[F.lit(v).alias(k) for k, v in usual.items()])
    return walk_on(walks, days, start, seed)


def walk_on(walks: DataFrame, days: int, start: str = "2020-01-01", seed: int = 42) -> DataFrame:
    """Bars of geometric random walks (see ``walks_of``) on weekdays: drift, overnight gaps, log-normal volumes. A ticker has its own
    seed's numbers, each row's from its hash, so they do not change with partitions."""
    length = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("d")
    grid = walks.select("*", length).withColumn("date", F.date_add(F.lit(start).cast("date"), F.col("d")))
    rows = grid.where(F.weekday("date") < 5)

    def uniform(k: int) -> Column:
        return (F.pmod(F.xxhash64("id", "d", F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def normal(k: int) -> Column:
        return F.sqrt(-2 * F.log(uniform(k))) * F.cos(2 * math.pi * uniform(k + 1))

    rows = rows.withColumns({"_gap": normal(0) * 0.005, "_step": F.col("drift") + normal(2) * F.col("spread"), "_wick": F.abs(normal(4)) * 0.004})
    by = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("close", F.col("first") * F.exp(F.sum(F.col("_gap") + F.col("_step")).over(by)))
    rows = rows.withColumn("open", F.col("close") / F.exp("_step"))
    return rows.select(
        "market", "ticker", "date", "open",
        (F.greatest("open", "close") * (1 + F.col("_wick"))).alias("high"), (F.least("open", "close") * (1 - F.col("_wick"))).alias("low"),
        "close", F.floor(F.exp(F.col("size") + normal(6) * 0.5)).cast("double").alias("volume"),
    )


#: From narrow to wide: what a column becomes when frames with other types meet.
_WIDER = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string")


def supertype(kinds: set[str]) -> str:
    """The narrowest type that holds values of all ``kinds``; a decimal or date beside anything else becomes a number or text."""
    kinds = {k for k in kinds if k != "void"} or {"string"}
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp"
    if any(k not in _WIDER and not k.startswith("decimal") for k in kinds):
        return "string"
    wide = max((_WIDER.index("double") if k.startswith("decimal") else _WIDER.index(k)) for k in kinds)
    found = _WIDER[wide]
    if found == "string" or "boolean" in kinds:
        return "string" if "string" in kinds else found
    return "double" if found == "float" and kinds & {"int", "bigint"} else found


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that some frames lack are null there, and columns of other types meet in the narrowest type that holds both."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    kinds = [{f.name: f.dataType.simpleString() for f in frame.schema} for frame in frames]
    wide = {n: supertype({k[n] for k in kinds if n in k}) for n in names}
    one = lambda f: f.select(*[(F.col(f"`{n}`") if n in f.columns else F.lit(None)).cast(wide[n]).alias(n) for n in names])
    return reduce(DataFrame.union, map(one, frames))


def of_day(frame: DataFrame, day: str, on: str = "date") -> DataFrame:
    """The rows of one day; on a table partitioned by it, its folder only."""
    return frame.where(F.col(on) == F.lit(day).cast(frame.schema[on].dataType))
