"""The named market queries on bars (market, ticker, date, open, high, low, close, volume). Those over the last days take
bars of these days only (``sources.bars.bars`` with ``days``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pct(now: Column, before: Column) -> Column:
    """Change in percent; null where the divisor is 0."""
    return (now - before) / F.nullif(before, F.lit(0.0)) * 100


def latest_summary(bars: DataFrame) -> DataFrame:
    """Each market's latest date with its tickers, rows and volume. One pass: partial sums for each (market, date)."""
    daily = bars.groupBy("market", "date").agg(
        F.countDistinct("ticker").alias("tickers"), F.count("*").alias("n_rows"), F.sum("volume").alias("total_volume")
    )
    last = daily.groupBy("market").agg(F.max_by(F.struct("*"), "date").alias("x"))
    return last.select("x.market", F.col("x.date").alias("latest_date"), "x.tickers", "x.n_rows", "x.total_volume")


def top_volume(bars: DataFrame, k: int = 20) -> DataFrame:
    return (
        bars
        .groupBy("ticker", "market")
        .agg(
            F.sum("volume").alias("total_volume"),
            F.avg("volume").alias("avg_volume"),
            F.countDistinct("date").alias("trading_days"),
        )
        .orderBy(F.desc("total_volume"), "ticker", "market")
        .limit(k)
    )


def gainers_losers(bars: DataFrame, least_days: int, k: int = 30) -> DataFrame:
    moved = (
        bars
        .groupBy("ticker", "market")
        .agg(
            F.min_by("close", "date").alias("start_price"),
            F.max_by("close", "date").alias("end_price"),
            F.countDistinct("date").alias("n"),
        )
        .where(F.col("n") >= least_days)
        .withColumn("pct_change", pct(F.col("end_price"), F.col("start_price")))
    )
    side = F.when(F.col("pct_change") >= 0, "GAINER").otherwise("LOSER")
    return moved.drop("n").withColumn("category", side).orderBy(F.desc("pct_change"), "ticker", "market").limit(k)


def cross_market(bars: DataFrame, ticker: str, k: int = 100) -> DataFrame:
    return (
        bars.where(F.col("ticker") == ticker.upper())
        .select("date", "market", "ticker", "close", "volume")
        .orderBy("market", "date")
        .limit(k)
    )


def moving_average(bars: DataFrame, ticker: str, n: int = 20) -> DataFrame:
    """The latest ``2 n`` bars with the mean of up to ``n`` closes."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(n - 1), 0)
    rows = bars.where(F.col("ticker") == ticker.upper()).select("date", "ticker", "close")
    rows = rows.withColumn("ma", F.avg("close").over(w)).orderBy(F.desc("date")).limit(2 * n)
    return rows.where("ma is not null").withColumn("pct_diff_from_ma", pct(F.col("close"), F.col("ma")))


def volatility(bars: DataFrame, least_days: int, k: int = 20) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    returns = bars.withColumn("r", pct(F.col("close"), before) / 100).where("r is not null")
    return (
        returns.groupBy("ticker", "market")
        .agg(
            (F.avg(F.abs("r")) * 100).alias("avg_daily_move_pct"),
            (F.stddev_samp("r") * 100).alias("volatility_pct"),
            F.countDistinct("date").alias("trading_days"),
        )
        .where(F.col("trading_days") >= least_days)
        .orderBy(F.desc("volatility_pct"), "ticker", "market")
        .limit(k)
    )


def market_stats(bars: DataFrame) -> DataFrame:
    daily = (
        bars.where("volume > 0")
        .groupBy("market", "date")
        .agg(
            F.countDistinct("ticker").alias("tickers"),
            F.sum("volume").alias("volume"),
            F.avg("close").alias("price"),
        )
    )
    return daily.groupBy("market").agg(
        F.count("date").alias("trading_days"),
        F.avg("tickers").alias("avg_tickers"),
        F.avg("volume").alias("avg_volume"),
        F.avg("price").alias("avg_price"),
    )


def price_range(bars: DataFrame, least_days: int, k: int = 30) -> DataFrame:
    ranges = (
        bars
        .groupBy("ticker", "market")
        .agg(
            F.min("close").alias("period_low"),
            F.max("close").alias("period_high"),
            F.max_by("close", "date").alias("current_price"),
            F.countDistinct("date").alias("n"),
        )
        .where(F.col("n") >= least_days)
        .drop("n")
    )
    high, now = F.col("period_high"), F.col("current_price")
    return (
        ranges.withColumn("pct_from_low", pct(now, F.col("period_low")))
        .withColumn("pct_from_high", -pct(now, high))
        .orderBy(F.desc("pct_from_low"), "ticker", "market")
        .limit(k)
    )
