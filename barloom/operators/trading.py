"""Strategies, a vectorised backtest, its metrics, and signals.

Weights set at a close earn from the next bar on. Fees are paid on every change of weight, tax on sales.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.ewm import spans
from barloom.functions.indicators import by_ticker, full, in_time

FEE, TAX = 0.001425, 0.003


class Strategy(ABC):
    """Gives every bar a weight."""

    @abstractmethod
    def weights(self, bars: DataFrame) -> DataFrame:
        """bars with ``weight``"""


class SmaCross(Strategy):
    def __init__(self, fast: int = 10, slow: int = 30):
        self.fast, self.slow = fast, slow

    def weights(self, bars: DataFrame) -> DataFrame:
        rows = bars.withColumns({"_f": full(bars, F.avg, "close", self.fast), "_s": full(bars, F.avg, "close", self.slow)})
        rows = rows.withColumns({"_pf": F.lag("_f").over(by_ticker(bars)), "_ps": F.lag("_s").over(by_ticker(bars))})
        crossed = (F.col("_f") > F.col("_s")) & (F.col("_pf") <= F.col("_ps"))
        return rows.withColumn("weight", F.when(crossed, 1.0).otherwise(0.0)).drop("_f", "_s", "_pf", "_ps")


class EmaCross(Strategy):
    """SmaCross on exponentially weighted means of the given spans."""

    def __init__(self, fast: int = 10, slow: int = 30):
        self.fast, self.slow = fast, slow

    def weights(self, bars: DataFrame) -> DataFrame:
        rows = spans(bars, "close", {"_f": self.fast, "_s": self.slow})
        rows = rows.withColumns({"_pf": F.lag("_f").over(by_ticker(bars)), "_ps": F.lag("_s").over(by_ticker(bars))})
        crossed = (F.col("_f") > F.col("_s")) & (F.col("_pf") <= F.col("_ps"))
        return rows.withColumn("weight", F.when(crossed, 1.0).otherwise(0.0)).drop("_f", "_s", "_pf", "_ps")


class BandReversion(Strategy):
    """Enters where the close falls through the lower band, and is above its mean of ``trend`` bars unless that is None."""

    def __init__(self, n: int = 20, k: float = 2.0, weight: float = 0.95, trend: int | None = 200):
        self.n, self.k, self.weight, self.trend = n, k, weight, trend

    def weights(self, bars: DataFrame) -> DataFrame:
        low = full(bars, F.avg, "close", self.n) - self.k * full(bars, F.stddev_samp, "close", self.n)
        rows = bars.withColumn("_low", low)
        rows = rows.withColumns({"_pl": F.lag("_low").over(by_ticker(bars)), "_pc": F.lag("close").over(by_ticker(bars))})
        entry = (F.col("close") < F.col("_low")) & (F.col("_pc") >= F.col("_pl"))
        if self.trend:
            entry &= F.col("close") > full(bars, F.avg, "close", self.trend)
        return rows.withColumn("weight", F.when(entry, self.weight).otherwise(0.0)).drop("_low", "_pl", "_pc")


class Momentum(Strategy):
    """Equal weights on the best share of tickers, one at least, by lagged return, set on every ``every``-th date and held.
    Dates with fewer than ``least`` returns set nothing, nor do dates without a ticker's return: weights carry on.
    ``short``: share of the worst tickers, one at least, that get equal negative weights; the best share comes first."""

    def __init__(
        self, lookback: int = 252, skip: int = 21, every: int = 21, share: float = 0.3, least: int = 10, short: float | None = None
    ):
        self.lookback, self.skip, self.every, self.share, self.least, self.short = lookback, skip, every, share, least, short

    def weights(self, bars: DataFrame) -> DataFrame:
        old = F.lag("close", self.lookback + self.skip).over(by_ticker(bars))
        rows = bars.withColumn("_r", F.lag("close", self.skip).over(by_ticker(bars)) / F.nullif(old, F.lit(0.0)) - 1)
        dates = rows.groupBy("date").agg(F.count("_r").alias("_n"))
        n = F.row_number().over(Window.orderBy("date")) - 1  # one row a date, whatever the tickers
        rows = rows.join(dates.withColumn("_set", (n % self.every == 0) & (F.col("_n") >= self.least)), "date")
        day = Window.partitionBy("date")
        best = day.orderBy(F.col("_r").desc_nulls_last(), "ticker")
        rows = rows.withColumn("_k", F.row_number().over(best))
        top = F.greatest(F.floor(F.col("_n") * self.share), F.lit(1))
        chosen = F.when(F.col("_k") <= top, 1 / top.cast("double"))
        if self.short is not None:
            low = F.greatest(F.floor(F.col("_n") * self.short), F.lit(1))
            chosen = chosen.when(F.col("_k") > F.col("_n") - low, -1 / low.cast("double"))
        fixed = F.when(F.col("_set") & F.col("_r").isNotNull(), chosen.otherwise(0.0))
        filled = F.last("_w", ignorenulls=True).over(by_ticker(bars).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_w", fixed)
        return rows.withColumn("weight", F.coalesce(filled, F.lit(0.0))).drop("_r", "_set", "_n", "_k", "_w")


def _net(rows: DataFrame, weight: str, fee: float, tax: float) -> Column:
    """A bar's return on the weight held since the bar before, less fees and tax."""
    held = F.coalesce(F.lag(weight).over(by_ticker(rows)), F.lit(0.0))
    ret = F.coalesce(F.col("close") / F.nullif(F.lag("close").over(by_ticker(rows)), F.lit(0.0)) - 1, F.lit(0.0))
    traded = F.col(weight) - held
    return held * ret - F.abs(traded) * fee - F.greatest(-traded, F.lit(0.0)) * tax


def _day(net: str) -> Column:
    return F.greatest(F.avg(net), F.lit(-0.9999))


def equity_curve(weighted: DataFrame, fee: float = FEE, tax: float = TAX) -> DataFrame:
    """date, ret, value, drawdown: the mean over tickers each day, compounded over days. No day loses everything."""
    days = weighted.withColumn("_net", _net(weighted, "weight", fee, tax)).groupBy("date").agg(_day("_net").alias("ret"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    days = days.withColumn("value", F.exp(F.sum(F.log1p("ret")).over(w)))
    return days.withColumn("drawdown", F.col("value") / F.max("value").over(w) - 1)


def metrics(curve: DataFrame, days: int = 252) -> DataFrame:
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    one = curve.agg(
        F.max_by("value", "date").alias("end_value"), F.count("*").alias("n_days"), F.min("drawdown").alias("max_drawdown"),
        F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("sd"), down.alias("down_sd"),
        F.count_if(F.col("ret") > 0).alias("wins"), F.count_if(F.col("ret") != 0).alias("active"),
    )
    year = math.sqrt(days)
    return one.select(
        (F.col("end_value") - 1).alias("total_return"),
        (F.pow("end_value", F.try_divide(F.lit(float(days)), "n_days")) - 1).alias("cagr"),
        "max_drawdown",
        (F.col("sd") * year).alias("volatility"),
        (F.try_divide("mean_ret", "sd") * year).alias("sharpe"),
        (F.try_divide("mean_ret", "down_sd") * year).alias("sortino"),
        F.try_divide(F.col("wins").cast("double"), "active").alias("win_rate"),
    )


def _runs(weighted: DataFrame) -> DataFrame:
    """``trade``: number of the run of bars with a weight that a bar is in or comes after, by ticker."""
    on = (F.col("weight") != 0).cast("int")
    rows = weighted.withColumn("_on", on)
    begins = F.when((F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(by_ticker(rows)), F.lit(0)) == 0), 1).otherwise(0)
    rows = rows.withColumn("_b", begins)
    return rows.withColumn("trade", F.sum("_b").over(by_ticker(rows).rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def trades(weighted: DataFrame) -> DataFrame:
    """Runs of bars with a weight, by ticker: entry, exit, bars and return of the close."""
    rows = _runs(weighted).where("_on = 1")
    at = F.struct(*in_time(rows))
    return rows.groupBy("ticker", "trade").agg(
        F.min("date").alias("entry_date"), F.max("date").alias("exit_date"), F.count("*").alias("n_bars"),
        (F.max_by("close", at) / F.nullif(F.min_by("close", at), F.lit(0.0)) - 1).alias("trade_return"),
    )


def trade_metrics(weighted: DataFrame) -> DataFrame:
    """One row: trades, tickers with any, the share of trades that won, mean bars and mean return of a trade."""
    return trades(weighted).agg(
        F.count("*").alias("n_trades"), F.countDistinct("ticker").alias("n_tickers"),
        F.try_divide(F.count_if(F.col("trade_return") > 0), F.count("*")).alias("win_share"),
        F.avg("n_bars").alias("mean_bars"), F.avg("trade_return").alias("mean_trade_return"),
    )


def with_weights(prices: DataFrame, weights: DataFrame, fill: float = 0.0) -> DataFrame:
    """Prices with the weight of their ticker and date; a bar without one is not held."""
    joined = prices.drop("weight").join(weights.select("ticker", "date", "weight"), ["ticker", "date"], "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(fill)))


def stopped(weighted: DataFrame, stop_loss: float | None = None, take_profit: float | None = None) -> DataFrame:
    """A run of bars with a weight is left at the first close that has lost ``stop_loss`` or won ``take_profit`` since the
    run's first close, in the direction of the weight; it is not entered again before the run ends."""
    rows = _runs(weighted)
    run = Window.partitionBy("ticker", "trade").orderBy(*in_time(rows)).rowsBetween(Window.unboundedPreceding, 0)
    won = (F.col("close") / F.nullif(F.first("close").over(run), F.lit(0.0)) - 1) * F.signum(F.first("weight").over(run))
    rows = rows.withColumn("_won", won)
    hit = F.lit(False)
    if stop_loss is not None:
        hit |= F.col("_won") <= -stop_loss
    if take_profit is not None:
        hit |= F.col("_won") >= take_profit
    rows = rows.withColumn("_hit", F.coalesce((F.col("_on") == 1) & hit, F.lit(False)).cast("int"))
    left = F.max("_hit").over(run) == 1
    return rows.withColumn("weight", F.when(left, 0.0).otherwise(F.col("weight"))).drop("_on", "trade", "_won", "_hit")


def resampled(weighted: DataFrame, period: str = "month") -> DataFrame:
    """Weights change only at a ticker's last bar of each week, month or quarter, and are held until the next one."""
    part = F.trunc("date", period)
    ends = F.coalesce(F.lead(part).over(by_ticker(weighted)) != part, F.lit(True))
    rows = weighted.withColumn("_w", F.when(ends, F.col("weight")))
    held = F.last("_w", ignorenulls=True).over(by_ticker(weighted).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("weight", F.coalesce(held, F.lit(0.0))).drop("_w")


def grid(bars: DataFrame, strategies: dict[str, Strategy], target: str = "sharpe", fee: float = FEE, tax: float = TAX) -> DataFrame:
    """(strategy, log_return, total_return, sharpe, place): all strategies in one job, best ``target`` first, ties by name. Their weights are
    columns of the same bars, so no row is copied, and only one row a date and strategy leaves the aggregate."""
    rows = bars
    for name, s in strategies.items():
        rows = s.weights(rows).withColumnRenamed("weight", name)
    rows = rows.select("date", *[_net(rows, n, fee, tax).alias(n) for n in strategies])
    days = rows.groupBy("date").agg(*[_day(n).alias(n) for n in strategies])
    tried = days.unpivot(["date"], list(strategies), "strategy", "ret").groupBy("strategy").agg(
        F.sum(F.log1p("ret")).alias("log_return"),
        (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(252)).alias("sharpe"),
    )
    tried = tried.withColumn("total_return", F.expm1("log_return"))
    return tried.withColumn("place", F.row_number().over(Window.orderBy(F.col(target).desc_nulls_last(), "strategy")))


def sma_signal(bars: DataFrame, n: int = 20, buy: float = 2.0, sell: float = -2.0) -> DataFrame:
    """The latest bar's distance from its mean as BUY (confidence 70) or SELL (60)."""
    mean = full(bars, F.avg, "close", n)
    rows = bars.withColumn("distance", (F.col("close") - mean) / F.nullif(mean, F.lit(0.0)) * 100)
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("date", "distance"), F.struct(*in_time(rows))).alias("x")).select("ticker", "x.*")
    action = F.when(F.col("distance") >= buy, "BUY").when(F.col("distance") <= sell, "SELL")
    confidence = F.when(F.col("action") == "BUY", 70.0).when(F.col("action") == "SELL", 60.0)
    return last.withColumn("action", action).where("action is not null").withColumn("confidence", confidence)


def sentiment_signal(news: DataFrame, as_of: str, days: int = 7, least: int = 3, buy: float = 0.5, sell: float = -0.3) -> DataFrame:
    recent = news.where(F.col("date").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    means = recent.groupBy("ticker").agg(F.avg("sentiment_score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= least)
    action = F.when(F.col("score") >= buy, "BUY").when(F.col("score") <= sell, "SELL")
    confidence = F.when(F.col("action") == "BUY", 65.0).otherwise(60.0)
    return means.withColumn("action", action).where("action is not null").withColumn("confidence", confidence)


def strongest(signals: DataFrame) -> DataFrame:
    """Each ticker's most confident signal; ties by action."""
    w = Window.partitionBy("ticker").orderBy(F.desc("confidence"), "action")
    return signals.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
