"""The named market queries and their SQL twins. Bars are thin, so windows of days are hundreds long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import market
from barloom.plans.registry import register
from barloom.sources.bars import BARS_SQL, bars

WITH = f"WITH {BARS_SQL}"
SINCE = "date >= (SELECT max(date) FROM bars) - {} "


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@register(
    "latest_summary",
    f"""{WITH}, l AS (SELECT market, max(date) AS latest_date FROM bars GROUP BY market)
    SELECT b.market, l.latest_date, count(DISTINCT ticker) AS tickers, count(*) AS n_rows, sum(volume) AS total_volume
    FROM bars b JOIN l ON b.market = l.market AND b.date = l.latest_date GROUP BY b.market, l.latest_date""",
)
def latest_summary(spark, sf_dir):
    return market.latest_summary(bars(spark, sf_dir))


@register(
    "top_volume",
    f"""{WITH} SELECT ticker, market, sum(volume) AS total_volume, round(avg(volume), 6) AS avg_volume,
    count(DISTINCT date) AS trading_days FROM bars WHERE {SINCE.format(700)}
    GROUP BY ticker, market ORDER BY total_volume DESC, ticker, market LIMIT 20""",
)
def top_volume(spark, sf_dir):
    return rounded(market.top_volume(bars(spark, sf_dir, 700)), "avg_volume")


@register(
    "gainers_losers",
    f"""{WITH}, p AS (SELECT ticker, market, first(close ORDER BY date) AS a, last(close ORDER BY date) AS b FROM bars
      WHERE {SINCE.format(700)} GROUP BY ticker, market HAVING count(DISTINCT date) >= 50)
    SELECT ticker, market, round(a, 6) AS start_price, round(b, 6) AS end_price, round((b - a) / a * 100, 6) AS pct_change,
           CASE WHEN (b - a) / a >= 0 THEN 'GAINER' ELSE 'LOSER' END AS category
    FROM p ORDER BY (b - a) / a DESC, ticker, market LIMIT 30""",
)
def gainers_losers(spark, sf_dir):
    return rounded(market.gainers_losers(bars(spark, sf_dir, 700), 50), "start_price", "end_price", "pct_change")


@register(
    "cross_market",
    f"""{WITH} SELECT date, market, ticker, round(close, 6) AS close, volume FROM bars WHERE ticker = upper('s0003')
    ORDER BY market, date LIMIT 100""",
)
def cross_market(spark, sf_dir):
    return rounded(market.cross_market(bars(spark, sf_dir), "s0003"), "close")


@register(
    "moving_avg",
    f"""{WITH}, m AS (SELECT date, ticker, close, avg(close) OVER (PARTITION BY ticker ORDER BY date
      ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma FROM bars WHERE ticker = 'S0005' ORDER BY date DESC LIMIT 40)
    SELECT date, ticker, round(close, 6) AS close, round(ma, 6) AS ma, round((close - ma) / ma * 100, 6) AS pct_diff_from_ma
    FROM m""",
)
def moving_avg(spark, sf_dir):
    return rounded(market.moving_average(bars(spark, sf_dir), "S0005", 20), "close", "ma", "pct_diff_from_ma")


@register(
    "volatility",
    f"""{WITH}, r AS (SELECT ticker, market, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r
      FROM bars WHERE {SINCE.format(900)})
    SELECT ticker, market, round(avg(abs(r)) * 100, 6) AS avg_daily_move_pct, round(stddev(r) * 100, 6) AS volatility_pct,
           count(DISTINCT date) AS trading_days
    FROM r WHERE r IS NOT NULL GROUP BY ticker, market HAVING count(DISTINCT date) >= 30
    ORDER BY stddev(r) DESC, ticker, market LIMIT 20""",
)
def volatility(spark, sf_dir):
    return rounded(market.volatility(bars(spark, sf_dir, 900), 30), "avg_daily_move_pct", "volatility_pct")


@register(
    "market_stats",
    f"""{WITH}, d AS (SELECT market, date, count(DISTINCT ticker) AS t, sum(volume) AS v, avg(close) AS p FROM bars
      WHERE volume > 0 GROUP BY market, date)
    SELECT market, count(*) AS trading_days, round(avg(t), 6) AS avg_tickers, round(avg(v), 6) AS avg_volume,
           round(avg(p), 6) AS avg_price FROM d GROUP BY market""",
)
def market_stats(spark, sf_dir):
    return rounded(market.market_stats(bars(spark, sf_dir)), "avg_tickers", "avg_volume", "avg_price")


@register(
    "price_range",
    f"""{WITH}, p AS (SELECT ticker, market, min(close) AS lo, max(close) AS hi, last(close ORDER BY date) AS cur FROM bars
      WHERE {SINCE.format(700)} GROUP BY ticker, market HAVING count(DISTINCT date) >= 50)
    SELECT ticker, market, round(lo, 6) AS period_low, round(hi, 6) AS period_high, round(cur, 6) AS current_price,
           round((cur - lo) / lo * 100, 6) AS pct_from_low, round((hi - cur) / hi * 100, 6) AS pct_from_high
    FROM p ORDER BY (cur - lo) / lo DESC, ticker, market LIMIT 30""",
)
def price_range(spark, sf_dir):
    return rounded(
        market.price_range(bars(spark, sf_dir, 700), 50),
        "period_low", "period_high", "current_price", "pct_from_low", "pct_from_high",
    )
