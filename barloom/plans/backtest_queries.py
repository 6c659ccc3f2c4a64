"""Strategies with their options, stops, resampling and the search over parameters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import trading
from barloom.plans.feature_queries import W, _full
from barloom.plans.learning_queries import _CROSS
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources.bars import bars

_RUN = "ROWS UNBOUNDED PRECEDING"


def _span(n: int) -> str:
    """A weighted mean as a quotient of growing sums; a bar's weight grows by (n + 1) / (n - 1)."""
    grow = f"pow({n + 1}.0 / {n - 1}.0, i)"
    return f"sum(close * {grow}) OVER (PARTITION BY ticker ORDER BY date {_RUN}) / sum({grow}) OVER (PARTITION BY ticker ORDER BY date {_RUN})"


@register(
    "ema_cross",
    f"""{WITH}, i AS (SELECT ticker, date, close, row_number() {W} - 1 AS i FROM bars),
    f AS (SELECT ticker, date, {_span(10)} AS f, {_span(30)} AS s FROM i),
    p AS (SELECT *, lag(f) {W} AS pf, lag(s) {W} AS ps FROM f)
    SELECT ticker, date, CASE WHEN f > s AND pf <= ps THEN 1.0 ELSE 0.0 END AS weight FROM p""",
)
def ema_cross(spark, sf_dir):
    return trading.EmaCross().weights(bars(spark, sf_dir)).select("ticker", "date", "weight")


@register(
    "bb_reversion_trend",
    f"""{WITH}, f AS (SELECT ticker, date, close, {_full("avg", "close", 5)} - {_full("stddev_samp", "close", 5)} AS lo,
      {_full("avg", "close", 40)} AS t FROM bars),
    p AS (SELECT *, lag(lo) {W} AS plo, lag(close) {W} AS pc FROM f)
    SELECT ticker, date, CASE WHEN close < lo AND pc >= plo AND close > t THEN 0.95 ELSE 0.0 END AS weight FROM p""",
)
def bb_reversion_trend(spark, sf_dir):
    s = trading.BandReversion(n=5, k=1.0, trend=40)
    return s.weights(bars(spark, sf_dir)).select("ticker", "date", "weight")


@register(
    "momentum_long_short",
    f"""{WITH}, r AS (SELECT ticker, date, lag(close, 5) {W} / lag(close, 45) {W} - 1 AS r FROM bars),
    d AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) % 21 = 0 AS st FROM (SELECT DISTINCT date FROM bars)),
    k AS (SELECT r.ticker, r.date, r, st, count(r) OVER (PARTITION BY r.date) AS n,
      row_number() OVER (PARTITION BY r.date ORDER BY r DESC NULLS LAST, ticker) AS k FROM r JOIN d ON r.date = d.date),
    x AS (SELECT ticker, date, CASE WHEN st AND n >= 3 AND r IS NOT NULL THEN
      CASE WHEN k <= greatest(floor(n * 0.3), 1) THEN 1 / greatest(floor(n * 0.3), 1)
           WHEN k > n - greatest(floor(n * 0.2), 1) THEN -1 / greatest(floor(n * 0.2), 1) ELSE 0 END END AS w FROM k)
    SELECT ticker, date, round(coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date {_RUN}), 0), 6) AS weight FROM x""",
)
def momentum_long_short(spark, sf_dir):
    s = trading.Momentum(lookback=40, skip=5, least=3, short=0.2)
    return rounded(s.weights(bars(spark, sf_dir)).select("ticker", "date", "weight"), "weight")


#: A trend held while the short mean is above the long one: runs of many bars, as stops need.
_TREND = f"""{WITH}, wt AS (SELECT ticker, date, close, CASE WHEN {_full("avg", "close", 10)} > {_full("avg", "close", 30)} THEN 1.0 ELSE 0.0 END AS weight FROM bars)"""


class _Trend(trading.Strategy):
    def weights(self, bars):
        above = trading.full(bars, F.avg, "close", 10) > trading.full(bars, F.avg, "close", 30)
        return bars.withColumn("weight", F.when(above, 1.0).otherwise(0.0))


_STOPPED = f"""{_TREND}, b AS (SELECT *, CASE WHEN weight <> 0 AND coalesce(lag(weight) {W}, 0) = 0 THEN 1 ELSE 0 END AS b FROM wt),
t AS (SELECT *, sum(b) OVER (PARTITION BY ticker ORDER BY date {_RUN}) AS tr FROM b),
e AS (SELECT *, close / first_value(close) OVER (PARTITION BY ticker, tr ORDER BY date) - 1 AS won FROM t),
s AS (SELECT ticker, date, close, CASE WHEN max(CASE WHEN weight <> 0 AND (won <= -0.1 OR won >= 0.2) THEN 1 ELSE 0 END)
  OVER (PARTITION BY ticker, tr ORDER BY date {_RUN}) = 1 THEN 0.0 ELSE weight END AS weight FROM e)"""


@register("stopped_weights", f"{_STOPPED} SELECT ticker, date, weight FROM s")
def stopped_weights(spark, sf_dir):
    out = trading.stopped(_Trend().weights(bars(spark, sf_dir)), stop_loss=0.1, take_profit=0.2)
    return out.select("ticker", "date", "weight")


@register(
    "resampled_weights",
    f"""{_TREND}, m AS (SELECT *, CASE WHEN coalesce(lead(date_trunc('month', date)) {W} <> date_trunc('month', date), true) THEN weight END AS x FROM wt)
    SELECT ticker, date, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date {_RUN}), 0) AS weight FROM m""",
)
def resampled_weights(spark, sf_dir):
    return trading.resampled(_Trend().weights(bars(spark, sf_dir))).select("ticker", "date", "weight")


_GRID = [(f, s) for f in (5, 10, 20) for s in (30, 60)]


def _tried(fast: int, slow: int) -> str:
    return f"""SELECT 'fast{fast}_slow{slow}' AS strategy, date,
      greatest(avg(h * r - abs(w - h) * 0.001425 - greatest(h - w, 0) * 0.003), -0.9999) AS ret
    FROM (SELECT date, w, coalesce(lag(w) {W}, 0) AS h, coalesce(close / lag(close) {W} - 1, 0) AS r
      FROM (SELECT ticker, date, close, CASE WHEN f > s AND lag(f) {W} <= lag(s) {W} THEN 1.0 ELSE 0.0 END AS w
        FROM (SELECT ticker, date, close, {_full("avg", "close", fast)} AS f, {_full("avg", "close", slow)} AS s FROM bars))) GROUP BY date"""


@register(
    "strategy_grid",
    f"""{WITH}, d AS ({" UNION ALL ".join(_tried(f, s) for f, s in _GRID)}),
    g AS (SELECT strategy, sum(ln(1 + ret)) AS lr, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM d GROUP BY strategy)
    SELECT strategy, round(lr, 5) AS log_return, round(sharpe, 5) AS sharpe, row_number() OVER (ORDER BY sharpe DESC, strategy) AS place FROM g""",
)
def strategy_grid(spark, sf_dir):
    tried = trading.grid(bars(spark, sf_dir), {f"fast{f}_slow{s}": trading.SmaCross(f, s) for f, s in _GRID})
    out = tried.select("strategy", "log_return", "sharpe", F.col("place").cast("long").alias("place"))
    return rounded(out, "log_return", "sharpe", digits=5)


@register(
    "trade_summary",
    f"""{_CROSS}, b AS (SELECT *, CASE WHEN weight <> 0 AND coalesce(lag(weight) {W}, 0) = 0 THEN 1 ELSE 0 END AS b FROM wt)
    SELECT ticker, CAST(sum(b) AS BIGINT) AS n_trades, count(*) FILTER (weight <> 0) AS n_bars_held FROM b GROUP BY ticker HAVING sum(b) > 0""",
)
def trade_summary(spark, sf_dir):
    made = trading.trades(trading.SmaCross().weights(bars(spark, sf_dir)))
    return made.groupBy("ticker").agg(F.count("*").alias("n_trades"), F.sum("n_bars").alias("n_bars_held"))
