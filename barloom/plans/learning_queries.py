"""Machine-learning frames, strategies, backtests and signals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import indicators
from barloom.operators import lake, learning, trading
from barloom.plans.feature_queries import W, _frame, _full
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources import proxies
from barloom.sources.bars import bars, table

STRATEGIES = {"sma10": (10, 20.0, -20.0), "sma20": (20, 15.0, -15.0)}


@register(
    "candidates",
    f"""{WITH}, d AS (SELECT ticker, date,
      (close - {_full("avg", "close", 10)}) / {_full("avg", "close", 10)} * 100 AS d1,
      (close - {_full("avg", "close", 20)}) / {_full("avg", "close", 20)} * 100 AS d2 FROM bars),
    c AS (SELECT ticker, date, 'sma10' AS source, 0 AS rk, d1 AS d FROM d WHERE abs(d1) >= 20 UNION ALL
      SELECT ticker, date, 'sma20', 1, d2 FROM d WHERE abs(d2) >= 15)
    SELECT ticker, date, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS candidate_action, source AS candidate_source,
      round(abs(d), 6) AS candidate_score
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY abs(d) DESC, rk) AS k FROM c) WHERE k = 1""",
)
def candidates(spark, sf_dir):
    return rounded(learning.candidates(bars(spark, sf_dir), STRATEGIES), "candidate_score")


@register(
    "triple_barrier",
    f"""{WITH}, p AS (SELECT *, row_number() {W} AS i, greatest(coalesce((high - low) / close, 0), 0.005) AS v FROM bars),
    h AS (SELECT a.ticker, a.date, b.i - a.i AS k, b.close AS c2, a.close AS c,
        b.high >= a.close * (1 + a.v * 1.5) AS up, b.low <= a.close * (1 - a.v) AS dn
      FROM p a JOIN p b ON a.ticker = b.ticker AND b.i BETWEEN a.i + 1 AND a.i + 10),
    f AS (SELECT ticker, date, min(k) FILTER (up OR dn) AS k1, max(k) AS kn FROM h GROUP BY ticker, date),
    o AS (SELECT f.ticker, f.date, CASE WHEN x.up AND x.dn THEN 'both_hit' WHEN x.up THEN 'profit' WHEN x.dn THEN 'stop'
        WHEN e.c2 > e.c THEN 'time_profit' ELSE 'time_loss' END AS out
      FROM f LEFT JOIN h x ON x.ticker = f.ticker AND x.date = f.date AND x.k = f.k1
        JOIN h e ON e.ticker = f.ticker AND e.date = f.date AND e.k = f.kn)
    SELECT p.ticker, p.date, coalesce(out, 'none') AS barrier_outcome,
      CASE WHEN out IN ('profit', 'time_profit') THEN 1 ELSE 0 END AS meta_label,
      round(v * 1.5, 6) AS upper_barrier_return, round(v, 6) AS lower_barrier_return
    FROM p LEFT JOIN o ON p.ticker = o.ticker AND p.date = o.date""",
)
def triple_barrier(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("hl", (F.col("high") - F.col("low")) / F.nullif("close", F.lit(0.0)))
    cols = ["upper_barrier_return", "lower_barrier_return"]
    out = learning.triple_barrier(rows, "hl").select("ticker", "date", "barrier_outcome", "meta_label", *cols)
    return rounded(out, *cols)


_WINDOWS = f"""{WITH}, w AS (SELECT ticker, i AS id, i AS start_idx, i + CAST(volume AS BIGINT) % 12 - 1 AS end_idx
  FROM (SELECT *, row_number() {W} - 1 AS i FROM bars))"""


@register(
    "uniqueness",
    f"""{_WINDOWS}, p AS (SELECT ticker, id, unnest(range(start_idx, end_idx + 1)) AS i FROM w WHERE end_idx >= start_idx),
    c AS (SELECT ticker, i, count(*) AS c FROM p GROUP BY ticker, i),
    a AS (SELECT p.ticker, p.id, avg(1.0 / c) AS u FROM p JOIN c ON p.ticker = c.ticker AND p.i = c.i GROUP BY p.ticker, p.id)
    SELECT w.ticker, w.id, start_idx, end_idx, round(coalesce(u, 0), 6) AS uniqueness
    FROM w LEFT JOIN a ON w.ticker = a.ticker AND w.id = a.id""",
)
def uniqueness(spark, sf_dir):
    b = bars(spark, sf_dir)
    rows = b.withColumn("id", (F.row_number().over(indicators.by_ticker(b)) - 1).cast("long"))
    end = F.col("id") + F.col("volume").cast("long") % 12 - 1
    windows = rows.select("ticker", "id", F.col("id").alias("start_idx"), end.alias("end_idx"))
    return rounded(learning.uniqueness(windows), "uniqueness")


@register(
    "walk_splits",
    f"""{WITH}, n AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker),
    s AS (SELECT ticker, unnest(range(0, n - 252 - 21 + 1, 26)) AS s FROM n WHERE n >= 273)
    SELECT ticker, CAST(s AS INTEGER) AS train_start, CAST(s + 248 AS INTEGER) AS train_end,
      CAST(s + 252 AS INTEGER) AS test_start, CAST(s + 273 AS INTEGER) AS test_end FROM s""",
)
def walk_splits(spark, sf_dir):
    n = bars(spark, sf_dir).groupBy("ticker").agg(F.count("*").cast("int").alias("n"))
    return n.select("ticker", F.explode(learning.walk_forward(F.col("n"))).alias("s")).select("ticker", "s.*")


@register(
    "class_metrics",
    """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
      count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
    SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def class_metrics(spark, sf_dir):
    out = learning.class_metrics(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))
    return rounded(out, "accuracy", "precision", "recall", "f1")


@register(
    "threshold_search",
    """WITH p AS (SELECT quality AS y, (doc_id * 7919) % 1000 / 1000.0 AS p FROM labels),
    t AS (SELECT unnest(range(10, 91)) AS t),
    c AS (SELECT t, count(*) FILTER (y = 1 AND floor(p * 100) >= t) AS tp, count(*) FILTER (y = 0 AND floor(p * 100) >= t) AS fp,
      count(*) FILTER (y = 1 AND floor(p * 100) < t) AS fn, count(*) FILTER (y = 0 AND floor(p * 100) < t) AS tn FROM p, t GROUP BY t)
    SELECT t / 100.0 AS threshold, tp, fp, fn, tn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def threshold_search(spark, sf_dir):
    p = F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0
    out = learning.thresholds(table(spark, sf_dir, "labels").withColumn("p", p), "quality", "p")
    return rounded(out.select("threshold", "tp", "fp", "fn", "tn", "f1"), "f1")


@register(
    "class_weights",
    """SELECT count(*) FILTER (quality = 0) AS negatives, count(*) FILTER (quality = 1) AS positives,
    round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1), 6) AS weight FROM labels""",
)
def class_weights(spark, sf_dir):
    return rounded(learning.class_weight(table(spark, sf_dir, "labels"), "quality"), "weight")


@register(
    "time_split",
    f"""{WITH}, r AS (SELECT ticker, date, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars)
    SELECT ticker, date, CASE WHEN i < floor(n * 0.8) - 5 THEN 'train' WHEN i >= floor(n * 0.8) THEN 'test' END AS part FROM r""",
)
def time_split(spark, sf_dir):
    return learning.time_split(bars(spark, sf_dir)).select("ticker", "date", "part")


_CROSS = f"""{WITH}, f AS (SELECT ticker, date, close, {_full("avg", "close", 10)} AS f, {_full("avg", "close", 30)} AS s FROM bars),
p AS (SELECT *, lag(f) {W} AS pf, lag(s) {W} AS ps FROM f),
wt AS (SELECT ticker, date, close, CASE WHEN f > s AND pf <= ps THEN 1.0 ELSE 0.0 END AS weight FROM p)"""


@register("sma_cross", f"{_CROSS} SELECT ticker, date, weight FROM wt")
def sma_cross(spark, sf_dir):
    return trading.SmaCross().weights(bars(spark, sf_dir)).select("ticker", "date", "weight")


@register(
    "bb_reversion",
    f"""{WITH}, f AS (SELECT ticker, date, close, {_full("avg", "close", 20)} - 2 * {_full("stddev_samp", "close", 20)} AS lo FROM bars),
    p AS (SELECT *, lag(lo) {W} AS plo, lag(close) {W} AS pc FROM f)
    SELECT ticker, date, CASE WHEN close < lo AND pc >= plo THEN 0.95 ELSE 0.0 END AS weight FROM p""",
)
def bb_reversion(spark, sf_dir):
    return trading.BandReversion(trend=None).weights(bars(spark, sf_dir)).select("ticker", "date", "weight")


@register(
    "momentum_weights",
    f"""{WITH}, r AS (SELECT ticker, date, lag(close, 5) {W} / lag(close, 45) {W} - 1 AS r FROM bars),
    d AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) % 21 = 0 AS st FROM (SELECT DISTINCT date FROM bars)),
    k AS (SELECT r.ticker, r.date, r, st, count(r) OVER (PARTITION BY r.date) AS n,
      row_number() OVER (PARTITION BY r.date ORDER BY r DESC NULLS LAST, ticker) AS k FROM r JOIN d ON r.date = d.date),
    x AS (SELECT ticker, date, CASE WHEN st AND n >= 3 AND r IS NOT NULL THEN
      CASE WHEN k <= greatest(floor(n * 0.3), 1) THEN 1 / greatest(floor(n * 0.3), 1) ELSE 0 END END AS w FROM k)
    SELECT ticker, date, round(coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0), 6)
      AS weight FROM x""",
)
def momentum_weights(spark, sf_dir):
    s = trading.Momentum(lookback=40, skip=5, least=3)
    return rounded(s.weights(bars(spark, sf_dir)).select("ticker", "date", "weight"), "weight")


_CURVE = f"""{_CROSS}, h AS (SELECT *, coalesce(lag(weight) {W}, 0) AS hd, coalesce(close / lag(close) {W} - 1, 0) AS r FROM wt),
n AS (SELECT date, greatest(avg(hd * r - abs(weight - hd) * 0.001425 - greatest(hd - weight, 0) * 0.003), -0.9999) AS ret FROM h GROUP BY date),
v AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS value FROM n),
cv AS (SELECT date, ret, value, value / max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM v)"""


@register("equity_curve", f"{_CURVE} SELECT date, round(ret, 6) AS ret, round(ln(value), 6) AS log_value, round(drawdown, 6) AS drawdown FROM cv")
def equity_curve(spark, sf_dir):
    curve = trading.equity_curve(trading.SmaCross().weights(bars(spark, sf_dir)))
    return rounded(curve.select("date", "ret", F.log("value").alias("log_value"), "drawdown"), "ret", "log_value", "drawdown")


_MET = ["total_return", "cagr", "max_drawdown", "volatility", "sharpe", "sortino", "win_rate"]


@register(
    "backtest_metrics",
    f"""{_CURVE} SELECT round(last(value ORDER BY date) - 1, 1) AS total_return, round(pow(last(value ORDER BY date), 252.0 / count(*)) - 1, 5) AS cagr,
    round(min(drawdown), 5) AS max_drawdown, round(stddev_samp(ret) * sqrt(252), 5) AS volatility,
    round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe,
    round(avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252), 5) AS sortino,
    round(count(*) FILTER (ret > 0) / count(*) FILTER (ret <> 0), 5) AS win_rate FROM cv""",
)
def backtest_metrics(spark, sf_dir):
    curve = trading.equity_curve(trading.SmaCross().weights(bars(spark, sf_dir)))
    return rounded(rounded(trading.metrics(curve), *_MET[1:], digits=5), "total_return", digits=1)


@register(
    "trades",
    f"""{_CROSS}, b AS (SELECT *, CASE WHEN weight <> 0 AND coalesce(lag(weight) {W}, 0) = 0 THEN 1 ELSE 0 END AS b FROM wt),
    t AS (SELECT *, sum(b) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS tr FROM b)
    SELECT ticker, CAST(tr AS BIGINT) AS trade, min(date) AS entry_date, max(date) AS exit_date, count(*) AS n_bars,
      round(last(close ORDER BY date) / first(close ORDER BY date) - 1, 6) AS trade_return
    FROM t WHERE weight <> 0 GROUP BY ticker, tr""",
)
def trades(spark, sf_dir):
    return rounded(trading.trades(trading.SmaCross().weights(bars(spark, sf_dir))), "trade_return")


@register(
    "sma_signal",
    f"""{WITH}, d AS (SELECT ticker, date, (close - {_full("avg", "close", 20)}) / {_full("avg", "close", 20)} * 100 AS d FROM bars),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM d) WHERE k = 1 AND abs(d) >= 2)
    SELECT ticker, date, round(d, 6) AS distance, CASE WHEN d > 0 THEN 'BUY' ELSE 'SELL' END AS action,
      CASE WHEN d > 0 THEN 70.0 ELSE 60.0 END AS confidence FROM l""",
)
def sma_signal(spark, sf_dir):
    return rounded(trading.sma_signal(bars(spark, sf_dir)), "distance")


@register(
    "sentiment_signal",
    f"""WITH {proxies.NEWS_SQL}, s AS (SELECT ticker, avg(sentiment_score) AS s, count(*) AS n FROM news
      WHERE date BETWEEN DATE '1999-05-25' - 7 AND DATE '1999-05-25' GROUP BY ticker HAVING count(*) >= 3)
    SELECT ticker, round(s, 6) AS score, n, CASE WHEN s >= 0.1 THEN 'BUY' ELSE 'SELL' END AS action,
      CASE WHEN s >= 0.1 THEN 65.0 ELSE 60.0 END AS confidence FROM s WHERE s >= 0.1 OR s <= -0.1""",
)
def sentiment_signal(spark, sf_dir):
    out = trading.sentiment_signal(proxies.news(spark, sf_dir), "1999-05-25", buy=0.1, sell=-0.1)
    return rounded(out, "score")


@register("gbt_predictions")
def gbt_predictions(spark, sf_dir):
    """A boosted classifier of the next day's direction, trained on older bars, on the newer ones."""
    rows = indicators.target(indicators.bollinger(indicators.returns(bars(spark, sf_dir))))
    rows = learning.time_split(rows.withColumn("y", (F.col("next_day_return") > 0).cast("int")))
    names = ["return_1d", "return_5d", "bb_pct", "bb_width"]
    rows = lake.stored(rows.select("ticker", "date", "y", "part", *names))  # read for each step of the training
    known = rows.where("part = 'train'").dropna(subset=["y", *names])
    known = learning.spread(known, known.count(), "ticker", "date")
    model = learning.train_classifier(known, names, "y", depth=2, rounds=3)
    return learning.predict(model, rows.where("part = 'test'"))
