"""Indicators and enrichment, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import ewm, indicators
from barloom.operators import enrich, series
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register, twin
from barloom.sources import proxies
from barloom.sources.bars import bars

W = "OVER (PARTITION BY ticker ORDER BY date)"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_frame(n)} >= {n} THEN {agg}({x}) {_frame(n)} END"


_R = [f"return_{n}d" for n in (1, 5, 10, 20)] + [f"roc_{n}" for n in (5, 10, 20)]


@register(
    "returns_roc",
    f"{WITH} SELECT ticker, date, "
    + ", ".join(f"round(close / lag(close, {n}) {W} - 1, 6) AS return_{n}d" for n in (1, 5, 10, 20))
    + ", "
    + ", ".join(f"round((close / lag(close, {n}) {W} - 1) * 100, 6) AS roc_{n}" for n in (5, 10, 20))
    + " FROM bars",
)
def returns_roc(spark, sf_dir):
    return rounded(indicators.returns(bars(spark, sf_dir)).select("ticker", "date", *_R), *_R)


_B = ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_pct"]


@register(
    "bollinger",
    f"""{WITH}, m AS (SELECT ticker, date, close, {_full("avg", "close", 20)} AS m, {_full("stddev_samp", "close", 20)} AS s FROM bars)
    SELECT ticker, date, round(m, 6) AS bb_middle, round(m + 2 * s, 6) AS bb_upper, round(m - 2 * s, 6) AS bb_lower,
           round(4 * s / m, 6) AS bb_width, round((close - (m - 2 * s)) / nullif(4 * s, 0), 6) AS bb_pct FROM m""",
)
def bollinger(spark, sf_dir):
    return rounded(indicators.bollinger(bars(spark, sf_dir)).select("ticker", "date", *_B), *_B)


_V = ["atr_14", "volatility_20", "overnight_return", "intraday_return", "hl_range"]


@register(
    "atr_vol",
    f"""{WITH}, p AS (SELECT *, lag(close) {W} AS pc FROM bars),
    t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close / pc - 1 AS r FROM p)
    SELECT ticker, date, round({_full("avg", "tr", 14)}, 6) AS atr_14,
           round({_full("stddev_samp", "r", 20)} * sqrt(252), 6) AS volatility_20,
           round((open - pc) / pc, 6) AS overnight_return, round((close - open) / open, 6) AS intraday_return,
           round((high - low) / close, 6) AS hl_range FROM t""",
)
def atr_vol(spark, sf_dir):
    return rounded(indicators.ranges(bars(spark, sf_dir)).select("ticker", "date", *_V), *_V)


_U = ["volume_ma_20", "volume_roc_5", "obv", "volume_ratio"]


@register(
    "volume_features",
    f"""{WITH}, p AS (SELECT *, coalesce(sign(close - lag(close) {W}), 0) * volume AS st,
      {_full("avg", "volume", 20)} AS ma FROM bars)
    SELECT ticker, date, round(ma, 6) AS volume_ma_20, round(volume / lag(volume, 5) {W} - 1, 6) AS volume_roc_5,
           round(sum(st) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS obv,
           round(volume / nullif(ma, 0), 6) AS volume_ratio FROM p""",
)
def volume_features(spark, sf_dir):
    return rounded(indicators.volumes(bars(spark, sf_dir)).select("ticker", "date", *_U), *_U)


_C = ["day_of_week", "day_of_month", "month", "quarter", "days_to_month_end", "trading_day_of_month"]


@register(
    "calendar_features",
    f"""{WITH} SELECT ticker, date, CAST(isodow(date) AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
    CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
    CAST(last_day(date) - date AS INTEGER) AS days_to_month_end,
    CAST(row_number() OVER (PARTITION BY ticker, year(date), month(date) ORDER BY date) AS INTEGER) AS trading_day_of_month
    FROM bars""",
)
def calendar_features(spark, sf_dir):
    return indicators.calendar(bars(spark, sf_dir)).select("ticker", "date", *_C)


@register("next_day_return", f"{WITH} SELECT ticker, date, round(lead(close) {W} / close - 1, 6) AS next_day_return FROM bars")
def next_day_return(spark, sf_dir):
    return rounded(indicators.target(bars(spark, sf_dir)).select("ticker", "date", "next_day_return"), "next_day_return")


_EWM = f"""WITH RECURSIVE {WITH.removeprefix("WITH ")},
n AS (SELECT ticker, date, close, close - lag(close) {W} AS d, row_number() {W} AS i FROM bars),
e AS (
  SELECT ticker, date, i, close AS f, close AS s, CAST(0 AS DOUBLE) AS sig,
         CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM n WHERE i = 1
  UNION ALL
  SELECT n.ticker, n.date, n.i, e.f + (n.close - e.f) * 2 / 13, e.s + (n.close - e.s) * 2 / 27,
         e.sig + ((e.f + (n.close - e.f) * 2 / 13) - (e.s + (n.close - e.s) * 2 / 27) - e.sig) * 2 / 10,
         CASE WHEN n.i = 2 THEN greatest(n.d, 0) ELSE e.g + (greatest(n.d, 0) - e.g) / 14 END,
         CASE WHEN n.i = 2 THEN -least(n.d, 0) ELSE e.l + (-least(n.d, 0) - e.l) / 14 END
  FROM e JOIN n ON n.ticker = e.ticker AND n.i = e.i + 1)"""


@register("macd", f"{_EWM} SELECT ticker, date, round(f - s, 6) AS macd, round(sig, 6) AS macd_signal, round(f - s - sig, 6) AS macd_histogram FROM e")
def macd(spark, sf_dir):
    names = ["macd", "macd_signal", "macd_histogram"]
    return rounded(ewm.momentum(bars(spark, sf_dir)).select("ticker", "date", *names), *names)


@register(
    "rsi",
    f"{_EWM} SELECT ticker, date, CASE WHEN i > 14 THEN round(100 - 100 / (1 + g / nullif(l, 0)), 6) END AS rsi_14 FROM e",
)
def rsi(spark, sf_dir):
    return rounded(ewm.momentum(bars(spark, sf_dir)).select("ticker", "date", "rsi_14"), "rsi_14").withColumn(
        "rsi_14", F.when(~F.isnan("rsi_14"), F.col("rsi_14"))
    )


@register(
    "ewm_halflife",
    f"""WITH RECURSIVE {WITH.removeprefix("WITH ")}, n AS (SELECT ticker, date, close, row_number() {W} AS i FROM bars),
    e AS (SELECT ticker, date, i, close AS a, CAST(1 AS DOUBLE) AS b FROM n WHERE i = 1 UNION ALL
      SELECT n.ticker, n.date, n.i, e.a * pow(0.5, 1.0 / 7) + n.close, e.b * pow(0.5, 1.0 / 7) + 1
      FROM e JOIN n ON n.ticker = e.ticker AND n.i = e.i + 1)
    SELECT ticker, date, round(a / b, 3) AS close_ewma_7d FROM e""",
)
def ewm_halflife(spark, sf_dir):
    return rounded(ewm.decayed(bars(spark, sf_dir), "close", (7,)).select("ticker", "date", "close_ewma_7d"), "close_ewma_7d", digits=3)


_ALL = ["macd", "rsi", "returns_roc", "bollinger", "atr_vol", "volume_features", "calendar_features", "next_day_return"]
_FEATURES = f"""SELECT market, ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume,
  * EXCLUDE (market, ticker, date, open, high, low, close, volume), CAST(3 AS INTEGER) AS feature_schema_version
FROM ({WITH} SELECT market, ticker, date, open, high, low, close, volume FROM bars) b
{" ".join(f"JOIN {twin(n)} {n}_t USING (ticker, date)" for n in _ALL)}
WHERE rsi_14 IS NOT NULL"""


def _rounded_floats(frame):
    return rounded(frame, *[f.name for f in frame.schema.fields if f.dataType.simpleString() == "double" and f.name != "volume"])


@register("feature_table", _FEATURES)
def feature_table(spark, sf_dir):
    """All indicators of all bars, those without a full history left out."""
    return _rounded_floats(ewm.features(bars(spark, sf_dir)))


@register(
    "feature_job",
    f"""WITH RECURSIVE {WITH.removeprefix("WITH ")}, b AS (SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM bars WHERE market <> 'ASIA')
      AND date BETWEEN DATE '1997-01-01' - 365 AND DATE '1997-12-31'),
    n AS (SELECT ticker, date, close, volume, close - lag(close) {W} AS d, row_number() {W} AS i, count(*) OVER (PARTITION BY ticker) AS c FROM b),
    e AS (SELECT ticker, date, i, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l FROM n WHERE i = 1 UNION ALL
      SELECT n.ticker, n.date, n.i, CASE WHEN n.i = 2 THEN greatest(n.d, 0) ELSE e.g + (greatest(n.d, 0) - e.g) / 14 END,
        CASE WHEN n.i = 2 THEN -least(n.d, 0) ELSE e.l + (-least(n.d, 0) - e.l) / 14 END FROM e JOIN n ON n.ticker = e.ticker AND n.i = e.i + 1),
    r AS (SELECT ticker, date, close / lag(close, 20) {W} - 1 AS r FROM b)
    SELECT n.ticker, n.date, round(100 - 100 / (1 + g / nullif(l, 0)), 6) AS rsi_14, round(r, 6) AS return_20d
    FROM n JOIN e ON n.ticker = e.ticker AND n.i = e.i JOIN r ON n.ticker = r.ticker AND n.date = r.date
    WHERE n.date >= DATE '1997-01-01' AND n.i > 14 AND l <> 0 AND c >= 60""",
)
def feature_job(spark, sf_dir):
    """Chosen features of a ticker list for a year, from bars of a year before."""
    b = bars(spark, sf_dir)
    chosen = b.where("market <> 'ASIA'").select("ticker")
    return _rounded_floats(ewm.feature_job(b, "1997-01-01", "1997-12-31", chosen, ["rsi_14", "return_20d"]))


@register(
    "zscore",
    f"""{WITH}, z AS (SELECT ticker, date, close, volume FROM bars)
    SELECT ticker, date,
      round((close - avg(close) OVER (PARTITION BY date)) / (stddev_samp(close) OVER (PARTITION BY date) + 1e-8), 6) AS close_z,
      round((volume - avg(volume) OVER (PARTITION BY date)) / (stddev_samp(volume) OVER (PARTITION BY date) + 1e-8), 6) AS volume_z
    FROM z""",
)
def zscore(spark, sf_dir):
    z = indicators.zscore(bars(spark, sf_dir), ["close", "volume"]).select("ticker", "date", "close_z", "volume_z")
    return rounded(z, "close_z", "volume_z")


N = f"{WITH}, {proxies.NEWS_SQL}"
_NEWS = ["avg_daily_sentiment", "sentiment_std"]


def _decayed(x: str, life: int) -> str:
    """A decayed mean as a quotient of growing sums; a row's weight doubles in ``life`` rows."""
    over = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"sum({x} * pow(2, i / {life}.0)) {over} / sum(pow(2, i / {life}.0)) {over}"


def _lives(x: str, name: str) -> str:
    return ", ".join(f"round({_decayed(x, h)}, 4) AS {name}_ewma_{h}d" for h in (3, 7, 30))


def _life_names(name: str) -> list[str]:
    return [f"{name}_ewma_{h}d" for h in (3, 7, 30)]


@register(
    "news_enrich",
    f"""{N}, d AS (SELECT ticker, date, avg(sentiment_score) AS a, count(*) AS n,
      count(*) FILTER (sentiment_label = 'positive') AS p, count(*) FILTER (sentiment_label = 'negative') AS g,
      count(*) FILTER (sentiment_label = 'neutral') AS u, stddev_samp(sentiment_score) AS s FROM news GROUP BY ticker, date),
    j AS (SELECT b.ticker, b.date, coalesce(a, 0) AS a, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(g, 0) AS g, coalesce(u, 0) AS u,
      coalesce(s, 0) AS s, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) - 1 AS i
      FROM bars b LEFT JOIN d ON b.ticker = d.ticker AND b.date = d.date)
    SELECT ticker, date, round(a, 6) AS avg_daily_sentiment, n AS news_count, p AS positive_count, g AS negative_count, u AS neutral_count,
      round(s, 6) AS sentiment_std, {_lives("a", "sentiment")} FROM j""",
)
def news_enrich(spark, sf_dir):
    out = enrich.with_news(bars(spark, sf_dir), proxies.news(spark, sf_dir))
    counts, lives = ["news_count", "positive_count", "negative_count", "neutral_count"], _life_names("sentiment")
    return rounded(rounded(out.select("ticker", "date", *_NEWS, *counts, *lives), *_NEWS), *lives, digits=4)


@register(
    "social_enrich",
    f"""{N}, {proxies.SOCIAL_SQL}, d AS (SELECT ticker, date, count(*) AS m, avg(score) AS s, avg(greatest(score, 0)) AS sp,
      avg(greatest(-score, 0)) AS sn, count(*) FILTER (reddit) AS r FROM social GROUP BY ticker, date),
    j AS (SELECT b.ticker, b.date, coalesce(m, 0) AS mentions, coalesce(s, 0) AS social_score, coalesce(sp, 0) AS sp, coalesce(sn, 0) AS sn,
      coalesce(r, 0) AS reddit_mentions, coalesce(m - r, 0) AS twitter_mentions,
      row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) - 1 AS i
      FROM bars b LEFT JOIN d ON b.ticker = d.ticker AND b.date = d.date)
    SELECT ticker, date, mentions, round(social_score, 6) AS social_score, round(sp, 6) AS social_positive, round(sn, 6) AS social_negative,
      reddit_mentions, twitter_mentions, round(coalesce(mentions / nullif(lag(mentions, 5) {W}, 0) - 1, 0), 6) AS mention_momentum,
      round(coalesce(social_score - lag(social_score, 5) {W}, 0), 6) AS social_score_change, {_lives("social_score", "social")} FROM j""",
)
def social_enrich(spark, sf_dir):
    out = enrich.with_social(bars(spark, sf_dir), proxies.social(spark, sf_dir))
    scores, lives = ["social_score", "social_positive", "social_negative", "mention_momentum", "social_score_change"], _life_names("social")
    out = out.select("ticker", "date", "mentions", "reddit_mentions", "twitter_mentions", *scores, *lives)
    return rounded(rounded(out, *scores), *lives, digits=4)


@register(
    "ratings_enrich",
    f"""{N}, r AS (SELECT ticker, date, avg(sentiment_score) AS c, avg(value * 10) AS t, count(*) AS n FROM news GROUP BY ticker, date),
    e AS (SELECT *, {_decayed("c", 7)} AS w FROM (SELECT *, row_number() {W} - 1 AS i FROM r))
    SELECT b.ticker, b.date, round(coalesce(c, 0), 6) AS consensus_score, round(coalesce(w, 0), 4) AS consensus_ewma_7d,
      coalesce(n, 0) AS coverage_count, round(coalesce(t, 0), 6) AS price_target_mean,
      round(coalesce((t - close) / greatest(close, 1e-8), 0), 6) AS target_upside
    FROM bars b LEFT JOIN e ON b.ticker = e.ticker AND b.date = e.date""",
)
def ratings_enrich(spark, sf_dir):
    cols = ["consensus_score", "price_target_mean", "target_upside"]
    out = enrich.with_ratings(bars(spark, sf_dir), proxies.ratings(spark, sf_dir))
    out = out.select("ticker", "date", *cols, "coverage_count", "consensus_ewma_7d")
    return rounded(rounded(out, *cols), "consensus_ewma_7d", digits=4)


@register(
    "asof_filings",
    f"""{N}, f AS (SELECT ticker, date AS fd, avg(sentiment_score) AS risk, avg(value) AS tone,
      max(CASE WHEN sentiment_label = 'positive' THEN 1 ELSE 0 END) AS gp, max(CASE WHEN event_id % 4 < 2 THEN 1 ELSE 0 END) AS rc
      FROM news WHERE event_type = 'purchase' GROUP BY ticker, date)
    SELECT b.ticker, b.date, f.fd AS filing_date, round(coalesce(risk, 0), 6) AS filing_risk, round(coalesce(tone, 0), 6) AS filing_tone,
      coalesce(gp, 0) AS guidance_positive, coalesce(rc, 0) AS risk_change_flag
    FROM bars b ASOF LEFT JOIN f ON b.ticker = f.ticker AND b.date >= f.fd""",
)
def asof_filings(spark, sf_dir):
    out = enrich.with_filings(bars(spark, sf_dir), proxies.filings(spark, sf_dir))
    out = out.select("ticker", "date", "filing_date", "filing_risk", "filing_tone", "guidance_positive", "risk_change_flag")
    return rounded(out, "filing_risk", "filing_tone")


@register(
    "cross_modal",
    f"""{N}, {proxies.SOCIAL_SQL}, d AS (SELECT ticker, date, avg(sentiment_score) AS a FROM news GROUP BY ticker, date),
    s AS (SELECT ticker, date, avg(score) AS s FROM social GROUP BY ticker, date),
    j AS (SELECT b.ticker, b.date, volume, coalesce(a, 0) AS a, coalesce(s, 0) AS s FROM bars b
      LEFT JOIN d ON b.ticker = d.ticker AND b.date = d.date LEFT JOIN s ON b.ticker = s.ticker AND b.date = s.date)
    SELECT ticker, date, round(a * ln(1 + greatest(volume, 0)), 6) AS sentiment_volume,
      round(a - lag(a, 5) {W}, 6) AS sentiment_momentum, round(a - s, 6) AS news_social_gap FROM j""",
)
def cross_modal(spark, sf_dir):
    cols = ["sentiment_volume", "sentiment_momentum", "news_social_gap"]
    b = bars(spark, sf_dir)
    out = b.join(enrich.daily_news(proxies.news(spark, sf_dir)), enrich.KEYS, "left").na.fill(0, ["avg_daily_sentiment"])
    social = proxies.social(spark, sf_dir).groupBy(*enrich.KEYS).agg(F.avg("score").alias("social_score"))
    out = enrich.cross_modal(out.join(social, enrich.KEYS, "left").na.fill(0, ["social_score"]))
    return rounded(out.select("ticker", "date", *cols), *cols)


_M = [f"m{i}" for i in range(1, 6)]


@register(
    "macro_pivot_ffill",
    f"""{WITH}, m AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS k, round(avg(o_totalprice), 4) AS v
      FROM orders GROUP BY 1, 2), d AS (SELECT DISTINCT date FROM bars),
    w AS (SELECT d.date, """
    + ", ".join(f"max(CASE WHEN k = '{k}' THEN v END) AS m{i}" for i, k in enumerate(proxies.MACRO, 1))
    + """ FROM d LEFT JOIN m ON d.date = m.date GROUP BY d.date)
    SELECT date, """
    + ", ".join(f"coalesce(last_value(m{i} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS m{i}" for i in range(1, 6))
    + " FROM w",
)
def macro_pivot_ffill(spark, sf_dir):
    dates = bars(spark, sf_dir).select("date").distinct()
    wide = series.pivot_fill(proxies.macro(spark, sf_dir), dates, proxies.MACRO)
    return wide.withColumnsRenamed(dict(zip(proxies.MACRO, _M, strict=True)))
