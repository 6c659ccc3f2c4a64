"""Loading, summaries, source columns, enriched articles, macro changes and prediction signals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import columns, enrich, loading, predictions, series, validation
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources import proxies
from barloom.sources.bars import bars, table

_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_R = "ROWS UNBOUNDED PRECEDING"


@register(
    "unified_view",
    f"""{WITH} SELECT market, ticker, date, round(close, 6) AS close, volume FROM bars WHERE market <> 'ASIA'""",
)
def unified_view(spark, sf_dir):
    """The views of all markets but one that is missing."""
    b = bars(spark, sf_dir)
    frames = {r: None if r == "ASIA" else b.where(F.col("market") == r).drop("market") for r in _REGIONS}
    return rounded(loading.unified_view(spark, frames).select("market", "ticker", "date", "close", "volume"), "close")


_LOADED = f"""{WITH}, sel AS (SELECT DISTINCT ticker FROM bars WHERE volume > 45),
v AS (SELECT ticker, date, CASE WHEN volume % 3 = 0 THEN NULL ELSE open END AS open, CASE WHEN volume % 3 = 0 THEN NULL ELSE high END AS high,
    CASE WHEN volume % 3 = 0 THEN NULL ELSE low END AS low, CASE WHEN volume % 3 = 0 THEN NULL ELSE close END AS close, volume, 1 AS v FROM bars
  UNION ALL SELECT ticker, date, open, high, low, close * 2, volume, 2 FROM bars WHERE volume > 40),
u AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY ticker, date ORDER BY v DESC) AS k FROM v
  WHERE ticker IN (SELECT ticker FROM sel) AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') WHERE k = 1)"""


def _versions(spark, sf_dir):
    b = bars(spark, sf_dir)
    gone = F.col("volume") % 3 == 0
    old = b.withColumns({c: F.when(~gone, F.col(c)) for c in loading.PRICES}).withColumn("v", F.lit(1))
    new = b.where("volume > 40").withColumns({"close": F.col("close") * 2, "v": F.lit(2)})
    return old.unionByName(new), b.where("volume > 45").select("ticker")


def _filled(take: str, frame: str) -> str:
    over = f"IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {frame})"
    prices = ", ".join(f"{take}({c} {over} AS {c}" for c in (*loading.PRICES, "volume"))
    rounds = ", ".join(f"round({c}, 6) AS {c}" for c in loading.PRICES)
    return f"""{_LOADED} SELECT ticker, date, {rounds}, volume FROM (SELECT ticker, date, {prices} FROM u)
    WHERE open IS NOT NULL OR high IS NOT NULL OR low IS NOT NULL OR close IS NOT NULL"""


@register("backtest_load", _filled("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def backtest_load(spark, sf_dir):
    rows, chosen = _versions(spark, sf_dir)
    out = loading.backtest_load(rows, chosen, "1996-01-01", "1997-12-31", "v")
    return rounded(out.drop("market"), *loading.PRICES)


@register("backtest_load_backward", _filled("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def backtest_load_backward(spark, sf_dir):
    rows, chosen = _versions(spark, sf_dir)
    out = loading.backtest_load(rows, chosen, "1996-01-01", "1997-12-31", "v", "bfill")
    return rounded(out.drop("market"), *loading.PRICES)


@register("tickers_as_of", f"{WITH} SELECT DISTINCT market, ticker FROM bars WHERE date <= DATE '1995-03-01'")
def tickers_as_of(spark, sf_dir):
    return loading.tickers_as_of(bars(spark, sf_dir), "1995-03-01")


@register("date_range", f"{WITH} SELECT market, ticker, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY market, ticker")
def date_range(spark, sf_dir):
    return loading.date_range(bars(spark, sf_dir), "market", "ticker")


@register(
    "feature_check",
    f"""{WITH} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS tickers, max(date) AS latest_date,
    CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM bars WHERE date >= DATE '1998-06-10' - 7""",
)
def feature_check(spark, sf_dir):
    return loading.feature_check(bars(spark, sf_dir), "1998-06-10")


@register(
    "dataset_summary",
    """SELECT 'trades' AS dataset, count(*) AS n_rows, count(DISTINCT l_suppkey) AS symbols, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS latest FROM lineitem
    UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM events
    UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) FROM orders""",
)
def dataset_summary(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    frames = {
        "trades": (t("lineitem"), "l_suppkey", "l_shipdate"),
        "events": (t("events"), "user_id", "ts"),
        "orders": (t("orders"), "o_custkey", "o_orderdate"),
    }
    return loading.dataset_summary(frames)


@register(
    "browse_latest",
    f"{WITH} SELECT market, ticker, date, round(close, 6) AS close, volume FROM bars ORDER BY date DESC, market, ticker LIMIT 100",
)
def browse_latest(spark, sf_dir):
    return rounded(loading.browse_latest(bars(spark, sf_dir).select("market", "ticker", "date", "close", "volume")), "close")


@register(
    "present_on",
    f"""{WITH}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), n AS (SELECT date, count(*) AS n FROM bars GROUP BY date)
    SELECT d.date, coalesce(n, 0) AS n_rows, n IS NOT NULL AS present FROM d LEFT JOIN n ON d.date = n.date""",
)
def present_on(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return loading.present_on(bars(spark, sf_dir), dates)


_BUCKETS = "\n".join(
    f"count(*) FILTER ({c}) AS {n},"
    for n, c in (
        ("strong_buy", "s > 0.5"), ("buy", "s > 0.1 AND s <= 0.5"), ("hold", "s >= -0.1 AND s <= 0.1"),
        ("sell", "s >= -0.5 AND s < -0.1"), ("strong_sell", "s < -0.5"),
    )
)


@register(
    "rating_consensus",
    f"""WITH {proxies.NEWS_SQL}, c AS (SELECT ticker, date, {_BUCKETS} count(*) AS n
      FROM (SELECT ticker, date, sentiment_score AS s FROM news) GROUP BY ticker, date)
    SELECT ticker, date, strong_buy, buy, hold, sell, strong_sell,
      round((2 * strong_buy + buy - sell - 2 * strong_sell) / n, 6) AS consensus_score,
      CASE greatest(strong_buy, buy, hold, sell, strong_sell) WHEN strong_buy THEN 'strong_buy' WHEN buy THEN 'buy'
        WHEN hold THEN 'hold' WHEN sell THEN 'sell' ELSE 'strong_sell' END AS consensus_label FROM c""",
)
def rating_consensus(spark, sf_dir):
    s = F.col("sentiment_score")
    buckets = {
        "strong_buy": s > 0.5, "buy": (s > 0.1) & (s <= 0.5), "hold": s.between(-0.1, 0.1),
        "sell": (s >= -0.5) & (s < -0.1), "strong_sell": s < -0.5,
    }
    counts = proxies.news(spark, sf_dir).groupBy("ticker", "date").agg(*[F.count_if(c).alias(n) for n, c in buckets.items()])
    return rounded(columns.consensus(counts), "consensus_score")


@register(
    "filing_rows",
    """SELECT CAST(l_orderkey AS BIGINT) AS filing, l_returnflag AS form, CAST(l_shipdate AS DATE) AS filed
    FROM lineitem WHERE l_returnflag IN ('A', 'R') AND CAST(l_shipdate AS DATE) >= DATE '1995-06-01'""",
)
def filing_rows(spark, sf_dir):
    """Arrays of forms and dates that run side by side, as rows of the wanted forms and dates."""
    line = F.struct("l_linenumber", "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("filing")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    arrays = lines.select("filing", F.col("x.l_returnflag").alias("form"), F.col("x.d").alias("filed"))
    rows = columns.zipped_rows(arrays, ["form", "filed"], "filing")
    return rows.where(F.col("form").isin("A", "R") & (F.col("filed") >= F.lit("1995-06-01").cast("date")))


@register(
    "safe_ratios",
    """SELECT CAST(l_orderkey AS BIGINT) AS filing, round(sum(l_discount) / nullif(sum(l_tax), 0), 6) AS debt_to_equity,
      round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / nullif(sum(l_extendedprice), 0), 6) AS net_margin
    FROM lineitem GROUP BY l_orderkey""",
)
def safe_ratios(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("filing")).agg(
        F.sum("l_discount").alias("debt"), F.sum("l_tax").alias("equity"), F.sum("l_extendedprice").alias("revenue"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0)).alias("income"),
    )
    out = sums.select("filing", columns.ratio("debt", "equity").alias("debt_to_equity"), columns.ratio("income", "revenue").alias("net_margin"))
    return rounded(out, "debt_to_equity", "net_margin")


@register(
    "mixed_dates",
    """SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day,
      strftime(make_timestamp(CAST(o_orderkey AS BIGINT) * 1000000000), '%Y-%m-%d %H:%M:%S') AS epoch FROM orders""",
)
def mixed_dates(spark, sf_dir):
    """Dates written in six ways, one of them no date, and epoch seconds."""
    d, i = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    text = (
        F.when(i == 0, F.date_format(d, "yyyy-MM-dd")).when(i == 1, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z")))
        .when(i == 2, F.concat(F.date_format(d, "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).when(i == 3, F.date_format(d, "MM/dd/yyyy"))
        .when(i == 4, F.date_format(d, "yyyyMMdd")).otherwise("soon")
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), text.alias("text"))
    epoch = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.col("k") * 1000), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return rows.select("k", F.date_format(columns.any_timestamp(F.col("text")), "yyyy-MM-dd").alias("day"), epoch.alias("epoch"))


@register(
    "exchange_symbols",
    """SELECT CAST(p_partkey AS BIGINT) AS k, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') ||
      CASE left(lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0'), 1) WHEN '0' THEN '.SZ' WHEN '2' THEN '.SZ' WHEN '3' THEN '.SZ'
        WHEN '4' THEN '.BJ' WHEN '8' THEN '.BJ' ELSE '.SS' END AS symbol FROM part""",
)
def exchange_symbols(spark, sf_dir):
    code = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    coded = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), columns.yahoo_symbol(code).alias("symbol"))
    return coded.withColumn("symbol", columns.yahoo_symbol(F.col("symbol")))


@register(
    "speakers",
    """SELECT conv_id, array_to_string([x.role for x in list_sort(list(first_turn))], ',') AS speakers,
      CAST(sum(n) AS BIGINT) AS turns FROM (SELECT conv_id, struct_pack(t := min(turn), role := role) AS first_turn, count(*) AS n
      FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""",
)
def speakers(spark, sf_dir):
    """The roles of a conversation in the order of their first turn."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("x"))
    return out.select("conv_id", F.array_join(F.array_distinct("x.role"), ",").alias("speakers"), F.size("x").cast("long").alias("turns"))


_MEANS = ["enriched_sentiment_mean", "enriched_confidence_mean", "enriched_relevance_mean", "bullish_ratio", "social_sentiment_mean"]
_ARTICLE_DECAY = ", ".join(
    f"""sum(s * pow(2, i / {h}.0)) OVER o / sum(pow(2, i / {h}.0)) OVER o AS enriched_sentiment_ewma_{h}d""" for h in (3, 7)
)


def enriched_news(spark, sf_dir):
    """Every event as an enriched article of its ticker."""
    n = proxies.news(spark, sf_dir)
    social, bullish = F.col("event_type").isin("click", "view"), F.col("sentiment_label") == "positive"
    return n.select(
        "ticker", "date", "sentiment_score", F.when(bullish, "bullish").otherwise("other").alias("sentiment_label"),
        (F.col("event_id") % 83 / 89.0).alias("confidence"), (F.col("event_id") % 120 / 127.0).alias("market_relevance"),
        F.when(social, "reddit").otherwise("rss").alias("source_type"),
        F.when(F.col("event_type") == "purchase", "short").otherwise("long").alias("impact_horizon"),
    )


@register(
    "enriched_articles",
    f"""{WITH}, {proxies.NEWS_SQL},
    marked AS (SELECT *, event_type IN ('click', 'view') AS social, event_id % 120 / 127.0 AS relevance FROM news),
    days AS (SELECT ticker, date, avg(sentiment_score) AS s, avg(event_id % 83 / 89.0) AS c, avg(relevance) AS r, avg(sentiment_score) FILTER (social) AS o,
      count(*) FILTER (sentiment_label = 'positive') / count(*) AS u, count(*) AS n, count(*) FILTER (social) AS v,
      count(*) FILTER (event_type = 'purchase' AND relevance > 0.8) AS urgent FROM marked GROUP BY ticker, date),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM days),
    aged AS (SELECT *, {_ARTICLE_DECAY} FROM numbered WINDOW o AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))
    SELECT b.ticker, b.date, ifnull(n, 0) AS enriched_article_count, round(ifnull(s, 0), 6) AS enriched_sentiment_mean,
      round(ifnull(c, 0), 6) AS enriched_confidence_mean, round(ifnull(r, 0), 6) AS enriched_relevance_mean, round(ifnull(u, 0), 6) AS bullish_ratio,
      ifnull(v, 0) AS social_volume, round(ifnull(o, 0), 6) AS social_sentiment_mean, CAST(ifnull(urgent, 0) > 0 AS INTEGER) AS breaking_news_flag,
      round(ifnull(enriched_sentiment_ewma_3d, 0), 4) AS enriched_sentiment_ewma_3d, round(ifnull(enriched_sentiment_ewma_7d, 0), 4) AS enriched_sentiment_ewma_7d
    FROM bars b LEFT JOIN aged ON aged.ticker = b.ticker AND aged.date = b.date""",
)
def enriched_articles(spark, sf_dir):
    """Articles by ticker and day onto the bars, with decayed means; days without any are zero."""
    out = enrich.with_articles(bars(spark, sf_dir).select("ticker", "date"), enriched_news(spark, sf_dir))
    return rounded(rounded(out, *_MEANS), "enriched_sentiment_ewma_3d", "enriched_sentiment_ewma_7d", digits=4)


@register(
    "news_metrics",
    f"""WITH {proxies.NEWS_SQL} SELECT count(*) AS n_rows, count(*) FILTER (props IS NULL OR trim(props) = '') AS missing_text,
      count(event_type) - count(DISTINCT event_type) AS duplicate_types, min(date) AS first_date, max(date) AS last_date,
      count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'negative') AS negative FROM news""",
)
def news_metrics(spark, sf_dir):
    return validation.article_metrics(proxies.news(spark, sf_dir), "props", "event_type")


@register(
    "sparse_columns",
    f"""{WITH}, b AS (SELECT CASE WHEN volume > 20 THEN NULL ELSE close END AS thin, CAST(NULL AS DOUBLE) AS gone, volume FROM bars),
    n AS (SELECT 'thin' AS "column", count(*) - count(thin) AS n_nulls, count(*) AS n FROM b
      UNION ALL SELECT 'gone', count(*) - count(gone), count(*) FROM b UNION ALL SELECT 'volume', count(*) - count(volume), count(*) FROM b)
    SELECT "column", n_nulls, round(n_nulls / n, 6) AS share, CASE WHEN n_nulls = n THEN 'empty' WHEN n_nulls > 0.5 * n THEN 'sparse' ELSE 'ok' END AS status FROM n""",
)
def sparse_columns(spark, sf_dir):
    b = bars(spark, sf_dir).select(F.when(F.col("volume") <= 20, F.col("close")).alias("thin"), F.lit(None).cast("double").alias("gone"), "volume")
    return rounded(validation.column_status(b), "share")


@register(
    "macro_changes",
    f"""{WITH}, m AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS k, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2),
    w AS (SELECT d.date, max(CASE WHEN k = '1-URGENT' THEN v END) AS a, max(CASE WHEN k = '2-HIGH' THEN v END) AS b,
      max(CASE WHEN k = '3-MEDIUM' THEN v END) AS c FROM (SELECT DISTINCT date FROM bars) d LEFT JOIN m ON d.date = m.date GROUP BY d.date),
    f AS (SELECT date, {", ".join(f"last_value({x} IGNORE NULLS) OVER (ORDER BY date {_R}) AS {x}" for x in "abc")} FROM w)
    SELECT b.ticker, b.date, round(coalesce(vix_change_5d, 0), 4) AS vix_change_5d, round(coalesce(yield_curve_slope, 0), 4) AS yield_curve_slope
    FROM bars b JOIN (SELECT date, a - lag(a, 5) OVER (ORDER BY date) AS vix_change_5d, b - c AS yield_curve_slope FROM f) x ON b.date = x.date""",
)
def macro_changes(spark, sf_dir):
    """Macro values on the bars' dates, filled forward; five-row change and slope, zero where unknown, onto the bars."""
    b = bars(spark, sf_dir).select("ticker", "date")
    names = {"1-URGENT": "vix", "2-HIGH": "treasury_10y", "3-MEDIUM": "tips_yield"}
    long = proxies.macro(spark, sf_dir).replace(names, subset=["indicator"])
    derived = series.macro_derived(long, b.select("date").distinct(), list(names.values()))
    return rounded(b.join(derived.select("date", "vix_change_5d", "yield_curve_slope"), "date"), "vix_change_5d", "yield_curve_slope", digits=4)


_PRED = f"""{WITH}, p AS (SELECT ticker, date, (volume * 37 % 101) / 101.0 AS p, (volume * 53 % 97) / 97.0 AS q FROM bars),
d AS (SELECT ticker, date, 'ml' AS signal_type, CASE WHEN p >= 0.5 THEN 'BUY' ELSE 'SELL' END AS action,
  CASE WHEN p >= 0.5 THEN p * 100 ELSE (1 - p) * 100 END AS confidence FROM p WHERE (p >= 0.6 OR p <= 0.4)),
m AS (SELECT ticker, date, 'meta' AS signal_type, 'BUY' AS action, q * 100 AS confidence FROM p WHERE q >= 0.55),
u AS (SELECT * FROM d WHERE confidence >= 60 UNION ALL SELECT * FROM m)"""


def _predicted(spark, sf_dir):
    return bars(spark, sf_dir).select(
        "ticker", "date", (F.col("volume") * 37 % 101 / 101.0).alias("probability"),
        (F.col("volume") * 53 % 97 / 97.0).alias("execution_probability"), F.lit("BUY").alias("candidate_action"),
    )


@register(
    "signal_scan",
    f"""{_PRED} SELECT ticker, date, signal_type, action, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (
      PARTITION BY ticker, date ORDER BY confidence DESC, signal_type DESC, action DESC) AS k FROM u) WHERE k = 1""",
)
def signal_scan(spark, sf_dir):
    """Direction and meta-label signals of all tickers and dates, the most confident of each."""
    p = _predicted(spark, sf_dir)
    direction = predictions.direction_signals(p).drop("probability").withColumn("signal_type", F.lit("ml"))
    meta = predictions.accepted_candidates(p).withColumn("signal_type", F.lit("meta"))
    return rounded(predictions.scan_signals(direction, meta), "confidence")


@register(
    "unknown_tickers",
    f"""{WITH} SELECT DISTINCT 'S' || lpad(CAST(c_custkey % 700 AS VARCHAR), 4, '0') AS ticker FROM customer
    WHERE 'S' || lpad(CAST(c_custkey % 700 AS VARCHAR), 4, '0') NOT IN (SELECT ticker FROM bars)""",
)
def unknown_tickers(spark, sf_dir):
    listed = F.concat(F.lit("S"), F.lpad((F.col("c_custkey") % 700).cast("string"), 4, "0"))
    return predictions.unknown_tickers(table(spark, sf_dir, "customer").select(listed.alias("ticker")), bars(spark, sf_dir))


@register(
    "model_as_of",
    f"""{WITH}, m AS (SELECT CAST(x AS DATE) AS trained_on, 'm' || strftime(x, '%Y%m') AS model FROM (
      SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', INTERVAL 3 MONTH)) AS x)),
    d AS (SELECT DISTINCT date FROM bars) SELECT d.date, trained_on, model FROM d ASOF LEFT JOIN m ON d.date >= m.trained_on""",
)
def model_as_of(spark, sf_dir):
    days = F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1998-01-01").cast("date"), F.expr("interval 3 months"))
    models = spark.range(1).select(F.explode(days).alias("trained_on"))
    models = models.withColumn("model", F.concat(F.lit("m"), F.date_format("trained_on", "yyyyMM")))
    return predictions.model_as_of(bars(spark, sf_dir).select("date").distinct(), models)
