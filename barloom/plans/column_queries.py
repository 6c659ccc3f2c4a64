"""Ratios, ranks, joined weights, trades counted, feed items, redaction, whole rows and macro series, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import columns, enrich, series, texts, trading
from barloom.plans.feature_queries import W
from barloom.plans.learning_queries import _CROSS, _CURVE
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources.bars import bars, table

_RATIOS = list(columns.STATEMENT_RATIOS)


@register(
    "statement_ratios",
    """WITH s AS (SELECT CAST(l_orderkey AS BIGINT) AS filing, sum(l_extendedprice) AS revenue, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS net_income,
      sum(l_extendedprice * l_discount) AS operating_income, sum(l_tax) AS stockholders_equity, 127 * sum(l_quantity) AS total_assets, sum(l_discount) AS total_debt FROM lineitem GROUP BY l_orderkey)
    SELECT filing, CAST(NULL AS DOUBLE) AS eps, round(net_income / nullif(stockholders_equity, 0), 3) AS roe, round(net_income / nullif(total_assets, 0), 6) AS roa,
      round(total_debt / nullif(stockholders_equity, 0), 6) AS debt_to_equity, round(net_income / nullif(revenue, 0), 6) AS net_margin,
      round(operating_income / nullif(revenue, 0), 6) AS operating_margin FROM s""",
)
def statement_ratios(spark, sf_dir):
    """All ratios of statements that name no shares."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("filing")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("net_income"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("operating_income"), F.sum("l_tax").alias("stockholders_equity"),
        (F.sum("l_quantity") * 127).alias("total_assets"), F.sum("l_discount").alias("total_debt"),
    )
    return rounded(rounded(columns.with_ratios(s).select("filing", *_RATIOS), *_RATIOS[2:]), "roe", digits=3)


@register(
    "average_ranks",
    f"""{WITH}, r AS (SELECT ticker, date, volume, rank() OVER (PARTITION BY date ORDER BY volume DESC) AS k, count(*) OVER (PARTITION BY date, volume) AS n FROM bars)
    SELECT ticker, date, k + (n - 1) / 2.0 AS rank FROM r""",
)
def average_ranks(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", columns.average_rank("volume", "date").alias("rank"))


@register(
    "weights_joined",
    f"""{WITH}, w AS (SELECT ticker, date, 1 / count(*) OVER (PARTITION BY date) AS weight FROM bars WHERE volume > 25)
    SELECT b.ticker, b.date, b.volume, round(coalesce(weight, 0), 6) AS weight FROM bars b LEFT JOIN w ON b.ticker = w.ticker AND b.date = w.date""",
)
def weights_joined(spark, sf_dir):
    """A table of weights, equal among the day's large volumes, onto all prices."""
    b = bars(spark, sf_dir)
    day = b.where("volume > 25").withColumn("weight", 1 / F.count("*").over(columns.Window.partitionBy("date")))
    return rounded(trading.with_weights(b, day).select("ticker", "date", "volume", "weight"), "weight")


@register(
    "trade_counts",
    f"""{_CROSS}, b AS (SELECT *, CASE WHEN weight <> 0 AND coalesce(lag(weight) {W}, 0) = 0 THEN 1 ELSE 0 END AS b FROM wt),
    t AS (SELECT *, sum(b) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS tr FROM b),
    g AS (SELECT ticker, tr, count(*) AS n, last(close ORDER BY date) / first(close ORDER BY date) - 1 AS r FROM t WHERE weight <> 0 GROUP BY ticker, tr)
    SELECT count(*) AS n_trades, count(DISTINCT ticker) AS n_tickers, round(count(*) FILTER (r > 0) / count(*), 6) AS win_share, round(avg(n), 6) AS mean_bars,
      round(avg(r), 6) AS mean_trade_return FROM g""",
)
def trade_counts(spark, sf_dir):
    out = trading.trade_metrics(trading.SmaCross().weights(bars(spark, sf_dir)))
    return rounded(out, "win_share", "mean_bars", "mean_trade_return")


@register("backtest_log_return", f"{_CURVE} SELECT round(ln(last(value ORDER BY date)), 6) AS log_return, count(*) AS n_days FROM cv")
def backtest_log_return(spark, sf_dir):
    """The whole return of a backtest as its log, of which all digits count."""
    curve = trading.equity_curve(trading.SmaCross().weights(bars(spark, sf_dir)))
    return rounded(curve.agg(F.ln(F.max_by("value", "date")).alias("log_return"), F.count("*").alias("n_days")), "log_return")


@register(
    "feed_items",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND trim(coalesce(text, ''), ' ') <> '' THEN trim(text, ' ') WHEN doc_id % 3 < 2 AND trim(source, ' ') <> '' THEN trim(source, ' ') ELSE lang END AS body FROM documents""",
)
def feed_items(spark, sf_dir):
    """Items' content, else their summary, else their title."""
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    summary = F.when(F.col("doc_id") % 3 < 2, F.col("source")).otherwise("  ")
    return d.select("doc_id", columns.item_text(F.col("lang"), summary, content).alias("body"))


@register(
    "redacted_json",
    """SELECT event_id, '{"a":{"api_key":"***","list":[{"Token":"***","n":1}]},"note":"key ' || event_type || '","secret":"***","user":' || user_id || '}' AS props FROM events""",
)
def redacted_json(spark, sf_dir):
    """Nested properties without their secrets."""
    e = table(spark, sf_dir, "events")
    inner = F.struct(F.concat(F.lit('q"u'), F.col("value").cast("string")).alias("api_key"), F.array(F.struct(F.col("value").alias("Token"), F.lit(1).alias("n"))).alias("list"))
    note = F.concat(F.lit("key "), F.col("event_type"))
    props = F.to_json(F.struct(inner.alias("a"), note.alias("note"), (F.col("event_id") % 2 == 0).alias("secret"), F.col("user_id").alias("user")))
    return e.select("event_id", texts.redact_json(props).alias("props"))


@register(
    "tolerant_json",
    """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k, event_id % 3 > 0 AS whole FROM events""",
)
def tolerant_json(spark, sf_dir):
    """Properties read as a record; texts that are cut off give nulls."""
    cut = F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", cut.alias("props"))
    return rows.select("event_id", texts.tolerant_json("props", "k long").k.cast("double").alias("k"), F.try_parse_json("props").isNotNull().alias("whole"))


_MACRO = [*enrich.MACRO, "vix_change_5d", "dxy_change_5d", "yield_curve_slope"]


@register(
    "macro_enrich",
    f"""{WITH}, m AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey % 8 AS k, round(avg(o_totalprice), 4) AS v FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1, 2),
    d AS (SELECT DISTINCT date FROM bars),
    w AS (SELECT d.date, {", ".join(f"max(v) FILTER (k = {i}) AS {n}" for i, n in enumerate(enrich.MACRO))} FROM d LEFT JOIN m ON d.date = m.date GROUP BY d.date),
    f AS (SELECT date, {", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {n}" for n in enrich.MACRO)} FROM w),
    x AS (SELECT *, vix - lag(vix, 5) OVER (ORDER BY date) AS vix_change_5d, dxy - lag(dxy, 5) OVER (ORDER BY date) AS dxy_change_5d,
      treasury_10y - tips_yield AS yield_curve_slope FROM f)
    SELECT ticker, b.date, {", ".join(f"round(coalesce({n}, 0), 4) AS {n}" for n in _MACRO)} FROM bars b JOIN x ON b.date = x.date""",
)
def macro_enrich(spark, sf_dir):
    """All eight series on the bars, with their changes and slope."""
    name = F.element_at(F.array(*map(F.lit, enrich.MACRO)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderdate").cast("date").alias("date"), name.alias("indicator"), "o_totalprice")
    macro = o.groupBy("date", "indicator").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return rounded(enrich.with_macro(bars(spark, sf_dir).select("ticker", "date"), macro), *_MACRO, digits=4)


@register(
    "head_and_tail",
    f"""{WITH}, n AS (SELECT ticker, date, row_number() {W} AS i, count(*) OVER (PARTITION BY ticker) AS c FROM bars)
    SELECT ticker, date, CASE WHEN i <= 3 THEN 'head' WHEN i > c - 2 THEN 'tail' ELSE 'middle' END AS place FROM n WHERE i <= 3 OR i > c - 2 OR i BETWEEN 11 AND 15""",
)
def head_and_tail(spark, sf_dir):
    """Each ticker's first three and last two bars, and the 11th to 15th."""
    return series.slices(bars(spark, sf_dir), {"head": (0, 3), "tail": (-2, None), "middle": (10, 15)}).select("ticker", "date", "place")
