"""Gaps, coverage, freshness, validation, profiles, drift and table maintenance, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.operators import lake, series, validation
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources import proxies
from barloom.sources.bars import bars, table

_MISSING = f"""{WITH}, n AS (SELECT ticker, date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nx
  FROM (SELECT DISTINCT ticker, date FROM bars)),
g AS (SELECT ticker, CAST(unnest(generate_series(date + 1, nx - 1, INTERVAL 1 DAY)) AS DATE) AS missing_date
  FROM n WHERE nx > date + 1),
miss AS (SELECT * FROM g WHERE isodow(missing_date) < 6)"""


@register("gap_dates", f"{_MISSING} SELECT ticker, missing_date FROM miss")
def gap_dates(spark, sf_dir):
    return series.missing_dates(bars(spark, sf_dir))


@register(
    "gap_ranges",
    f"""{_MISSING}, p AS (SELECT ticker, missing_date, lag(missing_date) OVER (PARTITION BY ticker ORDER BY missing_date) AS pv FROM miss),
    r AS (SELECT *, sum(CASE WHEN pv IS NULL OR missing_date - pv > (CASE WHEN isodow(missing_date) = 1 THEN 3 ELSE 1 END)
      THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY missing_date) AS run FROM p)
    SELECT ticker, min(missing_date) AS start_date, max(missing_date) AS end_date, count(*) AS n_days,
      CASE WHEN count(*) <= 5 THEN 'low' WHEN count(*) <= 20 THEN 'medium' ELSE 'high' END AS severity
    FROM r GROUP BY ticker, run""",
)
def gap_ranges(spark, sf_dir):
    return series.missing_ranges(series.missing_dates(bars(spark, sf_dir)))


@register(
    "coverage",
    f"""{WITH}, c AS (SELECT ticker, min(date) AS a, max(date) AS b,
      count(DISTINCT CASE WHEN isodow(date) < 6 THEN date END) AS actual FROM bars GROUP BY ticker),
    x AS (SELECT ticker, actual, len(list_filter(generate_series(a, b, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS expected FROM c)
    SELECT ticker, CAST(expected AS BIGINT) AS expected, actual, CAST(expected - actual AS BIGINT) AS missing,
      round(actual * 100.0 / expected, 2) AS coverage_pct FROM x""",
)
def coverage(spark, sf_dir):
    return series.coverage(bars(spark, sf_dir))


AS_OF = "2001-11-10"


@register(
    "freshness",
    f"""{WITH} SELECT r_name AS market, max(date) AS latest_date, count(DISTINCT date) AS n_dates,
      CAST(DATE '{AS_OF}' - max(date) AS INTEGER) AS age_days,
      CASE WHEN DATE '{AS_OF}' - max(date) <= 7 THEN 'ok' WHEN max(date) IS NULL THEN 'missing' ELSE 'stale' END AS status
    FROM region LEFT JOIN bars ON market = r_name GROUP BY r_name""",
)
def freshness(spark, sf_dir):
    markets = table(spark, sf_dir, "region").select(F.col("r_name").alias("market"))
    return series.freshness(bars(spark, sf_dir), markets, AS_OF)


@register(
    "null_quality",
    f"""{WITH}, h AS (SELECT market, date, nullif(open, close) AS open, nullif(volume, 10) AS volume FROM bars)
    SELECT r_name AS market, count(date) AS n_rows, count(date) - count(open) AS open_nulls,
      count(date) - count(volume) AS volume_nulls
    FROM region LEFT JOIN (SELECT * FROM h WHERE date >= DATE '2000-01-01') ON market = r_name GROUP BY r_name""",
)
def null_quality(spark, sf_dir):
    holes = bars(spark, sf_dir).select(
        "market", "date", F.nullif("open", F.col("close")).alias("open"), F.nullif("volume", F.lit(10.0)).alias("volume")
    )
    markets = table(spark, sf_dir, "region").select(F.col("r_name").alias("market"))
    return validation.null_quality(holes, markets, F.lit("2000-01-01").cast("date"), ["open", "volume"])


@register(
    "price_rules",
    f"""{WITH}, u AS (SELECT ticker, date, CASE WHEN volume = 10 THEN -1 ELSE open END AS open, high,
        CASE WHEN volume = 20 THEN high + 1 ELSE low END AS low, close, volume FROM bars
      UNION ALL SELECT ticker, date, open, high, low, close, volume FROM bars WHERE volume = 30)
    SELECT 'open_positive' AS rule, count(*) FILTER (NOT open > 0) AS failed FROM u UNION ALL
    SELECT 'high_positive', count(*) FILTER (NOT high > 0) FROM u UNION ALL
    SELECT 'low_positive', count(*) FILTER (NOT low > 0) FROM u UNION ALL
    SELECT 'close_positive', count(*) FILTER (NOT close > 0) FROM u UNION ALL
    SELECT 'volume_not_negative', count(*) FILTER (NOT volume >= 0) FROM u UNION ALL
    SELECT 'high_is_highest', count(*) FILTER (NOT high >= greatest(open, close, low)) FROM u UNION ALL
    SELECT 'low_is_lowest', count(*) FILTER (NOT low <= least(open, close)) FROM u UNION ALL
    SELECT 'unique_key', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM u GROUP BY ticker, date)""",
)
def price_rules(spark, sf_dir):
    """Rules on bars with planted faults: bad opens, lows above highs, repeated keys."""
    b = bars(spark, sf_dir)
    planted = b.withColumns(
        {
            "open": F.when(F.col("volume") == 10, -1.0).otherwise(F.col("open")),
            "low": F.when(F.col("volume") == 20, F.col("high") + 1).otherwise(F.col("low")),
        }
    )
    return validation.violations(planted.unionByName(b.where("volume = 30")), validation.PRICE_RULES, ["ticker", "date"])


@register(
    "news_rules",
    f"""WITH {proxies.NEWS_SQL}, x AS (SELECT nullif(ticker, 'S0001') AS ticker, date, event_type AS headline,
      CAST(event_id % 900 AS VARCHAR) AS url, sentiment_score * 1.5 AS sentiment_score, nullif(event_type, 'view') AS source FROM news)
    SELECT 'ticker_not_null' AS rule, count(*) - count(ticker) AS failed FROM x UNION ALL
    SELECT 'date_not_null', count(*) - count(date) FROM x UNION ALL
    SELECT 'datetime_not_null', count(*) - count(date) FROM x UNION ALL
    SELECT 'source_not_null', count(*) - count(source) FROM x UNION ALL
    SELECT 'headline_not_null', count(*) - count(headline) FROM x UNION ALL
    SELECT 'url_not_null', count(*) - count(url) FROM x UNION ALL
    SELECT 'score_in_range', count(*) FILTER (NOT sentiment_score BETWEEN -1 AND 1) FROM x UNION ALL
    SELECT 'unique_key', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY url)""",
)
def news_rules(spark, sf_dir):
    planted = proxies.news(spark, sf_dir).select(
        F.nullif("ticker", F.lit("S0001")).alias("ticker"), "date", F.col("date").cast("timestamp").alias("datetime"),
        F.nullif("event_type", F.lit("view")).alias("source"), F.col("event_type").alias("headline"),
        (F.col("event_id") % 900).cast("string").alias("url"), (F.col("sentiment_score") * 1.5).alias("sentiment_score"),
    )
    return validation.violations(planted, validation.NEWS_RULES, ["url"])


_PROFILE = ["close", "volume", "open"]
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique,
    avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM {{0}}"""
    for c in _PROFILE
)


@register(
    "profile",
    f"""{WITH}, p AS ({_PROFILE_SQL.format("bars")}) SELECT "column", n, nulls, n_unique, round(mean, 6) AS mean,
    round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round((n - nulls) / n, 6) AS completeness,
    round(n_unique / n, 6) AS uniqueness FROM p""",
)
def profile(spark, sf_dir):
    out = validation.quality(validation.profile(bars(spark, sf_dir), _PROFILE))
    return rounded(out, "mean", "std", "min", "max", "completeness", "uniqueness")


_DRIFT_SQL = " UNION ALL ".join(
    f"SELECT b.\"column\", '{s}' AS statistic, c.{s} AS current, b.{s} AS baseline FROM c JOIN b USING (\"column\")"
    for s in ("mean", "std", "min", "max")
)


@register(
    "drift",
    f"""{WITH}, old AS (SELECT * FROM bars WHERE date < DATE '1998-06-01'), new AS (SELECT * FROM bars WHERE date >= DATE '1998-06-01'),
    b AS ({_PROFILE_SQL.format("old")}), c AS ({_PROFILE_SQL.format("new")}), l AS ({_DRIFT_SQL})
    SELECT "column", statistic, round(current, 6) AS current, round(baseline, 6) AS baseline,
      round(abs(current - baseline) / abs(baseline), 6) AS change, abs(current - baseline) / abs(baseline) > 0.1 AS drifted
    FROM l WHERE baseline <> 0""",
)
def drift(spark, sf_dir):
    sides = bars(spark, sf_dir).withColumn("late", F.col("date") >= F.lit("1998-06-01").cast("date"))
    both = validation.summary(sides, _PROFILE, "late")
    old, new = (both.where(c).drop("late") for c in (~F.col("late"), F.col("late")))
    return rounded(validation.drift(new, old), "current", "baseline", "change")


@register(
    "clean_bars",
    f"""{WITH}, u AS (SELECT ticker, date, close, nullif(volume, 10) AS volume, 1 AS v FROM bars UNION ALL
      SELECT ticker, date, CASE WHEN volume = 40 THEN -close ELSE close * 2 END, volume, 2 FROM bars WHERE volume > 30)
    SELECT ticker, date, round(close, 6) AS close, coalesce(volume, 0) AS volume, v FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY v DESC) AS k FROM u) WHERE k = 1 AND close > 0""",
)
def clean_bars(spark, sf_dir):
    """The last version of each ticker and date, of equal ones that of the last market, without bad closes and null volumes."""
    b = bars(spark, sf_dir).select("market", "ticker", "date", "close", "volume")
    old = b.withColumns({"volume": F.nullif("volume", F.lit(10.0)), "v": F.lit(1)})
    fixed = F.when(F.col("volume") == 40, -F.col("close")).otherwise(F.col("close") * 2)
    new = b.where("volume > 30").withColumns({"close": fixed, "v": F.lit(2)})
    made = validation.clean(old.unionByName(new), ["ticker", "date"], [F.col("v"), F.col("market")])
    return rounded(made.drop("market"), "close")


@register(
    "upsert_merge",
    f"""{WITH}, a AS (SELECT ticker, date, close FROM bars WHERE date < DATE '1998-06-01'),
    s AS (SELECT ticker, date, close + 1000 AS close FROM bars WHERE date >= DATE '1998-01-20')
    SELECT ticker, date, close FROM s UNION ALL
    SELECT ticker, date, close FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ticker = a.ticker AND s.date = a.date)""",
)
def upsert_merge(spark, sf_dir):
    """All bars: a table written, then merged with later and re-priced rows by key, then compacted and read."""
    b = bars(spark, sf_dir).select("ticker", "date", "close", F.date_format("date", "yyyy-MM").alias("month"))
    path = f"{lake.scratch(spark)}/upsert-{uuid.uuid4().hex}"
    t = lake.LakeTable(spark, path, ["ticker", "date", "month"], "month")
    t.upsert(b.where("date < date'1998-06-01'"))
    t.upsert(b.where("date >= date'1998-01-20'").withColumn("close", F.col("close") + 1000))
    t.compact()
    return t.read().drop("month")
