"""News, social, macro, ratings and filings frames from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import table

#: Days that move event dates into the bars' range.
SHIFT = 9000
MACRO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, sentiment_score, sentiment_label, url, event_type, props; every event is an article."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_tickers"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    score = (F.pmod(F.col("event_id") * 37, F.lit(201)) - 100) / 127.0
    return e.select(
        F.pmod("user_id", "n_tickers").alias("k"), F.date_sub(F.col("ts").cast("date"), SHIFT).alias("date"),
        score.alias("sentiment_score"), "event_id", "event_type", "value", "props",
    ).select(
        F.concat(F.lit("S"), F.lpad((F.col("k") + 1).cast("string"), 4, "0")).alias("ticker"),
        "date", "sentiment_score",
        F.when(F.col("sentiment_score") >= 0.05, "positive").when(F.col("sentiment_score") <= -0.05, "negative").otherwise("neutral").alias("sentiment_label"),
        F.concat(F.lit("https://news.example/"), F.col("event_id").cast("string")).alias("url"),
        "event_id", "event_type", "value", "props",
    )


NEWS_SQL = f"""news AS (
  SELECT 'S' || lpad(CAST(user_id % (SELECT count(*) FROM supplier) + 1 AS VARCHAR), 4, '0') AS ticker,
         CAST(ts AS DATE) - {SHIFT} AS date, s AS sentiment_score,
         CASE WHEN s >= 0.05 THEN 'positive' WHEN s <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
         event_id, event_type, value, props
  FROM (SELECT *, ((event_id * 37) % 201 - 100) / 127.0 AS s FROM events))"""


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, source, mention_count, score, positive_score, negative_score."""
    source = F.when(F.col("event_type").isin("click", "view"), "reddit").otherwise("twitter")
    score = (F.pmod(F.col("event_id") * 53, F.lit(201)) - 100) / 127.0
    return news(spark, sf_dir).select(
        "ticker", "date", source.alias("source"), F.lit(1).cast("long").alias("mention_count"), score.alias("score"),
        F.greatest(score, F.lit(0.0)).alias("positive_score"), F.greatest(-score, F.lit(0.0)).alias("negative_score"),
    )


SOCIAL_SQL = """social AS (
  SELECT ticker, date, event_type IN ('click', 'view') AS reddit, ((event_id * 53) % 201 - 100) / 127.0 AS score FROM news)"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, indicator, value: the mean order by day and priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("indicator"), "o_totalprice")
    return o.groupBy("date", "indicator").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, filing_date, risk, tone, guidance, novelty: purchases stand for filings."""
    novelty = F.element_at(F.array(*map(F.lit, ("new", "modified", "repeated", "repeated"))), (F.col("event_id") % 4 + 1).cast("int"))
    return news(spark, sf_dir).where("event_type = 'purchase'").select(
        "ticker", F.col("date").alias("filing_date"), F.col("sentiment_score").alias("risk"), F.col("value").alias("tone"),
        F.col("sentiment_label").alias("guidance"), novelty.alias("novelty"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, consensus_score, price_target_mean, coverage_count: one row a day."""
    return news(spark, sf_dir).groupBy("ticker", "date").agg(
        F.avg("sentiment_score").alias("consensus_score"), F.avg(F.col("value") * 10).alias("price_target_mean"),
        F.count("*").alias("coverage_count"),
    )
