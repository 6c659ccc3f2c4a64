"""Articles and what was extracted from them: fallbacks, one row an article and ticker, the article's own columns, relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import valence

EXTRACTION = """article_id long, tickers array<string>, sentiment_score double, sentiment_label string, confidence double, event_type string,
key_entities array<string>, summary string, impact_horizon string, market_relevance double"""
#: How sure and how relevant a score by the lexicon alone counts.
FALLBACK_CONFIDENCE, FALLBACK_RELEVANCE = 0.3, 0.3
_SIDES = {"positive": "bullish", "negative": "bearish"}


def fallback(articles: DataFrame, lexicon: DataFrame, rules: valence.Rules = valence.Rules()) -> DataFrame:  # noqa: B008
    """Extractions of articles (article_id, title, body) by the words' valence alone: no ticker, a general event of short horizon."""
    text = F.concat_ws(" ", "title", "body")
    scored = valence.score(articles.select("article_id", text.alias("_text")), lexicon, "article_id", "_text", rules)
    side = F.coalesce(*[F.when(F.col("label") == a, b) for a, b in _SIDES.items()], F.lit("neutral"))
    none = F.array().cast("array<string>")
    made = scored.select(
        "article_id", none.alias("tickers"), F.col("compound").alias("sentiment_score"), side.alias("sentiment_label"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"), F.lit("general").alias("event_type"), none.alias("key_entities"),
        F.lit("short").alias("impact_horizon"), F.lit(FALLBACK_RELEVANCE).alias("market_relevance"),
    )
    titles = articles.select("article_id", F.substring(F.coalesce("title", F.lit("")), 1, 200).alias("summary"))
    return made.join(titles, "article_id")


def complete(articles: DataFrame, extractions: DataFrame, lexicon: DataFrame, rules: valence.Rules = valence.Rules()) -> DataFrame:  # noqa: B008
    """The given extractions, and fallbacks of the articles without one."""
    missing = articles.join(extractions.select("article_id"), "article_id", "left_anti")
    return extractions.unionByName(fallback(missing, lexicon, rules).select(*extractions.columns))


def silver(extractions: DataFrame, articles: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each extraction and ticker, one with a null ticker where none was found, with the columns ``keep`` of its article
    (null where the article is unknown) and entities as JSON."""
    rows = extractions.withColumns({"ticker": F.explode_outer("tickers"), "key_entities": F.to_json("key_entities")}).drop("tickers")
    rows = rows.join(articles.select("article_id", *keep), "article_id", "left")
    doubles = ("sentiment_score", "confidence", "market_relevance")
    return rows.withColumns({c: F.col(c).cast("double") for c in doubles})


def relevant(rows: DataFrame, least: float, score: str = "market_relevance") -> DataFrame:
    """Rows of at least this relevance; a null score has none."""
    return rows.where(F.coalesce(F.col(score), F.lit(0.0)) >= least)


def daily(rows: DataFrame, social: tuple[str, ...] = ("reddit", "stocktwits"), breaking: float = 0.8) -> DataFrame:
    """Article rows (ticker, date, sentiment_score, sentiment_label, confidence, market_relevance, source_type, impact_horizon) by ticker
    and day: counts, means, the bullish share, the social part, and whether any is relevant at short horizon."""
    from_social = F.col("source_type").isin(*social)
    urgent = (F.col("market_relevance") > breaking) & (F.col("impact_horizon") == "short")
    return rows.groupBy("ticker", "date").agg(
        F.count("*").alias("enriched_article_count"),
        *[F.avg(c).alias(f"enriched_{n}_mean") for c, n in (("sentiment_score", "sentiment"), ("confidence", "confidence"), ("market_relevance", "relevance"))],
        (F.count_if(F.col("sentiment_label") == "bullish") / F.count("*")).alias("bullish_ratio"),
        F.count_if(from_social).alias("social_volume"),
        F.avg(F.when(from_social, F.col("sentiment_score"))).alias("social_sentiment_mean"),
        F.coalesce(F.bool_or(urgent), F.lit(False)).cast("int").alias("breaking_news_flag"),
    )
