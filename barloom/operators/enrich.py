"""Enrichment of bars with news, social, ratings, filings and macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.ewm import decayed
from barloom.functions.graph import Step
from barloom.operators import articles
from barloom.operators.series import asof, macro_derived

KEYS = ["ticker", "date"]


def daily_news(news: DataFrame) -> DataFrame:
    """News (ticker, date, sentiment_score, sentiment_label) summed up by day."""
    is_ = lambda label: F.count_if(F.col("sentiment_label") == label)
    return news.groupBy(*KEYS).agg(
        F.avg("sentiment_score").alias("avg_daily_sentiment"),
        F.count("*").alias("news_count"),
        is_("positive").alias("positive_count"),
        is_("negative").alias("negative_count"),
        is_("neutral").alias("neutral_count"),
        F.stddev_samp("sentiment_score").alias("sentiment_std"),
    )


def _joined(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars with a day's values, zeros where there are none."""
    return bars.join(daily, KEYS, "left").na.fill(0, [c for c in daily.columns if c not in KEYS])


def news_means(joined: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """The decayed means of the day's sentiment (``seeds``: see ``ewm.means``)."""
    return decayed(joined, "avg_daily_sentiment", prefix="sentiment", seeds=seeds)


def with_news(bars: DataFrame, news: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Bars with the day's news, zeros where there is none, and the sentiment's decayed means (``seeds``: see ``ewm.means``)."""
    return news_means(_joined(bars, daily_news(news)), seeds)


def daily_social(posts: DataFrame) -> DataFrame:
    """Posts (ticker, date, source, mention_count, score, positive_score, negative_score) summed up by day."""
    of = lambda s: F.sum(F.when(F.col("source") == s, F.col("mention_count")).otherwise(0))
    return posts.groupBy(*KEYS).agg(
        F.sum("mention_count").alias("mentions"), F.avg("score").alias("social_score"),
        F.avg("positive_score").alias("social_positive"), F.avg("negative_score").alias("social_negative"),
        of("reddit").alias("reddit_mentions"), of("twitter").alias("twitter_mentions"),
    )


def social_means(joined: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Five-row momentum and change of the day's posts, 0 where unknown, and the score's decayed means."""
    w = Window.partitionBy("ticker").orderBy("date")
    before = F.lag("mentions", 5).over(w)
    joined = joined.withColumns(
        {
            "mention_momentum": F.coalesce(F.try_divide(F.col("mentions"), before) - 1, F.lit(0.0)),
            "social_score_change": F.coalesce(F.col("social_score") - F.lag("social_score", 5).over(w), F.lit(0.0)),
        }
    )
    return decayed(joined, "social_score", prefix="social", seeds=seeds)


def with_social(bars: DataFrame, posts: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Bars with the day's posts, zeros where there are none, and what follows from them (see ``social_means``)."""
    return social_means(_joined(bars, daily_social(posts)), seeds)


def with_ratings(bars: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings (ticker, date, consensus_score, price_target_mean, coverage_count), one row a day, with the consensus' decayed mean
    over days with ratings and the target's upside; zeros where there are none."""
    upside = (F.col("price_target_mean") - F.col("close")) / F.greatest("close", F.lit(1e-8))
    known = decayed(ratings, "consensus_score", (7,), prefix="consensus")
    joined = bars.join(known, KEYS, "left").withColumn("target_upside", upside)
    return joined.na.fill(0, ["consensus_score", "consensus_ewma_7d", "price_target_mean", "coverage_count", "target_upside"])


def with_articles(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """Article rows by day (see ``articles.daily``) onto bars, with the sentiment's decayed means over the days that have articles, made
    before the join; zeros on days without any."""
    known = decayed(articles.daily(rows.where("ticker is not null")), "enriched_sentiment_mean", (3, 7), prefix="enriched_sentiment")
    return bars.join(known, KEYS, "left").na.fill(0, [c for c in known.columns if c not in KEYS])


def with_filings(bars: DataFrame, filings: DataFrame) -> DataFrame:
    """The last filing date at or before each bar (filings: ticker, filing_date, risk, tone, guidance, novelty): mean risk and tone,
    whether any guidance is positive, whether any risk is new or modified; zeros before the first."""
    changed = F.col("novelty").isin("new", "modified")
    daily = filings.groupBy("ticker", F.col("filing_date").alias("date")).agg(
        F.avg("risk").alias("filing_risk"), F.avg("tone").alias("filing_tone"),
        F.max(F.when(F.col("guidance") == "positive", 1).otherwise(0)).alias("guidance_positive"),
        F.max(F.when(changed, 1).otherwise(0)).alias("risk_change_flag"),
    )
    daily = daily.withColumn("filing_date", F.col("date"))
    values = ["filing_risk", "filing_tone", "guidance_positive", "risk_change_flag"]
    return asof(bars, daily, "ticker", "date", ["filing_date", *values]).na.fill(0, values)


def cross_modal(frame: DataFrame) -> DataFrame:
    """Sentiment by volume, its five-row change, and the gap of news and social sentiment."""
    w = Window.partitionBy("ticker").orderBy("date")
    s = F.col("avg_daily_sentiment")
    return frame.withColumns(
        {
            "sentiment_volume": s * F.log1p(F.greatest("volume", F.lit(0.0))),
            "sentiment_momentum": s - F.lag(s, 5).over(w),
            "news_social_gap": s - F.col("social_score"),
        }
    )


def steps(
    news: DataFrame | None = None, posts: DataFrame | None = None, ratings: DataFrame | None = None, filings: DataFrame | None = None,
    articles_: DataFrame | None = None, macro: DataFrame | None = None, seeds: DataFrame | None = None,
) -> list[Step]:
    """The enrichments as steps of a feature graph. A table that is missing leaves its columns, as zeros: no row differs in shape by what
    was there to read. Those tagged ``daily`` join values by day and need nothing of other steps, so that they can go first, while rows are narrow."""
    lives = lambda name, days=(3, 7, 30): tuple(f"{name}_ewma_{h}d" for h in days)
    counts = ("news_count", "positive_count", "negative_count", "neutral_count")
    given = {
        "news": (news, ("avg_daily_sentiment", *counts, "sentiment_std"), lambda f: _joined(f, daily_news(news))),
        "news_means": (news, lives("sentiment"), lambda f: news_means(f, seeds)),
        "social": (
            posts, ("mentions", "social_score", "social_positive", "social_negative", "reddit_mentions", "twitter_mentions"),
            lambda f: _joined(f, daily_social(posts)),
        ),
        "social_means": (posts, ("mention_momentum", "social_score_change", *lives("social")), lambda f: social_means(f, seeds)),
        "ratings": (
            ratings, ("consensus_score", "price_target_mean", "coverage_count", "consensus_ewma_7d", "target_upside"), lambda f: with_ratings(f, ratings)
        ),
        "filings": (filings, ("filing_risk", "filing_tone", "guidance_positive", "risk_change_flag"), lambda f: with_filings(f, filings).drop("filing_date")),
        "articles": (
            articles_,
            ("enriched_article_count", "enriched_sentiment_mean", "enriched_confidence_mean", "enriched_relevance_mean", "bullish_ratio", "social_volume",
             "social_sentiment_mean", "breaking_news_flag", *lives("enriched_sentiment", (3, 7))),
            lambda f: with_articles(f, articles_),
        ),
        "macro": (macro, MACRO_COLUMNS, lambda f: with_macro(f, macro)),
    }
    whole = {*counts, "mentions", "reddit_mentions", "twitter_mentions", "coverage_count", "guidance_positive", "risk_change_flag", "enriched_article_count",
             "social_volume", "breaking_news_flag"}
    zero = lambda columns: {c: F.lit(0).cast("long") if c in whole else F.lit(0.0) for c in columns}
    absent = lambda columns: lambda f: f.withColumns(zero(columns))
    typed = lambda run, columns: lambda f: run(f).withColumns({c: F.col(c).cast("long" if c in whole else "double") for c in columns})
    needs = {"news_means": ("avg_daily_sentiment",), "social_means": ("mentions", "social_score")}
    tags = lambda name: {"enrichment", name.removesuffix("_means")} | ({"daily"} if name in ("news", "social", "ratings", "articles") else set())
    made = [
        Step(
            name, ("ticker", "date", *needs.get(name, ("close",))), columns, typed(run, columns) if table is not None else absent(columns), frozenset(tags(name))
        )
        for name, (table, columns, run) in given.items()
    ]
    cross = ("sentiment_volume", "sentiment_momentum", "news_social_gap")
    return [*made, Step("cross_modal", ("volume", "avg_daily_sentiment", "social_score"), cross, cross_modal, frozenset({"enrichment"}))]


#: The eight series of the macro table.
MACRO = ("dxy", "treasury_10y", "tips_yield", "breakeven_inflation", "vix", "gld", "iau", "policy_uncertainty")
MACRO_COLUMNS = (*MACRO, "vix_change_5d", "dxy_change_5d", "yield_curve_slope")


def with_macro(bars: DataFrame, macro: DataFrame, names: tuple[str, ...] = MACRO) -> DataFrame:
    """Macro series (date, indicator, value) on the bars' dates, filled forward, with their changes and slope; the date table is small
    beside the bars."""
    return bars.join(macro_derived(macro, bars.select("date").distinct(), list(names)), "date", "left")
