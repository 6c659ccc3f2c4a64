"""Trading sessions as a table, and what follows from joins with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Time zones of the markets' exchanges.
ZONES = {"us": "America/New_York", "cn": "Asia/Shanghai", "hk": "Asia/Hong_Kong", "jp": "Asia/Tokyo", "kr": "Asia/Seoul"}


def sessions(markets: DataFrame, first: Column, last: Column, holidays: DataFrame) -> DataFrame:
    """(market, date, is_session) of every day of ``markets`` (market and the columns that the bounds use): weekdays that are
    not among ``holidays`` (market, date). A table of days, so it is small beside any bars."""
    days = markets.select("market", F.explode(F.sequence(first, last)).alias("date"))
    off = holidays.select("market", "date", F.lit(True).alias("_off")).distinct()
    is_session = (F.weekday("date") < 5) & F.col("_off").isNull()
    return days.join(off, ["market", "date"], "left").select("market", "date", is_session.alias("is_session"))


def between(calendar: DataFrame, first: str, last: str) -> DataFrame:
    """(market, sessions): sessions from ``first`` to ``last``, both included."""
    inside = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return calendar.groupBy("market").agg(F.count_if(inside & F.col("is_session")).alias("sessions"))


def last_session(calendar: DataFrame, as_of: str) -> DataFrame:
    """(market, last_session) on or before a day; null where there is none."""
    known = F.col("is_session") & (F.col("date") <= F.lit(as_of).cast("date"))
    return calendar.groupBy("market").agg(F.max(F.when(known, F.col("date"))).alias("last_session"))


def session_age(bars: DataFrame, calendar: DataFrame, as_of: str) -> DataFrame:
    """(market, latest_date, last_session, sessions_behind): sessions after a market's latest bar up to a day; all of the
    calendar's where it has no bars."""
    latest = bars.groupBy("market").agg(F.max("date").alias("latest_date"))
    days = calendar.where(F.col("date") <= F.lit(as_of).cast("date")).join(F.broadcast(latest), "market", "left")  # a row a market
    later = F.col("is_session") & (F.col("latest_date").isNull() | (F.col("date") > F.col("latest_date")))
    return days.groupBy("market", "latest_date").agg(
        F.max(F.when(F.col("is_session"), F.col("date"))).alias("last_session"), F.count_if(later).alias("sessions_behind")
    )


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(market, ticker, date): sessions without a bar, over one range for all tickers of a market. Sessions reach a ticker as one
    array of its market, so no join has more rows than the answer and the bars."""
    open_days = calendar.where("is_session").groupBy("market").agg(F.collect_list("date").alias("_days"))
    seen = bars.groupBy("market", "ticker").agg(F.collect_set("date").alias("_seen"))
    gaps = seen.join(F.broadcast(open_days), "market").withColumn("date", F.explode(F.array_except("_days", "_seen")))
    return gaps.select("market", "ticker", "date")


def market_today(instant: Column, market: Column) -> Column:
    """The date that an instant (UTC, without a zone) has at a market's exchange; UTC for unknown ones."""
    zone = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    return F.convert_timezone(F.lit("UTC"), F.coalesce(F.try_element_at(zone, market), F.lit("UTC")), instant).cast("date")


def next_session(calendar: DataFrame) -> DataFrame:
    """Each day with the first session after it."""
    ahead = Window.partitionBy("market").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("is_session"), F.col("date")), ignorenulls=True).over(ahead)
    return calendar.withColumn("next_session", following)
