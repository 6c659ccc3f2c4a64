"""Rules, profiles and drift: every check over all rows, one aggregate for all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICE_RULES: dict[str, str] = {
    "open_positive": "open > 0",
    "high_positive": "high > 0",
    "low_positive": "low > 0",
    "close_positive": "close > 0",
    "volume_not_negative": "volume >= 0",
    "high_is_highest": "high >= greatest(open, close, low)",
    "low_is_lowest": "low <= least(open, close)",
}
NEWS_RULES: dict[str, str] = {
    **{f"{c}_not_null": f"{c} is not null" for c in ("ticker", "date", "datetime", "source", "headline", "url")},
    "score_in_range": "sentiment_score between -1 and 1",
}
MACRO_RULES: dict[str, str] = {f"{c}_not_null": f"{c} is not null" for c in ("date", "indicator", "value", "source")}
PREDICTION_RULES: dict[str, str] = {
    "ticker_not_null": "ticker is not null",
    "date_not_null": "date is not null",
    "probability_inside": "probability > 0 and probability < 1",
    "direction_known": "direction in ('up', 'down')",
}
#: Bounds of rows at the borders of the layers.
BAR_BOUNDS: dict[str, str] = {"key_known": "ticker is not null and date is not null"} | {
    k: v for k, v in PRICE_RULES.items() if k.endswith(("_positive", "_negative"))
}
FEATURE_BOUNDS: dict[str, str] = {
    "key_known": "ticker is not null and date is not null",
    "close_known": "close is not null",
    "macd_known": "macd is not null",
    "rsi_inside": "rsi_14 between 0 and 100",
    "volume_not_negative": "volume >= 0",
}
PREDICTION_BOUNDS: dict[str, str] = {
    "key_known": "ticker is not null and date is not null",
    "direction_known": "direction in ('up', 'down')",
    "probability_inside": "probability between 0 and 1",
    "version_known": "model_version is not null",
}


class ValidationError(ValueError):
    pass


def violations(frame: DataFrame, rules: dict[str, str], unique: list[str] | None = None) -> DataFrame:
    """(rule, failed): rows that break each rule or make it null; ``unique`` counts rows that share their key."""
    fails = {n: F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()}
    one = frame.agg(*fails.values())
    if unique:
        keys = frame.groupBy(*unique).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("unique_key"))
        one = one.crossJoin(F.broadcast(keys))  # one row each
    return one.unpivot([], one.columns, "rule", "failed")


def require(frame: DataFrame, rules: dict[str, str], unique: list[str] | None = None) -> DataFrame:
    """The frame itself, or an error that names the broken rules."""
    broken = {r.rule: r.failed for r in violations(frame, rules, unique).collect() if r.failed}
    if broken:
        raise ValidationError(f"rows that fail: {broken}")
    return frame


def null_shares(frame: DataFrame) -> DataFrame:
    """(column, n_nulls, share)."""
    counts = frame.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in frame.columns])
    long = counts.unpivot(["_n"], frame.columns, "column", "present")
    nulls = F.col("_n") - F.col("present")
    return long.select("column", nulls.alias("n_nulls"), F.try_divide(nulls.cast("double"), "_n").alias("share"))


def profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, n_unique, mean, std, min, max) of numeric columns. Distinct values are exact: rows turn long,
    so they are counted as keys rather than in one expanded aggregate."""
    long = frame.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "x")
    return long.groupBy("column").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("x").isNull()).alias("nulls"),
        F.countDistinct("x").alias("n_unique"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )


def summary(frame: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(``by``, column, n, nulls, mean, std, min, max): a profile without distinct values, in one pass for all values of ``by``; each
    task sums its rows up first."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    x = lambda c: F.col(f"`{c}`").cast("double")
    one = lambda c: F.struct(F.count("*").alias("n"), F.count_if(x(c).isNull()).alias("nulls"), *[f(x(c)).alias(s) for s, f in stats.items()])
    wide = frame.groupBy(*by).agg(*[one(c).alias(c) for c in columns])
    long = wide.select(*by, F.explode(F.create_map(*[v for c in columns for v in (F.lit(c), F.col(f"`{c}`"))])).alias("column", "_s"))
    return long.select(*by, "column", "_s.*")


def quality(profiled: DataFrame) -> DataFrame:
    """A profile with the shares of values that are there and that are distinct."""
    return profiled.withColumns(
        {
            "completeness": F.try_divide(F.col("n") - F.col("nulls"), F.col("n")),
            "uniqueness": F.try_divide(F.col("n_unique"), F.col("n")),
        }
    )


def drift(current: DataFrame, baseline: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(column, statistic, baseline, current, change, drifted); baselines of 0 are skipped."""
    stats = ["mean", "std", "min", "max"]
    long = lambda p, name: p.unpivot(["column"], stats, "statistic", name).select("column", "statistic", name)
    both = long(current, "current").join(long(baseline, "baseline"), ["column", "statistic"]).where("baseline <> 0")
    change = F.abs(F.col("current") - F.col("baseline")) / F.abs("baseline")
    return both.withColumn("change", change).withColumn("drifted", F.col("change") > threshold)


def last_of(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in a full order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return frame.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row of each key, positive closes, null volumes as 0."""
    return last_of(frame, keys, order).where("close > 0").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def broken(rules: dict[str, str]) -> Column:
    """The names of the rules that a row breaks or makes null."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), n) for n, r in rules.items()]))


def within(bounds: dict[str, tuple[float, float]]) -> dict[str, str]:
    """Rules that values which are there lie in a range."""
    return {f"{c}_in_range": f"`{c}` is null or `{c}` between {low!r} and {high!r}" for c, (low, high) in bounds.items()}


def rejected(frame: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break a rule, with the names of those they break."""
    return frame.withColumn("broken", broken(rules)).where(F.size("broken") > 0)


def all_null_rows_dropped(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))


def null_quality(bars: DataFrame, markets: DataFrame, since: Column, columns: list[str]) -> DataFrame:
    """Share of nulls by market in the rows from ``since`` on; markets without rows stay."""
    seen = bars.where(F.col("date") >= since).groupBy("market").agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    )
    return markets.select("market").distinct().join(seen, "market", "left").na.fill(0)


def missing_columns(frame: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in frame.columns]


def column_status(frame: DataFrame, optional: tuple[str, ...] = (), sparse: float = 0.5) -> DataFrame:
    """(column, n_nulls, share, status): empty where all values are null, sparse above a share, unless the column may be."""
    counts = frame.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in frame.columns])
    long = counts.unpivot(["_n"], frame.columns, "column", "there")
    nulls = F.col("_n") - F.col("there")
    bad = ~F.col("column").isin(*optional) if optional else F.lit(True)
    status = F.when(bad & (nulls == F.col("_n")), "empty").when(bad & (nulls > F.col("_n") * sparse), "sparse").otherwise("ok")
    return long.select("column", nulls.alias("n_nulls"), F.try_divide(nulls, F.col("_n")).alias("share"), status.alias("status"))


def article_metrics(frame: DataFrame, text: str, key: str) -> DataFrame:
    """One row: articles, missing texts, repeated keys, date range and label counts."""
    label = F.col("sentiment_label")
    return frame.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(text).isNull() | (F.trim(F.col(text)) == "")).alias("missing_text"),
        (F.count(key) - F.countDistinct(key)).alias("duplicate_types"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(label == "positive").alias("positive"),
        F.count_if(label == "negative").alias("negative"),
    )
