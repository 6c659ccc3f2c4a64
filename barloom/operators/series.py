"""Joins and fills along time: as-of, gaps, islands, coverage, pivot with forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before its time.

    One shuffle: both sides in one series, right rows first at equal times; a struct keeps a right row's values together.
    """
    payload = F.struct(*values)
    kinds = right.select(payload.alias("p")).schema["p"].dataType
    a = left.select(by, on, F.lit(1).alias("side"), F.struct("*").alias("row"), F.lit(None).cast(kinds).alias("p"))
    b = right.select(by, on, F.lit(0).alias("side"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), payload.alias("p"))
    w = Window.partitionBy(by).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("p", F.last("p", ignorenulls=True).over(w)).where("side = 1")
    return seen.select("row.*", *[F.col(f"p.{v}").alias(v) for v in values])


def weekdays(first, last) -> F.Column:
    """Array of the weekdays between two dates."""
    return F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)


def missing_dates(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Weekdays between a key's first and last date on which it has no row. A series is as long as a key has days: the
    gap after each row comes from its successor, without a calendar join."""
    after = F.lead("date").over(Window.partitionBy(key).orderBy("date"))
    steps = bars.select(key, "date").distinct().withColumn("after", after).where("datediff(after, date) > 1")
    return steps.select(key, F.explode(weekdays(F.date_add("date", 1), F.date_sub("after", 1))).alias("missing_date"))


def missing_ranges(missing: DataFrame, key: str = "ticker") -> DataFrame:
    """Runs of missing weekdays, weekends bridged, with a severity by length."""
    prev = F.lag("missing_date").over(Window.partitionBy(key).orderBy("missing_date"))
    step = F.size(weekdays(F.col("prev"), F.col("missing_date")))
    new = F.when(F.col("prev").isNull() | (step > 2), 1).otherwise(0)
    run = F.sum(new).over(Window.partitionBy(key).orderBy("missing_date").rowsBetween(Window.unboundedPreceding, 0))
    runs = missing.withColumn("prev", prev).withColumn("run", run).groupBy(key, "run")
    n = F.col("n_days")
    return (
        runs.agg(F.min("missing_date").alias("start_date"), F.max("missing_date").alias("end_date"), F.count("*").alias("n_days"))
        .drop("run")
        .withColumn("severity", F.when(n <= 5, "low").when(n <= 20, "medium").otherwise("high"))
    )


def coverage(bars: DataFrame, key: str = "ticker") -> DataFrame:
    found = bars.groupBy(key).agg(
        F.min("date").alias("a"), F.max("date").alias("b"),
        F.count_distinct(F.when(F.weekday("date") < 5, F.col("date"))).alias("actual"),
    )
    expected = F.size(weekdays(F.col("a"), F.col("b"))).cast("long")
    return found.select(
        key,
        expected.alias("expected"),
        "actual",
        (expected - F.col("actual")).alias("missing"),
        F.round(F.try_divide(F.col("actual") * 100.0, expected), 2).alias("coverage_pct"),
    )


def pivot_fill(long: DataFrame, dates: DataFrame, names: list[str]) -> DataFrame:
    """Wide values on ``dates``, each filled forward from the last date that has one, else 0. Rows are dates."""
    wide = long.groupBy("date").pivot("indicator", names).agg(F.first("value"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a date, whatever the tickers
    joined = dates.join(wide, "date", "left")
    return joined.select("date", *[F.coalesce(F.last(n, ignorenulls=True).over(w), F.lit(0.0)).alias(n) for n in names])


def freshness(bars: DataFrame, markets: DataFrame, as_of: str) -> DataFrame:
    """Every market's latest date, days and age; markets without bars stay, with nulls."""
    seen = bars.groupBy("market").agg(F.max("date").alias("latest_date"), F.countDistinct("date").alias("n_dates"))
    age = F.datediff(F.lit(as_of).cast("date"), "latest_date")
    return (
        markets.select("market").distinct().join(seen, "market", "left")
        .select("market", "latest_date", F.coalesce("n_dates", F.lit(0)).alias("n_dates"), age.alias("age_days"))
        .withColumn("status", F.when(F.col("age_days") <= 7, "ok").when(F.col("age_days").isNull(), "missing").otherwise("stale"))
    )


def macro_derived(long: DataFrame, dates: DataFrame, names: list[str]) -> DataFrame:
    """Macro values on ``dates``, filled forward, with five-row changes and the slope of yields; unknown ones are 0. Values of
    other dates are left out before filling. Rows are dates."""
    wide = long.groupBy("date").pivot("indicator", names).agg(F.first("value"))
    by = Window.orderBy("date")  # one row a date, whatever the tickers
    full = dates.join(wide, "date", "left")
    full = full.select("date", *[F.last(n, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names])
    derived = {f"{n}_change_5d": F.col(n) - F.lag(n, 5).over(by) for n in ("vix", "dxy") if n in names}
    if {"treasury_10y", "tips_yield"} <= set(names):
        derived["yield_curve_slope"] = F.col("treasury_10y") - F.col("tips_yield")
    return full.withColumns(derived).fillna(0.0)


def slices(frame: DataFrame, wanted: dict[str, tuple[int, int | None]], key: str = "ticker", on: str = "date") -> DataFrame:
    """Rows of each series by their place in it, with the name of the first slice that they are in; places count from 0, or from the end where
    they are negative, and the second one of a slice is outside of it."""
    w = Window.partitionBy(key)
    rows = frame.withColumns({"_i": F.row_number().over(w.orderBy(on)) - 1, "_n": F.count("*").over(w)})
    at = lambda x: F.lit(x) if x >= 0 else F.col("_n") + x
    inside = lambda a, b: (F.col("_i") >= at(a)) & (F.lit(True) if b is None else F.col("_i") < at(b))
    place = F.coalesce(*[F.when(inside(a, b), name) for name, (a, b) in wanted.items()])
    return rows.withColumn("place", place).where("place is not null").drop("_i", "_n")
