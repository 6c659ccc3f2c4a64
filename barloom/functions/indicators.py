"""Technical indicators as window columns, all tickers in one pass.

Rolling values are null until their window is full. All windows share one partitioning and order, so Spark sorts once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def in_time(rows: DataFrame, on: str = "date") -> list[str]:
    """What a ticker's rows are ordered by: the date, and the market where ``rows`` have one, as a ticker may be traded in several."""
    return [on, "market"] if "market" in rows.columns else [on]


def by_ticker(rows: DataFrame) -> WindowSpec:
    """Each ticker's rows ``in_time``."""
    return Window.partitionBy("ticker").orderBy(*in_time(rows))


def change(rows: DataFrame, x: str | Column, n: int) -> Column:
    """x over its value ``n`` rows before, less one; null where that is 0."""
    x = F.col(x) if isinstance(x, str) else x
    return x / F.nullif(F.lag(x, n).over(by_ticker(rows)), F.lit(0.0)) - 1


def full(rows: DataFrame, agg, x: str | Column, n: int) -> Column:
    """``agg`` of the last ``n`` rows, null unless all are there and not null."""
    w = by_ticker(rows).rowsBetween(-(n - 1), 0)
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(w) >= n, agg(x).over(w))


def returns(bars: DataFrame) -> DataFrame:
    cols = {f"return_{n}d": change(bars, "close", n) for n in (1, 5, 10, 20)}
    return bars.withColumns(cols | {f"roc_{n}": change(bars, "close", n) * 100 for n in (5, 10, 20)})


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    out = bars.withColumns({"bb_middle": full(bars, F.avg, "close", n), "_sd": full(bars, F.stddev_samp, "close", n)})
    out = out.withColumns({"bb_upper": F.expr(f"bb_middle + {k} * _sd"), "bb_lower": F.expr(f"bb_middle - {k} * _sd")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns(
        {
            "bb_width": width / F.nullif("bb_middle", F.lit(0.0)),
            "bb_pct": (F.col("close") - F.col("bb_lower")) / F.nullif(width, F.lit(0.0)),
        }
    ).drop("_sd")


def ranges(bars: DataFrame, n: int = 14, vol: int = 20) -> DataFrame:
    """Average true range (simple mean), volatility a year of 252 days, overnight and intraday return, high-low range."""
    prev = F.lag("close").over(by_ticker(bars))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    out = bars.withColumns({"_tr": true_range, "_r": change(bars, "close", 1), "_prev": prev})
    return out.withColumns(
        {
            f"atr_{n}": full(bars, F.avg, "_tr", n),
            f"volatility_{vol}": full(bars, F.stddev_samp, "_r", vol) * math.sqrt(252),
            "overnight_return": (F.col("open") - F.col("_prev")) / F.nullif("_prev", F.lit(0.0)),
            "intraday_return": (F.col("close") - F.col("open")) / F.nullif("open", F.lit(0.0)),
            "hl_range": (F.col("high") - F.col("low")) / F.nullif("close", F.lit(0.0)),
        }
    ).drop("_tr", "_r", "_prev")


def volumes(bars: DataFrame, n: int = 20) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_ticker(bars))), F.lit(0.0)) * F.col("volume")
    out = bars.withColumns({f"volume_ma_{n}": full(bars, F.avg, "volume", n), "_step": step})
    return out.withColumns(
        {
            "volume_roc_5": change(bars, "volume", 5),
            "obv": F.sum("_step").over(by_ticker(bars).rowsBetween(Window.unboundedPreceding, 0)),
            "volume_ratio": F.col("volume") / F.nullif(f"volume_ma_{n}", F.lit(0.0)),
        }
    ).drop("_step")


def calendar(bars: DataFrame) -> DataFrame:
    month = Window.partitionBy("ticker", F.year("date"), F.month("date")).orderBy(*in_time(bars))
    return bars.withColumns(
        {
            "day_of_week": F.weekday("date") + 1,
            "day_of_month": F.dayofmonth("date"),
            "month": F.month("date"),
            "quarter": F.quarter("date"),
            "days_to_month_end": F.datediff(F.last_day("date"), "date"),
            "trading_day_of_month": F.row_number().over(month),
        }
    )


def target(bars: DataFrame) -> DataFrame:
    return bars.withColumn(
        "next_day_return", F.lead("close").over(by_ticker(bars)) / F.nullif("close", F.lit(0.0)) - 1
    )


def zscore(frame: DataFrame, columns: list[str], suffix: str = "_z", eps: float = 1e-8) -> DataFrame:
    """Cross-sectional z-score on each date, nulls as 0. A date's rows meet in one window: as many as tickers."""
    day = Window.partitionBy("date")
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
    return frame.withColumns(
        {f"{c}{suffix}": (x - F.avg(x).over(day)) / (F.stddev_samp(x).over(day) + eps) for c, x in filled.items()}
    )
