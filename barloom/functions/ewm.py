"""Exponentially weighted means without a worker process, in one pass for any number of them.

A mean is a recursion ``y = keep * y + ...``, so what a stretch of rows does to it is one affine map. A series is cut into
stretches of days; sums over a stretch give its map, the maps of the stretches before a row (a few numbers a stretch)
are composed in order into the state that its stretch began with. All are windows of the series, so rows that lie together by key are not
shuffled again, and the frame is read once. A row a key and day; keys are not null; nulls do not age a mean, which stays what it was.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.graph import Graph, Step, family
from barloom.functions.indicators import by_ticker, in_time

STRETCH_DAYS = 512
#: Decimal places that weights may grow over within a stretch.
_PLACES = 250


class Mean(NamedTuple):
    """``keep``: what a row's weight becomes with each further one. ``adjust``: weights are divided by their sum; otherwise the
    first value starts the mean. Null before ``least`` values."""

    name: str
    column: str
    keep: float
    adjust: bool = True
    least: int = 1


def by_span(name: str, column: str, span: int, adjust: bool = True) -> Mean:
    return Mean(name, column, 1 - 2 / (span + 1), adjust)


def by_half_life(name: str, column: str, life: float) -> Mean:
    return Mean(name, column, 0.5 ** (1 / life))


def means(frame: DataFrame, wanted: list[Mean], key: str = "ticker", on: str = "date", seeds: DataFrame | None = None) -> DataFrame:
    """``frame`` with all of ``wanted``.

    ``seeds``: (``key``, and of each mean its value ``<name>`` and the number of values ``<name>__n`` in it) of series that go on from rows
    which are not in ``frame``; a series without a seed begins here."""
    days = min(STRETCH_DAYS, *(int(_PLACES / -math.log10(m.keep)) for m in wanted))
    columns = list(dict.fromkeys(m.column for m in wanted))
    at = {c: n for n, c in enumerate(columns)}
    stretch = Window.partitionBy(key, "_stretch")
    order = in_time(frame, on)
    so_far = stretch.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = frame.withColumn("_stretch", F.floor(F.datediff(on, F.lit("1970-01-01").cast("date")) / days))
    rows = rows.withColumns({f"_k{n}": F.count(c).over(so_far) for c, n in at.items()})
    share = lambda m: 1.0 if m.adjust else 1 - m.keep
    rows = rows.withColumns(
        {f"_g{i}": F.col(m.column).cast("double") * share(m) * F.pow(F.lit(m.keep), -F.col(f"_k{at[m.column]}")) for i, m in enumerate(wanted)}
    )
    rows = rows.withColumns({f"_s{i}": F.coalesce(F.sum(f"_g{i}").over(so_far), F.lit(0.0)) for i in range(len(wanted))})
    shrunk = lambda m, x: F.pow(F.lit(m.keep), F.col(f"_k{at[m.column]}")) * x

    # the whole stretch's map, on its first row; then each row sees the maps of the stretches before its own
    whole = stretch.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.count(c).over(whole).alias(f"k{n}") for c, n in at.items()]
    ends += [
        (F.pow(F.lit(m.keep), F.count(m.column).over(whole)) * F.coalesce(F.sum(f"_g{i}").over(whole), F.lit(0.0))).alias(f"s{i}")
        for i, m in enumerate(wanted)
    ]
    rows = rows.withColumn("_map", F.when(F.row_number().over(stretch.orderBy(*order)) == 1, F.struct(*ends)))
    rows = rows.drop(*[f"_g{i}" for i in range(len(wanted))])
    before = Window.partitionBy(key).orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(key).orderBy("_stretch", *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {"_maps": F.collect_list("_map").over(before)} | {f"_f{n}": F.first(F.col(c).cast("double"), ignorenulls=True).over(first) for c, n in at.items()}
    )

    if seeds is not None:
        sown = seeds.select(key, *[F.struct(F.col(m.name).alias("y"), F.col(f"{m.name}__n").alias("n")).alias(f"_seed{i}") for i, m in enumerate(wanted)])
        rows = rows.join(sown, key, "left")

    def seed(i: int, m: Mean) -> Column:
        """What the seed adds up to, and how many values it has; nothing and none without one."""
        if seeds is None:
            return F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).cast("long").alias("n"))
        y, n = F.col(f"_seed{i}.y"), F.coalesce(F.col(f"_seed{i}.n").cast("long"), F.lit(0).cast("long"))
        return F.struct((y * (1 - F.pow(F.lit(m.keep), n)) / (1 - m.keep) if m.adjust else y).alias("y"), n.alias("n"))

    def state(i: int, m: Mean) -> Column:
        start = F.coalesce(seed(i, m)["y"], F.lit(0.0) if m.adjust else F.col(f"_f{at[m.column]}"))
        return F.aggregate("_maps", start, lambda y, x: F.pow(F.lit(m.keep), x[f"k{at[m.column]}"]) * y + x[f"s{i}"])

    known = lambda i, m: F.aggregate("_maps", seed(i, m)["n"], lambda a, x: a + x[f"k{at[m.column]}"])
    # composed on a stretch's first row only; the others take it from there
    begun = {f"_y{i}": state(i, m) for i, m in enumerate(wanted)} | {f"_n{i}": known(i, m) for i, m in enumerate(wanted)}
    rows = rows.withColumns({n: F.when(F.col("_map").isNotNull(), x) for n, x in begun.items()}).drop("_map", "_maps")
    rows = rows.withColumns({n: F.first(n, ignorenulls=True).over(so_far) for n in begun})

    def value(i: int, m: Mean) -> Column:
        count = F.col(f"_k{at[m.column]}") + F.col(f"_n{i}")
        start = F.col(f"_y{i}") if m.adjust else F.coalesce(f"_y{i}", f"_f{at[m.column]}")  # none before the stretch: its own first value
        y = shrunk(m, start + F.col(f"_s{i}"))
        y = F.try_divide(y * (1 - m.keep), 1 - F.pow(F.lit(m.keep), count)) if m.adjust else y
        return F.when(count >= m.least, F.when(count == 1, F.col(f"_f{at[m.column]}")).otherwise(y))

    return rows.select(*[F.col(f"`{c}`") for c in frame.columns], *[value(i, m).alias(m.name) for i, m in enumerate(wanted)])


#: Marks rows that are there for what stands behind them only: they carry a seed and age no mean.
SEED = "_seed"
STATES = ("gain_mean", "loss_mean", "ema_fast", "ema_slow")


def unseeded(frame: DataFrame, column: str) -> Column:
    """A column without its value in seed rows."""
    return F.when(~F.col(SEED), F.col(column)) if SEED in frame.columns else F.col(column)


def momentum_states(bars: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """rsi_14 (Wilder's means; null where the mean loss is 0), macd, macd_signal, macd_histogram, and the means behind them."""
    delta = F.col("close") - F.lag("close").over(by_ticker(bars))
    rows = bars.withColumn("_d", delta)
    known = F.col("_d").isNotNull()
    rows = rows.withColumns(
        {
            "_gain": F.when(known, F.greatest("_d", F.lit(0.0))),
            "_loss": F.when(known, -F.least("_d", F.lit(0.0))),
            "_close": unseeded(bars, "close"),
        }
    )
    wilder = [Mean(n, c, 13 / 14, adjust=False, least=14) for n, c in (("gain_mean", "_gain"), ("loss_mean", "_loss"))]
    rows = means(rows, [*wilder, by_span("ema_fast", "_close", 12, False), by_span("ema_slow", "_close", 26, False)], seeds=seeds)
    rows = rows.withColumns({"rsi_14": 100 - 100 / (1 + F.try_divide("gain_mean", "loss_mean")), "macd": F.col("ema_fast") - F.col("ema_slow")})
    rows = rows.withColumn("_macd", unseeded(bars, "macd"))
    rows = means(rows, [by_span("macd_signal", "_macd", 9, False)], seeds=seeds).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return rows.select(*bars.columns, "rsi_14", "macd", "macd_signal", "macd_histogram", *STATES)


def momentum(bars: DataFrame) -> DataFrame:
    return momentum_states(bars).drop(*STATES)


def decayed(
    frame: DataFrame, column: str, lives: tuple[float, ...] = (3, 7, 30), prefix: str | None = None, seeds: DataFrame | None = None
) -> DataFrame:
    """``<prefix>_ewma_<h>d`` for each half life."""
    rows = frame.withColumn("_x", unseeded(frame, column))
    return means(rows, [by_half_life(f"{prefix or column}_ewma_{h}d", "_x", h) for h in lives], seeds=seeds).drop("_x")


def spans(frame: DataFrame, column: str, names: dict[str, int]) -> DataFrame:
    """Means weighted by spans of bars, one column for each name."""
    return means(frame, [by_span(n, column, s) for n, s in names.items()])


def indicator_graph(seeds: DataFrame | None = None) -> Graph:
    """The indicators by what they need; ``seeds`` as for ``means``."""
    from . import indicators as ind

    prices, columns = ("ticker", "date", "close"), ("ticker", "date", "open", "high", "low", "close", "volume")
    changes = {f"return_{n}d": ("close", n) for n in (1, 5, 10, 20)}
    rates = {f"roc_{n}": (n,) for n in (5, 10, 20)}
    bands = ("bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_pct")
    spread = ("atr_14", "volatility_20", "overnight_return", "intraday_return", "hl_range")
    days = ("day_of_week", "day_of_month", "month", "quarter", "days_to_month_end", "trading_day_of_month")
    rsi = {"rsi_inside": "rsi_14 is null or rsi_14 between 0 and 100"}
    tag = lambda *x: frozenset(x)
    return Graph(
        [
            Step(
                "momentum", prices, ("rsi_14", "macd", "macd_signal", "macd_histogram", *STATES), lambda f: momentum_states(f, seeds),
                tag("momentum", "means"), rsi,
            ),
            *family(lambda c, n: lambda f: ind.change(f, c, n), prices, changes, ("returns",)),
            *family(lambda n: lambda f: ind.change(f, "close", n) * 100, prices, rates, ("returns",)),
            Step("bollinger", prices, bands, ind.bollinger, tag("bands")),
            Step("ranges", columns, spread, ind.ranges, tag("ranges")),
            Step("volumes", ("ticker", "date", "close", "volume"), ("volume_ma_20", "volume_roc_5", "obv", "volume_ratio"), ind.volumes, tag("volume")),
            Step("calendar", ("ticker", "date"), days, ind.calendar, tag("calendar")),
            Step("target", prices, ("next_day_return",), ind.target, tag("target")),
        ]
    )


#: All indicators in the order of the feature table.
INDICATORS = [c for s in indicator_graph().steps for c in s.gives if c not in STATES]
VERSION = 3


def enough_rows(bars: DataFrame, least_rows: int = 60) -> DataFrame:
    """The bars of tickers that have so many."""
    size = F.count("*").over(Window.partitionBy("ticker"))
    return bars.withColumn("_n", size).where(F.col("_n") >= least_rows).drop("_n")


def features(bars: DataFrame, least_rows: int = 60, enrichments: Sequence[Step] = (), z_scores: Sequence[str] = ()) -> DataFrame:
    """All indicators of tickers with enough bars, rows without a close, volume, rsi or macd left out, then what ``enrichments`` give and
    the z-scores among the tickers of a date of the columns named."""
    from . import indicators as ind

    made = indicator_graph().run(enough_rows(bars, least_rows), INDICATORS).drop(*STATES)
    made = made.dropna(subset=["close", "volume", "rsi_14", "macd"]).withColumn("feature_schema_version", F.lit(VERSION))
    for step in Graph(enrichments).plan([c for s in enrichments for c in s.gives], made.columns):
        made = step.run(made)
    return ind.zscore(made, list(z_scores)) if z_scores else made


def feature_job(
    bars: DataFrame, start: str, end: str, tickers: DataFrame | None = None, names: list[str] | None = None, warm_up: int = 365,
    least_rows: int = 60,
) -> DataFrame:
    """``names`` (default: all) of the indicators between two dates, computed on the bars from ``warm_up`` days before, so that
    windows are full at the start. Dates and tickers are filters below the windows; only the steps that the names need are run; rows
    without a close or volume, or without one of the asked means, are left out; an unknown name is an error."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = bars.where(F.col("date").between(F.date_sub(first, warm_up), last))
    if tickers is not None:
        rows = rows.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    if names is None:
        return features(rows, least_rows).where(F.col("date") >= first)
    graph = indicator_graph()
    made = graph.run(enough_rows(rows, least_rows), names).where(F.col("date") >= first)
    return made.dropna(subset=["close", "volume", *(n for n in names if n in ("rsi_14", "macd"))]).select("ticker", "date", *names)
