"""Signals from predictions, and the watchlists they are made for."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.indicators import full
from barloom.operators import validation
from barloom.operators.lake import LakeTable
from barloom.operators.series import asof


class Generator(ABC):
    """What makes signals (ticker, date, signal_type, action, confidence, ...) from bars; a subclass names its kind and makes the rest."""

    kind: str = ""

    @abstractmethod
    def make(self, bars: DataFrame) -> DataFrame:
        """(ticker, date, action, confidence, and what else the signal carries)."""

    def signals(self, bars: DataFrame) -> DataFrame:
        if not self.kind:
            raise ValueError(f"{type(self).__name__} names no kind")
        made = self.make(bars)
        missing = {"ticker", "date", "action", "confidence"} - set(made.columns)
        if missing:
            raise ValueError(f"{self.kind} signals lack {sorted(missing)}")
        return made.withColumn("signal_type", F.lit(self.kind))


class DirectionGenerator(Generator):
    """Signals of predictions (ticker, date, probability); see ``direction_signals``."""

    kind = "ml_direction"

    def __init__(self, predictions: DataFrame, **thresholds: float):
        self.predictions, self.thresholds = predictions, thresholds

    def make(self, bars: DataFrame) -> DataFrame:
        return direction_signals(self.predictions.join(bars.select("ticker", "date"), ["ticker", "date"], "left_semi"), **self.thresholds)


class DistanceGenerator(Generator):
    """Signals by the distance from a mean of ``n`` bars, in shares of it."""

    kind = "sma_distance"

    def __init__(self, n: int = 20, least: float = 0.02):
        self.n, self.least = n, least

    def make(self, bars: DataFrame) -> DataFrame:
        mean = full(bars, F.avg, "close", self.n)
        away = bars.withColumn("distance", F.try_divide(F.col("close") - mean, mean)).where(F.abs("distance") >= self.least)
        up = F.col("distance") > 0
        return away.select("ticker", "date", F.when(up, "BUY").otherwise("SELL").alias("action"), F.when(up, 70.0).otherwise(60.0).alias("confidence"), "distance")


def scan(bars: DataFrame, generators: Sequence[Generator]) -> DataFrame:
    """The most confident signal of each ticker and date among all generators; see ``scan_signals``."""
    return scan_signals(*[g.signals(bars).select("ticker", "date", "signal_type", "action", "confidence") for g in generators])


def direction_signals(
    predictions: DataFrame, buy: float = 0.6, sell: float = 0.4, least_confidence: float = 60.0
) -> DataFrame:
    """(ticker, date, action, confidence) of predictions (ticker, date, probability) beyond their threshold."""
    p = F.col("probability")
    action = F.when(p >= 0.5, "BUY").otherwise("SELL")
    confidence = F.when(p >= 0.5, p * 100).otherwise((1 - p) * 100)
    made = predictions.select("ticker", "date", "probability", action.alias("action"), confidence.alias("confidence"))
    beyond = F.when(F.col("action") == "BUY", p >= buy).otherwise(p <= sell)
    return made.where(beyond & (F.col("confidence") >= least_confidence))


def accepted_candidates(candidates: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Candidates (ticker, date, candidate_action, execution_probability) that the meta label lets through."""
    return candidates.where(F.col("execution_probability") >= threshold).select(
        "ticker", "date", F.col("candidate_action").alias("action"), (F.col("execution_probability") * 100).alias("confidence")
    )


def scan_signals(*signals: DataFrame) -> DataFrame:
    """All generators' signals, most confident of each ticker and date; equal ones by generator and action."""
    out = signals[0]
    for s in signals[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    best = F.max_by(F.struct("signal_type", "action", "confidence"), F.struct("confidence", "signal_type", "action"))
    return out.groupBy("ticker", "date").agg(best.alias("s")).select("ticker", "date", "s.*")


def unknown_tickers(watchlist: DataFrame, known: DataFrame) -> DataFrame:
    """Listed tickers without any bar."""
    return watchlist.select("ticker").distinct().join(known.select("ticker").distinct(), "ticker", "left_anti")


def model_as_of(dates: DataFrame, models: DataFrame, on: str = "date") -> DataFrame:
    """Each date with the columns of the model (trained_on, ...) trained last on or before it; null before the first. An as-of join on one
    series; there is a row a date and a row a model."""
    left = dates.withColumn("_all", F.lit(0))
    right = models.withColumns({"_all": F.lit(0), on: F.col("trained_on")})
    return asof(left, right, "_all", on, models.columns).drop("_all")


def store(table: LakeTable, made: DataFrame) -> int:
    """Merges predictions (ticker, date, probability, direction) into their table; an error, and no write, where any breaks a
    rule or a key repeats."""
    return table.upsert(validation.require(made, validation.PREDICTION_RULES, table.keys))
