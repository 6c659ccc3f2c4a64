"""The history of signals: kept by ticker, date and kind, with whatever else a signal carries as one variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.lake import LakeTable

BASE = ("ticker", "date", "signal_type", "action", "confidence", "reasoning")
KEYS = ("ticker", "date", "signal_type")


def table(spark: SparkSession, path: str) -> LakeTable:
    """By month, so that a day's signals rewrite one partition."""
    return LakeTable(spark, path, [*KEYS, "month"], "month")


def packed(signals: DataFrame) -> DataFrame:
    """``BASE`` columns, those that are absent null, and all others that have a value in the variant ``metadata``."""
    rest = [c for c in signals.columns if c not in BASE]
    kinds = {"confidence": "double", "date": "date"}
    base = [(F.col(c) if c in signals.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in BASE]
    json = F.to_json(F.struct(*rest), {"ignoreNullFields": "true"}) if rest else F.lit("{}")
    return signals.select(*base, F.parse_json(json).alias("metadata"))


def save(history: LakeTable, signals: DataFrame) -> int | None:
    """Merges signals by their keys; None, and no version, where there are none. A later signal of a key replaces the earlier one whole."""
    if signals.isEmpty():
        return None
    return history.upsert(packed(signals).withColumn("month", F.date_format("date", "yyyy-MM")), order=["confidence", "action"])


def load(history: LakeTable, day: str | None = None, **metadata: str) -> DataFrame:
    """The signals of a day, or all; ``metadata`` names fields to read as columns with their types, null where a signal has none. No table,
    no rows."""
    if history.version() is None:
        return history.spark.createDataFrame([], "ticker string, date date, signal_type string, action string, confidence double, reasoning string")
    rows = history.read()
    if day is not None:
        rows = rows.where((F.col("month") == day[:7]) & (F.col("date") == F.lit(day).cast("date")))
    return rows.select(*BASE, *[F.try_variant_get("metadata", f"$.{n}", k).alias(n) for n, k in metadata.items()])
