"""Selections from a table of tickers (symbol, market, exchange, sector, tags, active, priority), and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(column: str, value: str) -> Column:
    return F.lower(F.trim(F.col(column))) == value.strip().lower()


def _wanted(tags: list[str]) -> list[str]:
    return sorted({t.strip().lower() for t in tags})


def tags_of(listed: Column, sign: str = "|") -> Column:
    """The parts of tags such as ``kind|name``: split, trimmed, empty ones left out, each once, in order."""
    parts = F.flatten(F.transform(listed, lambda t: F.split(t, f"\\Q{sign}\\E")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def select(
    universe: DataFrame, *, tags_any: list[str] | None = None, tags_all: list[str] | None = None, sector: str | None = None,
    exchange: str | None = None, market: str | None = None, least_priority: int | None = None, members: DataFrame | None = None, active_only: bool = True,
) -> DataFrame:
    """Rows that meet every given condition, most important first, then by symbol. Names and tags are compared without case or the blanks around them.
    ``members``: (market, symbol) of a group; a null market stands for any. An empty list of tags asks for nothing: any of none is
    no row, all of none every row."""
    own = F.transform("tags", lambda t: F.lower(F.trim(t)))
    rows = universe
    if active_only:
        rows = rows.where("active")
    if tags_any is not None:
        rows = rows.where(F.arrays_overlap(own, F.array(*map(F.lit, _wanted(tags_any))).cast("array<string>")))
    if tags_all is not None:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, _wanted(tags_all))).cast("array<string>"), own)) == 0)
    for column, value in (("sector", sector), ("exchange", exchange), ("market", market)):
        if value is not None:
            rows = rows.where(_same(column, value))
    if least_priority is not None:
        rows = rows.where(F.col("priority") >= least_priority)
    if members is not None:
        of = members.select(F.col("market").alias("_m"), F.col("symbol").alias("_s")).distinct()
        rows = rows.join(of, (F.col("symbol") == F.col("_s")) & (F.col("_m").isNull() | (F.col("market") == F.col("_m"))), "left_semi")
    return rows.orderBy(F.desc("priority"), "symbol")


def tag_index(universe: DataFrame) -> DataFrame:
    """(tag, market, symbol), each once: written by tag, a lookup reads the asked tags' rows and no arrays."""
    return universe.select(F.explode(F.transform("tags", lambda t: F.lower(F.trim(t)))).alias("tag"), "market", "symbol").distinct()


def by_index(index: DataFrame, tags: list[str], match_all: bool = False) -> DataFrame:
    """(market, symbol) with any, or all, of the tags."""
    wanted = _wanted(tags)
    hits = index.where(F.col("tag").isin(wanted)).groupBy("market", "symbol").agg(F.count("*").alias("_n"))
    return hits.where(F.col("_n") >= (len(wanted) if match_all else 1)).select("market", "symbol")


def statistics(universe: DataFrame) -> DataFrame:
    """(market, total, active, inactive, exchanges, sectors): a row a market, names in order."""
    return universe.groupBy("market").agg(
        F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"),
        F.array_sort(F.collect_set("exchange")).alias("exchanges"), F.array_sort(F.collect_set("sector")).alias("sectors"),
    )


def batches(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """``rows`` with ``batch``, each ``size`` rows of a full order one number within ``by[0]``; a large table is batched in as many pieces as
    its first column has values, so that no task numbers them all."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(by[0]).orderBy(*by[1:])
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
