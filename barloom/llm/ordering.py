"""Places in a global order without a global task: range partitions, each sorted, and the rows before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

_ROW_BITS = 33  # of Spark's increasing ids: the row's place in its partition


def sorted_parts(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows``, written in ``order``, with their range partition ``part`` and their place ``pos`` in it, from 0.

    ``rows`` are read twice, once for the ranges: write what is dear to compute before. Rows equal in ``order`` lie in one
    part, so ``order`` names enough columns to tell a hot key's rows apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", mid)
    part = F.shiftright("_mid", _ROW_BITS).cast("int")
    pos = F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    return store.materialize(placed.withColumns({"part": part, "pos": pos}).drop("_mid"), name)


def part_starts(placed: DataFrame) -> DataFrame:
    """(part, start): rows in the parts before; as many rows as there are partitions, so they may be broadcast."""
    counts = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect())
    rows, at = [], 0
    for part, n in counts:
        rows.append((part, at))
        at += n
    return F.broadcast(placed.sparkSession.createDataFrame(rows, "part int, start long"))
