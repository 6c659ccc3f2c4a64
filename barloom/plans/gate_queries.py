"""Checks that ride on writes, and stored profiles, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.operators import gate, lake, profiles, validation
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources.bars import bars, table

_PLANTED = f"""{WITH}, u AS (SELECT ticker, date, CASE WHEN volume = 10 THEN -1 ELSE open END AS open, high, CASE WHEN volume = 20 THEN high + 1 ELSE low END AS low,
    CASE WHEN volume <> 33 THEN close END AS close, volume, CAST(NULL AS DOUBLE) AS adj_close FROM bars
  UNION ALL SELECT ticker, date, open, high, low, close, volume, NULL FROM bars WHERE volume = 30),
k AS (SELECT *, count(*) OVER (PARTITION BY ticker, date) > 1 AS shared FROM u),
x AS (SELECT *, NOT coalesce(open > 0, false) AS b1, NOT coalesce(high > 0, false) AS b2, NOT coalesce(low > 0, false) AS b3, NOT coalesce(close > 0, false) AS b4,
  NOT coalesce(volume >= 0, false) AS b5, NOT coalesce(high >= greatest(open, close, low), false) AS b6, NOT coalesce(low <= least(open, close), false) AS b7,
  NOT coalesce(volume IS NULL OR volume BETWEEN 0 AND 100, false) AS b8 FROM k)"""
_NAMES = [*validation.PRICE_RULES, "volume_in_range", "unique_key"]
_FLAGS = [f"b{i}" for i in range(1, 9)] + ["shared"]
_BARS = ["ticker", "date", "open", "high", "low", "close", "volume", "adj_close"]
CHECKS = gate.Checks(
    rules=validation.PRICE_RULES, bounds={"volume": (0, 100)}, unique=("ticker", "date"), required=("close", "market"), optional=("adj_close",),
    types={"date": "date", "volume": "bigint"},
)


def _planted(spark, sf_dir):
    b = bars(spark, sf_dir).drop("market")
    bad = b.withColumns(
        {
            "open": F.when(F.col("volume") == 10, -1.0).otherwise(F.col("open")),
            "low": F.when(F.col("volume") == 20, F.col("high") + 1).otherwise(F.col("low")),
            "close": F.when(F.col("volume") != 33, F.col("close")),
        }
    )
    return bad.unionByName(b.where("volume = 30")).withColumn("adj_close", F.lit(None).cast("double")).select(*_BARS)


def _written(spark, sf_dir):
    return gate.checked_write(_planted(spark, sf_dir), f"{lake.scratch(spark)}/checked/{uuid.uuid4().hex}", CHECKS)


_ANY = " OR ".join(_FLAGS)


@register(
    "checked_write",
    f"""{_PLANTED}, n AS (SELECT count(*) AS n, count(*) FILTER ({_ANY}) AS bad, {", ".join(f"count(*) FILTER ({f}) AS r{i}" for i, f in enumerate(_FLAGS))},
      {", ".join(f"count(*) - count({c}) AS z{i}" for i, c in enumerate(_BARS))} FROM x)
    SELECT 'rows' AS "check", CAST(NULL AS VARCHAR) AS "column", n, n > 0 AS ok FROM n UNION ALL SELECT 'broken', NULL, bad, bad = 0 FROM n
    {" ".join(f"UNION ALL SELECT 'has', '{c}', 0, true" for c in [*_BARS[:5], "close"])} UNION ALL SELECT 'has', 'market', 1, false
    UNION ALL SELECT 'type', 'date', 0, true UNION ALL SELECT 'type', 'volume', 1, false
    {" ".join(f"UNION ALL SELECT '{r}', NULL, r{i}, r{i} = 0 FROM n" for i, r in enumerate(_NAMES))}
    {" ".join(f"UNION ALL SELECT 'nulls', '{c}', z{i}, {'true' if c == 'adj_close' else f'z{i} <= n * 0.5'} FROM n" for i, c in enumerate(_BARS))}
    UNION ALL SELECT 'incomplete', NULL, n, true FROM n""",
)
def checked_write(spark, sf_dir):
    """The report of a write of bars with planted faults, all of it from the write's own pass."""
    return _written(spark, sf_dir).report


@register(
    "quarantine",
    f"""{_PLANTED} SELECT ticker, date, open, volume, concat_ws(',', {", ".join(f"CASE WHEN {f} THEN '{r}' END" for f, r in zip(_FLAGS, _NAMES, strict=True))}) AS broken
    FROM x WHERE {_ANY}""",
)
def quarantine(spark, sf_dir):
    """The rows that broke a rule, as the write left them."""
    return _written(spark, sf_dir).broken.select("ticker", "date", "open", "volume", F.array_join("broken", ",").alias("broken"))


@register(
    "macro_rules",
    """WITH m AS (SELECT CAST(o_orderdate AS DATE) AS date, nullif(o_orderpriority, '5-LOW') AS indicator, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice END AS value,
      CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS source FROM orders)
    SELECT 'date_not_null' AS rule, count(*) - count(date) AS failed FROM m UNION ALL SELECT 'indicator_not_null', count(*) - count(indicator) FROM m UNION ALL
    SELECT 'value_not_null', count(*) - count(value) FROM m UNION ALL SELECT 'source_not_null', count(*) - count(source) FROM m""",
)
def macro_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("indicator"),
        F.when(F.col("o_custkey") % 7 > 0, F.col("o_totalprice")).alias("value"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("source"),
    )
    return validation.violations(rows, validation.MACRO_RULES)


_P = ["close", "volume", "open"]


def _states(spark, sf_dir):
    folder = f"{lake.scratch(spark)}/profiles/{uuid.uuid4().hex}"
    rows = bars(spark, sf_dir)
    profiles.store(profiles.daily(rows.where("date < DATE '1998-06-01'"), _P), folder)
    profiles.store(profiles.daily(rows, _P), folder)  # only the days that are not there
    return folder


def _exact(rows: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS nulls, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM {rows}"""
        for c in _P
    )


@register(
    "merged_profile",
    f"""{WITH}, r AS (SELECT * FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'), p AS ({_exact("r")})
    SELECT "column", n, nulls, round(mean, 5) AS mean, round(std, 5) AS std, round(min, 5) AS min, round(max, 5) AS max FROM p""",
)
def merged_profile(spark, sf_dir):
    """Four years profiled from the stored states of their days."""
    out = profiles.merged(profiles.stored(spark, _states(spark, sf_dir), "1996-01-01", "1999-12-31")).select("column", "n", "nulls", "mean", "std", "min", "max")
    return rounded(out, "mean", "std", "min", "max", digits=5)


@register(
    "stored_drift",
    f"""{WITH}, old AS (SELECT * FROM bars WHERE date < DATE '1998-06-01'), new AS (SELECT * FROM bars WHERE date >= DATE '1998-06-01'),
    b AS ({_exact("old")}), c AS ({_exact("new")}),
    l AS ({" UNION ALL ".join(f'''SELECT "column", '{s}' AS statistic, c.{s} AS current, b.{s} AS baseline FROM b JOIN c USING ("column")''' for s in ("mean", "std", "min", "max"))})
    SELECT "column", statistic, round(current, 5) AS current, round(baseline, 5) AS baseline, round(abs(current - baseline) / abs(baseline), 5) AS change,
      abs(current - baseline) / abs(baseline) > 0.1 AS drifted FROM l WHERE baseline <> 0""",
)
def stored_drift(spark, sf_dir):
    """Later days against the stored baseline of earlier ones."""
    out = profiles.drift(spark, _states(spark, sf_dir), (None, "1998-05-31"), ("1998-06-01", None))
    return rounded(out, "current", "baseline", "change", digits=5)
