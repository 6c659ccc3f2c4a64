"""Features kept in a folder a month, and made anew only from where bars changed.

Each row carries its number in its series and the means that the next row goes on from. When bars of some tickers change, each such
series is taken up a few rows before the change (as many as the widest window reaches): the row there is the seed, its
means go on from the stored ones, and nothing before it is read. The months from the change on are written again, with the rows
of the other tickers as they were; earlier months are neither read nor written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import ewm, indicators
from barloom.functions.graph import Graph, Step
from barloom.operators.lake import stored

#: Rows that windows look back on: twenty and one before them, or those of a month.
REACH = 32
#: Months before a change in which a series' rows are looked for; a series too thin for them is made from its start.
LOOK_MONTHS = 24
#: So many bars are dealt to a task: rows grow wide in it and are sorted there several times, which stays in memory.
TASK_ROWS = 400_000
#: Values that a mean has more or fewer than its row's number.
_OFFSET = {"gain_mean": -1, "loss_mean": -1}

Enrich = Callable[[DataFrame | None], Sequence[Step]]


def _month(date: str | F.Column) -> F.Column:
    return F.date_format(date, "yyyy-MM")


class FeatureStore:
    """``enrich`` gives the enrichment steps for seeds (see ``enrich.steps``)."""

    def __init__(self, spark: SparkSession, folder: str, enrich: Enrich = lambda seeds: ()):
        self.spark, self.folder, self.enrich = spark, folder, enrich

    def _graph(self, seeds: DataFrame | None) -> tuple[Graph, list[str]]:
        graph = ewm.indicator_graph(seeds).extended(*self.enrich(seeds))
        return graph, [c for s in graph.steps for c in s.gives]

    def _means(self, columns: list[str]) -> list[str]:
        return [c for c in columns if c in (*ewm.STATES, "macd_signal") or "_ewma_" in c]

    def _made(self, bars: DataFrame, seeds: DataFrame | None, n_rows: int) -> DataFrame:
        """All columns of ``bars``, with their row numbers; with ``seeds`` (ticker, seed_date, row_no, obv, means), of what comes after those.

        Values by day are joined first, while rows are narrow; they are then dealt out by ticker once, in parts of ``TASK_ROWS``, as
        all that follows is windows of a ticker. ``n_rows``: how many ``bars`` there are, or more."""
        graph, names = self._graph(seeds)
        n_tasks = max(self.spark.sparkContext.defaultParallelism, math.ceil(n_rows / TASK_ROWS))
        bars = graph.run(bars, graph.tagged("daily")).repartition(n_tasks, "ticker")
        at = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
        if seeds is None:
            return graph.run(bars.withColumn("row_no", at.cast("long")), names)
        known = seeds.select("ticker", F.col("seed_date"), F.col("row_no").alias("_no"), F.col("obv").alias("_obv"))
        rows = bars.join(known, "ticker", "left").withColumn(ewm.SEED, F.coalesce(F.col("date") == F.col("seed_date"), F.lit(False)))
        rows = rows.withColumn("row_no", at + F.coalesce(F.col("_no") - 1, F.lit(0)))
        made = graph.run(rows.drop("seed_date", "_no"), names)
        return made.withColumn("obv", F.col("obv") + F.coalesce("_obv", F.lit(0.0))).drop("_obv", ewm.SEED)

    def rebuild(self, bars: DataFrame) -> None:
        self._write(self._made(bars, None, bars.count()))

    def _write(self, rows: DataFrame) -> None:
        """Replaces the months that ``rows`` has, once all are written: a write may read the months that it replaces. Each task writes its own
        rows of each month, so wide rows are neither staged nor shuffled."""
        rows = rows.withColumn("month_of", _month("date"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_of").parquet(self.folder)

    def read(self, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
        """The stored rows, of the months between only."""
        rows = self.spark.read.parquet(self.folder).withColumn("month_of", F.col("month_of").cast("string"))
        if first_month is not None:
            rows = rows.where(F.col("month_of") >= first_month)
        if last_month is not None:
            rows = rows.where(F.col("month_of") <= last_month)
        return rows

    def update(self, bars: DataFrame, changed: DataFrame) -> None:
        """Takes in ``changed`` (ticker, date), bars that were added, altered or removed in ``bars`` since the last run."""
        first = stored(changed.groupBy("ticker").agg(F.min("date").alias("changed_from")))
        earliest = first.agg(F.min("changed_from")).first()[0]
        if earliest is None:
            return
        look = self.spark.range(1).select(_month(F.add_months(F.lit(earliest), -LOOK_MONTHS))).first()[0]
        names = self._means(self._graph(None)[1])
        known = self.read(look).select("ticker", "date", "row_no", "obv", *names)
        before = known.join(first, "ticker").where(F.col("date") < F.col("changed_from"))
        last = before.groupBy("ticker").agg(F.max("row_no").alias("last_no"), F.max("date").alias("last_date"))
        seeds = before.join(last, "ticker").where((F.col("row_no") == F.col("last_no") - REACH) & (F.col("row_no") >= 15))
        seeds = seeds.select(
            "ticker", F.col("date").alias("seed_date"), "row_no", "obv", "last_date", *names,
            *[(F.col("row_no") + _OFFSET.get(n, 0)).alias(f"{n}__n") for n in names],
        )
        seeds = stored(seeds)  # a row a changed ticker, read by every mean

        spans = first.join(seeds.select("ticker", "seed_date", "last_date"), "ticker", "left")
        near = F.col("seed_date").isNull() | (F.col("date") >= F.col("seed_date"))
        rows = bars.join(spans.select("ticker", "seed_date"), "ticker").where(near).drop("seed_date")
        # the last row before the change has a new target; series without a seed are made whole
        made = self._made(rows, seeds, bars.count()).join(spans.select("ticker", "last_date"), "ticker")
        made = made.where(F.col("last_date").isNull() | (F.col("date") >= F.col("last_date"))).drop("last_date")
        whole = spans.where("last_date is null").join(bars.select("ticker", "date"), "ticker").agg(F.min("date")).first()[0]
        starts = [d for d in (whole, spans.agg(F.min(F.least("changed_from", "last_date"))).first()[0]) if d is not None]
        month = f"{min(starts):%Y-%m}"
        kept = self.read(month).drop("month_of").join(spans.select("ticker", "last_date"), "ticker", "left")
        replaced = spans.select("ticker").withColumn("_r", F.lit(True))
        kept = kept.join(replaced, "ticker", "left")
        kept = kept.where(F.col("_r").isNull() | (F.col("date") < F.col("last_date"))).drop("last_date", "_r")
        self._write(kept.unionByName(made.select(*kept.columns)))

    def load(
        self, start: str, end: str, tickers: list[str] | None = None, names: list[str] | None = None, least_rows: int = 60,
        z_scores: Sequence[str] = (),
    ) -> DataFrame:
        """Rows between two dates in order, of tickers whose series has enough rows by then, with close, volume, rsi and macd; ``date`` is a
        timestamp, as learning frames want it. Where nothing is stored yet, no rows of the same names."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            columns = names or [c for c in self._graph(None)[1] if c not in ewm.STATES]
            return self.spark.createDataFrame([], "ticker string, date timestamp" + "".join(f", `{c}` double" for c in columns))
        rows = self.read(start[:7], end[:7]).drop("month_of", *ewm.STATES)
        rows = rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        if tickers is not None:
            rows = rows.where(F.col("ticker").isin(tickers))
        enough = rows.groupBy("ticker").agg(F.max("row_no").alias("_n")).where(F.col("_n") >= least_rows).select("ticker")
        rows = rows.join(F.broadcast(enough), "ticker", "left_semi").drop("row_no")  # a row a ticker
        rows = rows.dropna(subset=["close", "volume", "rsi_14", "macd"]).withColumn("feature_schema_version", F.lit(ewm.VERSION))
        rows = indicators.zscore(rows, list(z_scores)) if z_scores else rows
        rows = rows.withColumn("date", F.col("date").cast("timestamp"))
        return (rows.select("ticker", "date", *names) if names else rows).orderBy("ticker", "date")


class Cached:
    """Results kept by name and arguments in a folder: the same call reads what the first one wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def load(self, name: str, make: Callable[..., DataFrame], *args) -> DataFrame:
        import hashlib

        path = f"{self.folder}/{name}-{hashlib.sha256(repr(args).encode()).hexdigest()[:16]}"
        fs, done = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(done):
            make(*args).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)
