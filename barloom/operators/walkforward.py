"""Models trained again along time: folds of dates over all tickers, their metrics, parameter grids, retraining.

A fold is a span of date numbers, so its rows are a filter and all tickers train together. There are as many fits as folds,
a number that follows from the dates and not from the rows; every fit runs on the cluster.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from datetime import date
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import attribution, learning
from barloom.operators.lake import scratch, stored

Fold = tuple[int, int, int, int]


def by_date(frame: DataFrame) -> DataFrame:
    """``frame`` with ``i``, its date's number from 0, written to the shared folder in order of ``i``: each
    fit reads the row groups of its own span. The frame is made once and written, before its dates are counted."""
    made = stored(frame)
    days = made.select("date").distinct()
    days = days.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date, whatever the tickers
    rows = made.join(F.broadcast(days), "date")
    n = max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(made.count() / learning.FIT_ROWS))
    return stored(rows.repartitionByRange(n, "i").sortWithinPartitions("i"))


def _n_dates(numbered: DataFrame) -> int:
    last = numbered.agg(F.max("i")).first()[0]
    return 0 if last is None else last + 1


def purged_folds(numbered: DataFrame, train: int = 252, test: int = 21, embargo: int = 5, horizon: int = 5) -> list[Fold]:
    """(train_start, train_end, test_start, test_end) with the ends outside; see ``learning.walk_forward``."""
    splits = learning.walk_forward(_n_dates(numbered), train, test, embargo, horizon)
    return [tuple(s) for s in numbered.sparkSession.range(1).select(splits.alias("s")).first().s]


def retraining_folds(numbered: DataFrame, train: int = 500, every: int = 63) -> list[Fold]:
    """A model each ``every`` dates, trained on the ``train`` dates before, for the dates up to the next one."""
    n = _n_dates(numbered)
    return [(s - train, s, s, min(s + every, n)) for s in range(train, n, every)]


def _between(start: int, end: int) -> Column:
    return (F.col("i") >= start) & (F.col("i") < end)


class Fit(NamedTuple):
    """A fold's model, the first date that it may score, and the last date whose rows it knows."""

    fold: int
    span: Fold
    opens: date
    known_until: date
    n_rows: int
    model: Any


class Known(NamedTuple):
    """The rows that a fold is trained on, with ``_weight``; the other fields are those of ``Fit``."""

    fold: int
    span: Fold
    opens: date
    known_until: date
    n_rows: int
    rows: DataFrame


def known(numbered: DataFrame, features: list[str], label: str, folds: list[Fold], settled: str | None = None) -> Iterator[Known]:
    """What each fold may be trained on; see ``fits``."""
    rows = numbered.where(F.col(label).isNotNull())
    starts = numbered.where(F.col("i").isin([f[2] for f in folds])).select("i", "date").distinct()
    opens = {r.i: r.date for r in starts.collect()}  # one row a fold
    for k, (start, end, first, last) in enumerate(folds):
        found = rows.where(_between(start, end)).dropna(subset=features)
        if settled:
            found = found.where(F.col(settled) <= F.lit(opens[first]))
        until = F.max(F.greatest("date", settled) if settled else F.col("date"))
        counts = found.agg(
            F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"), until.alias("until")
        ).first()
        n = counts.negatives + counts.positives
        if not n:
            continue
        weight = counts.negatives / counts.positives if counts.negatives and counts.positives else 1.0
        found = learning.spread(found.select("ticker", "date", label, *features), n, "ticker", "date")
        found = found.withColumn("_weight", F.when(F.col(label) == 1, weight).otherwise(1.0))
        yield Known(k, (start, end, first, last), opens[first], counts.until, n, found)


#: Fits that run side by side: each is many short jobs.
PARALLEL = 4


def fits(numbered: DataFrame, features: list[str], label: str, folds: list[Fold], settled: str | None = None, **params) -> Iterator[Fit]:
    """Each fold's model in order of the folds, ``PARALLEL`` of them fitted side by side; folds without training rows are left out.

    ``settled``: column with the date on which a label is known; rows whose label is known only after a fold's first test date
    are not trained on, as a ticker's next bar may come late. Rises weigh as much as falls in training."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    def fit(k: Known) -> Fit:
        return Fit(*k[:-1], learning.train_classifier(k.rows, features, label, weight="_weight", **params))

    with ThreadPool(max(1, min(PARALLEL, len(folds)))) as pool:
        yield from pool.imap(inheritable_thread_target(numbered.sparkSession)(fit), list(known(numbered, features, label, folds, settled)))


def predicted(
    numbered: DataFrame, features: list[str], label: str, folds: list[Fold], settled: str | None = None, **params
) -> DataFrame:
    """(ticker, date, actual, probability, prediction, fold, train_end) of every fold's test rows that have a label; see ``fits``."""
    rows = numbered.where(F.col(label).isNotNull())
    parts = []
    for fit in fits(numbered, features, label, folds, settled, **params):
        _, end, first, last = fit.span
        asked = rows.where(_between(first, last))
        answers = learning.probability(fit.model.transform(asked)).select("ticker", "date", "probability", F.col(label).cast("int").alias("actual"))
        parts.append(answers.withColumns({"fold": F.lit(fit.fold), "train_end": F.lit(end)}))
    if not parts:
        types = {f.name: f.dataType.simpleString() for f in numbered.schema}
        schema = f"ticker {types['ticker']}, date {types['date']}, probability double, actual int, fold int, train_end int"
        parts = [numbered.sparkSession.createDataFrame([], schema)]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def fold_counts(answers: DataFrame, *by: str) -> DataFrame:
    """Hits and misses of each fold, and of each value of ``by``."""
    hit = lambda a, p: F.count_if((F.col("actual") == a) & (F.col("prediction") == p))
    return answers.groupBy(*by, "fold").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))


def fold_metrics(answers: DataFrame, *by: str) -> DataFrame:
    """Counts and scores of each fold, and of each value of ``by``."""
    return learning.scores(fold_counts(answers, *by))


def summary(metrics: DataFrame, *by: str) -> DataFrame:
    """Folds, and mean and deviation over folds of each score; 0 without folds."""
    names = ("accuracy", "precision", "recall")
    each = {f"mean_{n}": F.avg(n) for n in names} | {f"std_{n}": F.stddev_pop(n) for n in names}
    return metrics.groupBy(*by).agg(F.count("fold").alias("folds"), *[c.alias(n) for n, c in each.items()]).fillna(0.0, list(each))


def grid_search(
    numbered: DataFrame, features: list[str], label: str, folds: list[Fold], grid: dict[str, list], settled: str | None = None, parallel: int = PARALLEL
) -> DataFrame:
    """(params, folds, mean and deviation of the scores, place) of all combinations of ``train_classifier``'s parameters.

    Combinations that differ in ``rounds`` only share their fits: the trees of few rounds are the first ones of more. A fold's rows are
    prepared and kept once for all fits on them, ``parallel`` of which run side by side; each is saved. The fold's test rows are then read
    once, for all of its models."""
    from multiprocessing.pool import ThreadPool

    from pyspark import StorageLevel, inheritable_thread_target

    spark = numbered.sparkSession
    folder = f"{scratch(spark)}/grid/{uuid.uuid4().hex}"
    rounds = sorted(set(grid.get("rounds", [10])))
    others = {k: v for k, v in grid.items() if k != "rounds"}
    combinations = [dict(zip(others, values, strict=True)) for values in itertools.product(*others.values())]
    rows = numbered.where(F.col(label).isNotNull())
    counted = []
    for k in known(numbered, features, label, folds, settled):
        kept = k.rows.persist(StorageLevel.MEMORY_AND_DISK)

        def tried(c: int, kept: DataFrame = kept, fold: int = k.fold) -> str:
            path = f"{folder}/{c}-{fold}"
            learning.train_classifier(kept, features, label, weight="_weight", rounds=rounds[-1], **combinations[c]).write().save(path)
            return path

        with ThreadPool(max(1, min(parallel, len(combinations)))) as pool:
            paths = pool.map(inheritable_thread_target(spark)(tried), range(len(combinations)), chunksize=1)
        kept.unpersist()
        # counts only, now: a row a combination
        for r in attribution.staged_counts(rows.where(_between(*k.span[2:])), paths, features, rounds, label).collect():
            chosen = combinations[r.model] | {"rounds": r.rounds}
            name = ", ".join(f"{g}={chosen[g]}" for g in grid)
            counted.append((name, k.fold, r.tp, r.fp, r.fn, r.tn))
    counts = spark.createDataFrame(counted, "params string, fold int, tp long, fp long, fn long, tn long")
    scores = summary(learning.scores(counts), "params")
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_accuracy"), "params")))


def importances(model, features: list[str], k: int = 10) -> DataFrame:
    """(place, feature, importance): the ``k`` features that lower the trees' impurity most; ties by name."""
    from pyspark.sql import SparkSession

    found = sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    rows = [(i + 1, f, v) for i, (f, v) in enumerate(found[:k])]
    return SparkSession.active().createDataFrame(rows, "place int, feature string, importance double")
