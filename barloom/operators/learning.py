"""Frames for machine learning: candidates, labels, weights, splits, metrics, and MLlib models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.indicators import by_ticker, full
from barloom.operators.lake import scratch


def candidates(bars: DataFrame, strategies: dict[str, tuple[int, float, float]]) -> DataFrame:
    """The strongest candidate of each ticker and date, be it traded in several markets. ``strategies``: name to (lookback, buy at, sell at), in percent off the mean."""
    found = []
    for rank, (name, (n, buy, sell)) in enumerate(strategies.items()):
        mean = full(bars, F.avg, "close", n)
        diff = (F.col("close") - mean) / F.nullif(mean, F.lit(0.0)) * 100
        action = F.when(F.col("d") >= buy, "BUY").when(F.col("d") <= sell, "SELL")
        found.append(
            F.struct(F.abs("d").alias("score"), F.lit(-rank).alias("rank"), action.alias("action"), F.lit(name).alias("source")).alias(f"c{rank}")
        )
        bars = bars.withColumn("d", diff).select("*", F.when(action.isNotNull(), found[-1]).alias(f"c{rank}")).drop("d")
    names = [f"c{r}" for r in range(len(strategies))]
    best = F.array_max(F.array_compact(F.array(*names)))
    return bars.withColumn("best", best).where("best is not null").groupBy("ticker", "date").agg(F.max("best").alias("best")).select(
        "ticker", "date", F.col("best.action").alias("candidate_action"),
        F.col("best.source").alias("candidate_source"), F.col("best.score").alias("candidate_score"),
    )


def triple_barrier(bars: DataFrame, vol: str, profit: float = 1.5, stop: float = 1.0, horizon: int = 10, floor: float = 0.005) -> DataFrame:
    """Which barrier the next ``horizon`` bars touch first: both_hit 0, profit 1, stop 0, else the sign at the end.

    The path is a bounded window frame of each bar, so no join is needed.
    """
    v = F.greatest(F.coalesce(F.col(vol), F.lit(0.0)), F.lit(floor))
    ahead = by_ticker(bars).rowsBetween(1, horizon)
    path = F.collect_list(F.struct("high", "low", "close")).over(ahead)
    rows = bars.withColumns({"_path": path, "upper_barrier_return": v * profit, "lower_barrier_return": v * stop})
    up = F.col("close") * (1 + F.col("upper_barrier_return"))
    down = F.col("close") * (1 - F.col("lower_barrier_return"))
    hits = F.transform(
        "_path",
        lambda p: F.when((p.high >= up) & (p.low <= down), "both_hit").when(p.high >= up, "profit").when(p.low <= down, "stop"),
    )
    first = F.get(F.filter(hits, lambda h: h.isNotNull()), 0)
    end = F.element_at("_path", -1).close
    rows = rows.withColumns({"_first": first, "_end": F.when(F.size("_path") > 0, end)})
    expired = F.when(F.col("_end") > F.col("close"), "time_profit").otherwise("time_loss")
    outcome = F.coalesce("_first", F.when(F.col("_end").isNotNull(), expired), F.lit("none"))
    return rows.withColumn("barrier_outcome", outcome).withColumn(
        "meta_label", F.when(F.col("barrier_outcome").isin("profit", "time_profit"), 1).otherwise(0)
    ).drop("_path", "_first", "_end")


def concurrency(windows: DataFrame, key: str = "ticker") -> DataFrame:
    """(``key``, at, until, c): how many windows (``key``, id, start_idx, end_idx) cover the places from ``at`` up to ``until``. One more at
    each start, one less after each end, and a running sum: as many rows as windows, however long they are."""
    valid = windows.where("end_idx >= start_idx")
    steps = valid.select(key, F.explode(F.array(F.struct(F.col("start_idx").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end_idx") + 1).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    w = Window.partitionBy(key).orderBy("at")
    net = steps.groupBy(key, "s.at").agg(F.sum("s.d").alias("d"))
    open_ = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return net.select(key, "at", F.lead("at").over(w).alias("until"), open_.alias("c"))


def uniqueness(windows: DataFrame, key: str = "ticker") -> DataFrame:
    """Mean of 1 / concurrency over each window (``key``, id, start_idx, end_idx); windows that end early get 0.

    Prefix sums of 1 / concurrency are kept where it changes, which is at starts and after ends only; the difference of two of them
    is a window's sum. No window is written out and none meets another."""
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce((F.col("until") - F.col("at")) * F.try_divide(F.lit(1.0), F.col("c")), F.lit(0.0))
    sums = concurrency(windows, key).select(key, "at", F.coalesce(F.sum(share).over(w), F.lit(0.0)).alias("s"))
    valid = windows.where("end_idx >= start_idx").select(key, "id", "start_idx", "end_idx")
    ends = valid.join(sums.select(key, F.col("at").alias("start_idx"), F.col("s").alias("_from")), [key, "start_idx"])
    ends = ends.join(sums.select(key, (F.col("at") - 1).alias("end_idx"), F.col("s").alias("_to")), [key, "end_idx"])
    mean = (F.col("_to") - F.col("_from")) / (F.col("end_idx") - F.col("start_idx") + 1)
    found = windows.join(ends.select(key, "id", mean.alias("w")), [key, "id"], "left")
    return found.withColumn("uniqueness", F.coalesce("w", F.lit(0.0))).drop("w")


def overlapping(windows: DataFrame, key: str = "ticker") -> DataFrame:
    """(``key``, id, n_overlapping): windows that share an index with each one, itself included: those that start by its end less those
    that end before its start, from two running counts and without pairs. Windows that end early share with themselves only."""
    valid = windows.where("end_idx >= start_idx").select(key, "id", "start_idx", "end_idx")
    of = lambda at, kind, started, ended: F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"), F.lit(started).alias("started"), F.lit(ended).alias("ended"))
    start, end = F.col("start_idx"), F.col("end_idx")
    # at one place: ends before it (their place is the one after), what a window asks at its start, starts, what it asks at its end
    points = F.array(of(end + 1, 0, 0, 1), of(start, 1, 0, 0), of(start, 2, 1, 0), of(end, 3, 0, 0))
    long = valid.select(key, "id", F.explode(points).alias("p")).select(key, "id", "p.*")
    w = Window.partitionBy(key).orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = long.withColumns({"_started": F.sum("started").over(w), "_ended": F.sum("ended").over(w)})
    n = F.max(F.when(F.col("kind") == 3, F.col("_started"))) - F.max(F.when(F.col("kind") == 1, F.col("_ended")))
    found = counted.groupBy(key, "id").agg(n.alias("n_overlapping"))
    early = windows.where("end_idx < start_idx").select(key, "id", F.lit(1).cast("long").alias("n_overlapping"))
    return found.unionByName(early)


def walk_forward(n_rows: Column | int, train: int = 252, test: int = 21, embargo: int = 5, horizon: int = 5) -> Column:
    """Array of splits: train from start to purged end, test after the gap, next start one test and embargo later."""
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    starts = F.sequence(F.lit(0), F.greatest(n - train - test, F.lit(0)), F.lit(test + embargo))
    splits = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("train_start"), (s + train - (horizon - 1)).alias("train_end"),
            (s + train).alias("test_start"), (s + train + test).alias("test_end"),
        ),
    )
    return F.when(n >= train + test, splits).otherwise(F.array().cast(_SPLITS))


_SPLITS = "array<struct<train_start:int,train_end:int,test_start:int,test_end:int>>"


def class_metrics(frame: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    counts = frame.agg(
        F.count_if((actual == 1) & (predicted == 1)).alias("tp"), F.count_if((actual == 0) & (predicted == 1)).alias("fp"),
        F.count_if((actual == 1) & (predicted == 0)).alias("fn"), F.count_if((actual == 0) & (predicted == 0)).alias("tn"),
    )
    return scores(counts)


def scores(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 of tp, fp, fn, tn; 0 where undefined."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": share(tp + tn, tp + fp + fn + tn),
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
        }
    )


def thresholds(frame: DataFrame, actual: str, probability: str, low: int = 10, high: int = 90, best: str = "f1") -> DataFrame:
    """Metrics at each threshold from ``low`` to ``high`` percent. Scores fall into percent bins first, so all thresholds
    share one aggregate of at most 102 rows; the ``best`` score first, then the lowest threshold."""
    bin_ = F.floor(F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1.0)) * 100).cast("int")
    bins = frame.groupBy(bin_.alias("b")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg")
    )
    steps = frame.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    above = F.col("b") >= F.col("t")
    counts = steps.join(F.broadcast(bins)).groupBy("t").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"),
    )
    return scores(counts).withColumn("threshold", F.col("t") / 100.0).drop("t").orderBy(F.desc(best), "threshold")


def class_weight(frame: DataFrame, actual: str) -> DataFrame:
    neg, pos = F.count_if(F.col(actual) == 0), F.count_if(F.col(actual) == 1)
    weight = F.when((neg == 0) | (pos == 0), 1.0).otherwise(neg / F.nullif(pos, F.lit(0)))
    return frame.agg(neg.alias("negatives"), pos.alias("positives"), weight.alias("weight"))


def time_split(frame: DataFrame, embargo: int = 5, share: float = 0.8, key: str = "ticker") -> DataFrame:
    """``part``: train up to the cut less the embargo, test from the cut on; rows between get null."""
    w = Window.partitionBy(key)
    rows = frame.withColumns({"_i": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count("*").over(w)})
    cut = F.floor(F.col("_n") * share)
    part = F.when(F.col("_i") < cut - embargo, "train").when(F.col("_i") >= cut, "test")
    return rows.withColumn("part", part).drop("_i", "_n")


def overlaps(windows: DataFrame, key: str = "ticker") -> DataFrame:
    """(``key``, id, other): each pair of windows (``key``, id, start_idx, end_idx) that share an index, once, and each window
    with itself. The later start lies in the other window, so places are joined with starts and not windows with windows."""
    valid = windows.where("end_idx >= start_idx")
    points = valid.select(key, "id", "start_idx", F.explode(F.sequence("start_idx", "end_idx")).alias("at"))
    starts = valid.select(key, F.col("id").alias("other"), F.col("start_idx").alias("at"))
    later = (F.col("at") > F.col("start_idx")) | (F.col("id") <= F.col("other"))
    pairs = points.join(starts, [key, "at"]).where(later).select(key, "id", "other")
    return pairs.unionByName(windows.where("end_idx < start_idx").select(key, "id", F.col("id").alias("other")))


#: So many training rows are dealt to a task; MLlib keeps and reads them again in the tasks that they come in.
FIT_ROWS = 500_000


def spread(rows: DataFrame, n_rows: int, *by: str) -> DataFrame:
    """``rows``, dealt out by ``by`` to more tasks where theirs would get more than ``FIT_ROWS`` of ``n_rows``."""
    n = math.ceil(n_rows / FIT_ROWS)
    return rows.repartition(n, *by) if n > rows.rdd.getNumPartitions() else rows


def train_classifier(
    frame: DataFrame, features: list[str], label: str, weight: str | None = None, depth: int = 3, rounds: int = 10,
    rate: float = 0.1, share: float = 1.0, held_out: str | None = None,
):
    """A gradient-boosted pipeline model: vector, trees. ``share`` of the rows makes each tree. ``held_out``: boolean column of the
    rows that are not trained on and end the rounds where their error stops falling."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # every tenth round's errors are kept there, as each round's follow from the one before
        context.setCheckpointDir(f"{scratch(frame.sparkSession)}/fits")
    trees = GBTClassifier(labelCol=label, featuresCol="features", maxDepth=depth, maxIter=rounds, stepSize=rate, subsamplingRate=share, seed=42)
    if weight:
        trees = trees.setWeightCol(weight)
    if held_out:
        trees = trees.setValidationIndicatorCol(held_out)
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[vector, trees]).fit(frame.where(F.col(label).isNotNull()))


def probability(scored: DataFrame) -> DataFrame:
    """A transformed frame with the probability of a rise as a number."""
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("probability", F.get(vector_to_array("probability"), 1))


def predict(model, frame: DataFrame) -> DataFrame:
    """ticker, date, direction and probability of a rise."""
    out = probability(model.transform(frame)).select("ticker", "date", "probability")
    return out.withColumn("direction", F.when(F.col("probability") >= 0.5, "up").otherwise("down"))


# What is kept of each training row.
AUDIT = (
    "ticker", "date", "candidate_action", "candidate_source", "candidate_score", "meta_label", "barrier_outcome", "upper_barrier_return",
    "lower_barrier_return", "vertical_barrier_days",
)


def write_audit(frame: DataFrame, path: str, horizon: int) -> None:
    """The rows that a model was trained on, beside the model: which candidate, which barrier, which label."""
    rows = frame.withColumn("vertical_barrier_days", F.lit(horizon)) if "vertical_barrier_days" not in frame.columns else frame
    rows.select(*AUDIT).write.mode("overwrite").parquet(path)
