"""Models along time, overlapping windows, and predictions written behind their rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions import indicators
from barloom.operators import attribution, lake, learning, predictions, scoring, walkforward
from barloom.plans.learning_queries import _WINDOWS
from barloom.plans.market_queries import WITH, rounded
from barloom.plans.registry import register
from barloom.sources.bars import bars, table

FEATURES = ["return_1d", "return_5d", "bb_pct", "bb_width", "volume_ratio"]
#: The reference's model.
FULL = {"depth": 5, "rounds": 200, "rate": 0.05, "share": 0.9}
#: Small models: the fits of these queries show the folds, not the trees.
SMALL = {"depth": 2, "rounds": 2}


def _numbered(spark, sf_dir):
    rows = indicators.bollinger(indicators.returns(indicators.volumes(bars(spark, sf_dir))))
    rows = indicators.target(rows).withColumn("y", (F.col("next_day_return") > 0).cast("int"))
    rows = rows.withColumn("settled", F.lead("date").over(indicators.by_ticker(rows)))
    return walkforward.by_date(rows.select("market", "ticker", "date", "y", "settled", *FEATURES))


@register("walk_forward_metrics")
def walk_forward_metrics(spark, sf_dir):
    """Purged and embargoed folds over the dates, a model each, one row of means and deviations."""
    rows = _numbered(spark, sf_dir)
    folds = walkforward.purged_folds(rows, train=1000, test=400)
    return walkforward.summary(walkforward.fold_metrics(walkforward.predicted(rows, FEATURES, "y", folds, "settled", **SMALL)))


@register("parameter_grid")
def parameter_grid(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    folds = walkforward.purged_folds(rows, train=1000, test=700)
    return walkforward.grid_search(rows, FEATURES, "y", folds, {"depth": [1, 2], "rounds": [2], "rate": [0.1, 0.5]}, "settled")


@register("full_grid")
def full_grid(spark, sf_dir):
    """All 81 combinations of three depths, rounds, rates and shares over purged folds; the 27 that differ in more than rounds are fitted."""
    rows = _numbered(spark, sf_dir)
    folds = walkforward.purged_folds(rows, train=1000, test=700)
    grid = {"depth": [1, 2, 3], "rounds": [1, 2, 3], "rate": [0.05, 0.1, 0.3], "share": [0.6, 0.8, 1.0]}
    return walkforward.grid_search(rows, FEATURES, "y", folds, grid, "settled")


@register("retraining_backtest")
def retraining_backtest(spark, sf_dir):
    """Every date after the first 1000 predicted by a model that knows only dates before it."""
    rows = _numbered(spark, sf_dir)
    return walkforward.predicted(rows, FEATURES, "y", walkforward.retraining_folds(rows, train=1000, every=500), "settled", **SMALL)


@register("feature_importance")
def feature_importance(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    rows = rows.select("ticker", "date", "y", *FEATURES).dropna(subset=["y", *FEATURES])
    model = learning.train_classifier(learning.spread(rows, rows.count(), "ticker", "date"), FEATURES, "y", **FULL)
    return walkforward.importances(model, FEATURES, k=3)


@register(
    "concurrency",
    f"""{_WINDOWS} SELECT a.ticker, a.id, count(*) AS n_overlapping FROM w a JOIN w b ON a.ticker = b.ticker AND (a.id = b.id OR
      (a.end_idx >= a.start_idx AND b.end_idx >= b.start_idx AND a.start_idx <= b.end_idx AND b.start_idx <= a.end_idx
       AND b.id BETWEEN a.id - 12 AND a.id + 12)) GROUP BY a.ticker, a.id""",
)
def concurrency(spark, sf_dir):
    """Row sums of the matrix of overlapping windows."""
    b = bars(spark, sf_dir)
    rows = b.withColumn("id", (F.row_number().over(indicators.by_ticker(b)) - 1).cast("long"))
    end = F.col("id") + F.col("volume").cast("long") % 12 - 1
    return learning.overlapping(rows.select("ticker", "id", F.col("id").alias("start_idx"), end.alias("end_idx")))


@register(
    "threshold_precision",
    """WITH p AS (SELECT quality AS y, (doc_id * 7919) % 1000 / 1000.0 AS p FROM labels),
    c AS (SELECT t, count(*) FILTER (y = 1) AS tp, count(*) AS n FROM p JOIN (SELECT unnest(range(10, 91)) AS t) ON floor(p * 100) >= t GROUP BY t)
    SELECT t / 100.0 AS threshold, round(tp / n, 6) AS precision FROM c ORDER BY precision DESC, threshold LIMIT 1""",
)
def threshold_precision(spark, sf_dir):
    """The threshold of the best precision."""
    p = F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0
    out = learning.thresholds(table(spark, sf_dir, "labels").withColumn("p", p), "quality", "p", best="precision")
    return rounded(out.select("threshold", "precision").limit(1), "precision")


@register(
    "prediction_store",
    f"""{WITH}, p AS (SELECT ticker, date, (volume * 37 % 101 + 1) / 103.0 AS p, (volume * 53 % 97 + 1) / 99.0 AS q FROM bars),
    m AS (SELECT ticker, date, CASE WHEN year(date) >= 1997 THEN q ELSE p END AS probability FROM p)
    SELECT ticker, date, round(probability, 6) AS probability, CASE WHEN probability >= 0.5 THEN 'up' ELSE 'down' END AS direction FROM m""",
)
def prediction_store(spark, sf_dir):
    """All predictions checked against their rules and stored; those from 1997 on made again and merged."""
    b = bars(spark, sf_dir)
    old = b.select("market", "ticker", "date", ((F.col("volume") * 37 % 101 + 1) / 103.0).alias("probability"))
    new = b.where("year(date) >= 1997").select("market", "ticker", "date", ((F.col("volume") * 53 % 97 + 1) / 99.0).alias("probability"))
    store = lake.LakeTable(spark, f"{lake.scratch(spark)}/predictions/{uuid.uuid4().hex}", ["market", "ticker", "date", "year"], "year")
    for made in (old, new):
        rows = made.withColumn("direction", F.when(F.col("probability") >= 0.5, "up").otherwise("down"))
        predictions.store(store, rows.withColumn("year", F.year("date")))
    return rounded(store.read().drop("year", "market"), "probability")


def trained(spark, sf_dir):
    """(rows, registry): models trained again every 500 dates on the 1000 before."""
    rows = _numbered(spark, sf_dir)
    folder = f"{lake.scratch(spark)}/registry/{uuid.uuid4().hex}"
    return rows, scoring.register(rows, FEATURES, "y", walkforward.retraining_folds(rows, train=1000, every=500), folder, "settled", **FULL)


@register("scored_predictions")
def scored_predictions(spark, sf_dir):
    """All bars from the first model on, scored by the model in force on their date, stored behind their rules and read back."""
    rows, registry = trained(spark, sf_dir)
    store = lake.LakeTable(spark, f"{lake.scratch(spark)}/predictions/{uuid.uuid4().hex}", ["market", "ticker", "date", "year"], "year")
    scoring.score_and_store(store, rows.select("market", "ticker", "date", *FEATURES), registry)
    return store.read().drop("year", "model_id", "market")


@register("feature_skew")
def feature_skew(spark, sf_dir):
    """What each model in force was trained on against what it scores: one column gone, one of another type, one more."""
    rows, registry = trained(spark, sf_dir)
    asked = rows.select("ticker", "date", *FEATURES[:3], F.col("volume_ratio").cast("float").alias("volume_ratio"), F.col("i").alias("row_number"))
    models = registry.select("model_id", F.col("trained_on").alias("model_trained_on"))
    return scoring.skew(asked, registry).join(models, "model_id").drop("model_id")


@register("prediction_reasons")
def prediction_reasons(spark, sf_dir):
    """For each bar that the last model scores, what each feature adds to the margin, and the feature that moved it most."""
    rows, registry = trained(spark, sf_dir)
    last = registry.orderBy(F.desc("trained_on")).first()
    asked = rows.where(F.col("date") > F.lit(last.trained_on)).select("ticker", "date", *FEATURES)
    made = attribution.attributions(asked, last.path, [f.name for f in last.features], "ticker", "date")
    return attribution.reasons(made, 1, *made.columns).withColumnRenamed("feature", "most").drop("place", "value")


@register("shapley_ranking")
def shapley_ranking(spark, sf_dir):
    """The features whose values are largest over all bars, by the last model."""
    rows, registry = trained(spark, sf_dir)
    last = registry.orderBy(F.desc("trained_on")).first()
    return attribution.top_features(attribution.attributions(rows, last.path, [f.name for f in last.features]), 3)
