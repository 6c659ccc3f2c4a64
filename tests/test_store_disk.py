"""What the feature store puts on disk: wide rows are neither shuffled nor staged."""

import os
import re

from pyspark.sql import functions as F

from barloom.operators import enrich, feature_store, lake



def _bars(spark):
    day = "date_add(date'2020-01-01', cast(id div 4 as int))"
    price = "100 + cast(id * 37 % 23 as double)"
    return spark.range(400).selectExpr("concat('A', id % 4) as ticker", f"{day} as date", *[f"{price} as {c}" for c in ("open", "high", "low", "close")], "cast(id % 9 as double) as volume")


def test_enriched_rows_are_dealt_by_ticker_once_and_not_shuffled_after(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feature_store, "TASK_ROWS", 40)
    bars = _bars(spark)
    news = bars.select("ticker", "date", F.lit(0.5).alias("sentiment_score"), F.lit("positive").alias("sentiment_label"))
    posts = bars.select("ticker", "date", F.lit("reddit").alias("source"), F.lit(1).alias("mention_count"), *[F.lit(0.1).alias(f"{n}score") for n in ("", "positive_", "negative_")])
    store = feature_store.FeatureStore(spark, f"file://{tmp_path}/s", lambda seeds: enrich.steps(news=news, posts=posts, seeds=seeds))
    plan = store._made(bars, None, bars.count())._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(.*", plan)
    assert exchanges[0].startswith("Exchange hashpartitioning(ticker#") and ", 10), REPARTITION_BY_NUM" in exchanges[0]
    assert sum("REPARTITION_BY_NUM" in e for e in exchanges) == 1


def test_a_rebuild_writes_its_rows_once(spark, tmp_path):
    root = lake.scratch(spark).removeprefix("file://")
    folders = lambda: {f for f in os.listdir(root) if f.startswith("features")} if os.path.isdir(root) else set()
    before = {f: set(os.listdir(f"{root}/{f}")) for f in folders()}
    store = feature_store.FeatureStore(spark, f"file://{tmp_path}/s")
    store.rebuild(_bars(spark))
    store.update(_bars(spark), _bars(spark).where("volume = 3").select("ticker", "date"))
    assert store.read().count() == 400
    assert {f: set(os.listdir(f"{root}/{f}")) for f in folders()} == before
