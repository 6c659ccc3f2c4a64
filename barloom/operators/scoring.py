"""A registry of trained models, and rows scored by the model that was in force on their date.

A model is a row of the registry: when its knowledge ends, the columns it was trained on with their types and ranges, and where it
is saved. Rows are dealt to their models once, in one write; each model then reads its own rows. There is a row a model, so the
registry is read to the driver.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import learning, predictions, walkforward
from barloom.operators.lake import LakeTable, scratch
from barloom.operators.walkforward import Fold

REGISTRY = """model_id string, trained_on date, n_rows long, mode string, threshold double, path string,
features array<struct<name:string,type:string,low:double,high:double>>"""
#: Columns that are no features, whatever a model was trained on.
NOT_FEATURES = ("market", "ticker", "date", "candidate_action", "candidate_source", "candidate_score")


def register(
    numbered: DataFrame, features: list[str], label: str, folds: list[Fold], folder: str, settled: str | None = None,
    mode: str = "direction", threshold: float = 0.5, **params,
) -> DataFrame:
    """Trains a model for each fold and saves it in ``folder``; the registry, which holds these and any earlier ones there."""
    spark = numbered.sparkSession
    types = {f.name: f.dataType.simpleString() for f in numbered.schema}
    rows = []
    for fit in walkforward.fits(numbered, features, label, folds, settled, **params):
        start, end = fit.span[:2]
        known = numbered.where((F.col("i") >= start) & (F.col("i") < end) & F.col(label).isNotNull())
        ends = known.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in features for f, n in ((F.min, "low"), (F.max, "high"))]).first()
        name = f"{mode}_{fit.known_until:%Y%m%d}_{uuid.uuid4().hex[:8]}"
        path = f"{folder}/models/{name}"
        fit.model.write().save(path)
        about = [(c, types[c], ends[f"low_{c}"], ends[f"high_{c}"]) for c in features]
        rows.append((name, fit.known_until, fit.n_rows, mode, threshold, path, about))
    spark.createDataFrame(rows, REGISTRY).coalesce(1).write.mode("append").parquet(f"{folder}/registry")
    return read_registry(spark, folder)


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(f"{folder}/registry")


def fresh(registry: DataFrame, on: date, days: int, mode: str = "direction") -> str | None:
    """The id of the latest model that knows nothing after ``on`` and is at most ``days`` old; None where one has to be trained."""
    near = registry.where((F.col("mode") == mode) & F.col("trained_on").between(F.lit(on - timedelta(days)), F.lit(on)))
    best = near.orderBy(F.desc("trained_on"), F.desc("model_id")).first()
    return best and best.model_id


def in_force(dates: DataFrame, registry: DataFrame) -> DataFrame:
    """(date, model_id, trained_on) of each date: the model that was trained last before it; of models of one day the last by id."""
    models = registry.groupBy(F.date_add("trained_on", 1).alias("trained_on")).agg(F.max("model_id").alias("model_id"))
    found = predictions.model_as_of(dates.select("date").distinct(), models)
    return found.select("date", "model_id", F.date_sub("trained_on", 1).alias("trained_on"))


def aligned(frame: DataFrame, names: list[str]) -> list:
    """Columns of the trained names in their order, as doubles; those that the frame lacks, and values that are no number, are null."""
    return [(F.col(f"`{n}`").try_cast("double") if n in frame.columns else F.lit(None).cast("double")).alias(n) for n in names]


def score(frame: DataFrame, registry: DataFrame) -> DataFrame:
    """(ticker, date, probability, direction, model_id, trained_on, mode) of the rows of ``frame`` (ticker, date, features) that have a model
    in force and all of its columns; ``skew`` counts the others. ``market`` is kept where the frame has it."""
    spark = frame.sparkSession
    keys = [c for c in ("market", "ticker", "date") if c in frame.columns]
    dealt = f"{scratch(spark)}/scoring/{uuid.uuid4().hex}"
    tagged = frame.join(F.broadcast(in_force(frame, registry)), "date").where("model_id is not null")
    spread = F.pmod(F.xxhash64("ticker"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tagged.repartition("model_id", spread).write.partitionBy("model_id").parquet(dealt)
    from pyspark.ml import PipelineModel

    parts = []
    used = [r.model_id for r in in_force(frame, registry).select("model_id").distinct().collect()]  # a row a model
    for m in registry.where(F.col("model_id").isin([u for u in used if u])).collect():
        names = [f.name for f in m.features]
        rows = spark.read.schema(tagged.schema).parquet(dealt).where(F.col("model_id") == m.model_id)
        rows = rows.select(*keys, "trained_on", *aligned(frame, names)).dropna(subset=names)
        p = learning.probability(PipelineModel.load(m.path).transform(rows))
        direction = F.when(F.col("probability") >= m.threshold, "up").otherwise("down")
        made = p.select(*keys, "probability", direction.alias("direction"), "trained_on")
        parts.append(made.withColumns({"model_id": F.lit(m.model_id), "mode": F.lit(m.mode)}))
    if not parts:
        types = {f.name: f.dataType.simpleString() for f in frame.schema}
        empty = ", ".join(f"{k} {types[k]}" for k in keys)
        empty += ", probability double, direction string, trained_on date, model_id string, mode string"
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def skew(frame: DataFrame, registry: DataFrame) -> DataFrame:
    """(model_id, feature, kind, n_rows): what differs between the rows that a model scores and those it was trained on. Kinds: ``missing``
    and ``type`` of columns and ``extra`` columns, with all of the model's rows, ``null`` and ``outside`` (of the trained range) with the
    rows they concern. One aggregate by model for all of them."""
    spark = frame.sparkSession
    types = {f.name: f.dataType.simpleString() for f in frame.schema if f.name not in NOT_FEATURES}
    named = F.map_from_arrays(F.transform("features", lambda f: f["name"]), F.col("features"))
    about = registry.select("model_id", named.alias("_f"))
    tagged = frame.join(F.broadcast(in_force(frame, registry)), "date").where("model_id is not null").join(F.broadcast(about), "model_id")  # a row a model
    trained = lambda c: F.try_element_at("_f", F.lit(c))
    kinds = {}
    for c, kind in types.items():
        known, value = trained(c).isNotNull(), F.col(f"`{c}`").try_cast("double")
        kinds[c, "extra"] = ~known
        kinds[c, "type"] = known & (trained(c)["type"] != kind)
        kinds[c, "null"] = known & value.isNull()
        kinds[c, "outside"] = known & ~value.between(trained(c)["low"], trained(c)["high"])
    counts = tagged.groupBy("model_id").agg(F.count("*").alias("_n"), *[F.count_if(k).alias(f"{c}\x1f{kind}") for (c, kind), k in kinds.items()])
    long = counts.unpivot(["model_id", "_n"], [f"{c}\x1f{kind}" for c, kind in kinds], "_c", "n_rows")
    long = long.select("model_id", F.split_part("_c", F.lit("\x1f"), F.lit(1)).alias("feature"), F.split_part("_c", F.lit("\x1f"), F.lit(2)).alias("kind"), "n_rows")
    asked = registry.select("model_id", F.explode(F.transform("features", lambda f: f["name"])).alias("feature"))
    absent = asked.where(~F.col("feature").isin(list(types)) if types else F.lit(True)).join(counts.select("model_id", F.col("_n").alias("n_rows")), "model_id")
    absent = absent.select("model_id", "feature", F.lit("missing").alias("kind"), "n_rows")
    return long.where("n_rows > 0").unionByName(absent) if types else spark.createDataFrame([], absent.schema).unionByName(absent)


def score_and_store(table: LakeTable, frame: DataFrame, registry: DataFrame, schema_version: int = 3) -> int:
    """Scores, checks and merges predictions by ``table``'s keys; no write where any breaks a rule. ``table`` is partitioned by ``year``."""
    made = score(frame, registry).withColumns({"year": F.year("date"), "feature_schema_version": F.lit(schema_version)})
    return predictions.store(table, made)
