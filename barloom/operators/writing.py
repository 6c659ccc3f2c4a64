"""Writes behind checks: which keys a dataset has, whether its rows may be written, and typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import validation
from barloom.operators.lake import LakeTable

#: Datasets whose rows are not told apart by ticker and date.
KEYS: dict[str, list[str]] = {
    "macro": ["indicator", "date"],
    "news_sentiment": ["url"],
    "social_sentiment": ["ticker", "datetime", "source"],
    "raw_articles": ["source_type", "source_url"],
    "processed_articles": ["article_id", "ticker"],
    "sec_financials": ["ticker", "date", "filing_type"],
}


def keys_of(dataset: str) -> list[str]:
    return KEYS.get(dataset.rsplit("/", 1)[-1], ["ticker", "date"])


def refusals(rows: DataFrame, required: list[str], rules: dict[str, str] | None = None, unique: list[str] | None = None) -> list[str]:
    """Why rows may not be written: none at all, columns missing or without any value, broken rules. One pass over the rows for
    the columns and one for the rules, whatever their number."""
    absent = validation.missing_columns(rows, required)
    if absent:
        return [f"missing column {c}" for c in absent]
    counts = rows.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in required]).first()
    if not counts["_n"]:
        return ["no rows"]
    found = [f"no value in {c}" for c in required if not counts[c]]
    if rules or unique:
        broken = validation.violations(rows, rules or {"any": "true"}, unique).where("failed > 0").orderBy("rule").collect()
        found += [f"{r.rule}: {r.failed} rows" for r in broken]
    return found


def gated_upsert(
    table: LakeTable, rows: DataFrame, required: list[str], rules: dict[str, str] | None = None, unique: list[str] | None = None,
    dry_run: bool = False,
) -> bool:
    """Merges rows that nothing speaks against; whether they were, or in a dry run would be, written."""
    if refusals(rows, required, rules, unique):
        return False
    if not dry_run:
        table.upsert(rows)
    return True


def typed(frame: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its order and types; those that the frame lacks are null."""
    fields = frame.sparkSession.createDataFrame([], schema).schema.fields
    have = {c.lower(): c for c in frame.columns}
    cols = [F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None) for f in fields]
    return frame.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cols, fields, strict=True)])


def write_silver(table: LakeTable, rows: DataFrame, schema: str) -> int | None:
    """Rows with the columns of ``schema``, absent ones null, merged by the table's keys; rows without a whole key are left out; None, and no
    version, where nothing remains."""
    ready = typed(rows, schema).dropna(subset=table.keys)
    if ready.isEmpty():
        return None
    return table.upsert(ready)


def lower_names(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[c.lower() for c in frame.columns])


def write_new_dates(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Adds the dates that a folder partitioned by date does not hold yet; how many. Dates that are there stay as they are."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        there = spark.read.parquet(path).select(F.col("date").cast("date").alias("date")).distinct()
        rows = rows.join(there, "date", "left_anti")
    made = rows.select("date").distinct().count()
    if made:
        rows.repartition("date").write.mode("append").partitionBy("date").parquet(path)
    return made


def with_metadata(signals: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` as columns, all others that have a value as strings of one map ``metadata``."""
    rest = [c for c in signals.columns if c not in keep]
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in rest]
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return signals.select(*keep, F.map_from_entries(F.array_compact(F.array(*entries)) if entries else empty).alias("metadata"))
