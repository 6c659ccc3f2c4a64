"""Writes that check what they write, in one pass: rules, structure, profile and drift are observed while rows go out.

Each row is marked with the rules that it breaks; sound rows and broken ones go to two folders of one write, and the counts
are metrics that Spark gathers from the same tasks. So no check reads the rows before they are written, and the broken ones stay
to be looked at.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import validation

SOUND = "sound"
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


class Checks(NamedTuple):
    """What a dataset has to meet. ``rules`` and ``bounds`` judge rows, ``unique`` the rows that share a key, ``types`` columns by their
    simple type, ``required`` that columns are there and not without any value; ``optional`` columns may be empty or sparse."""

    rules: dict[str, str] = {}
    bounds: dict[str, tuple[float, float]] = {}
    unique: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    types: dict[str, str] = {}
    sparse: float = 0.5


class Outcome(NamedTuple):
    """``report``: (check, column, n, ok) of every check. ``profile``: statistics of the sound numbers, as ``validation.profile`` names them.
    ``sound`` and ``broken``: the rows as written, the latter with the names of what they break."""

    success: bool
    report: DataFrame
    profile: DataFrame
    sound: DataFrame
    broken: DataFrame


def structure(frame: DataFrame, checks: Checks, first: int = 5) -> dict[str, bool]:
    """Checks that need no row: required columns, the first five of them named apart, and types."""
    found = {f.name: f.dataType.simpleString() for f in frame.schema}
    out = {f"has {c}": c in found for c in (*frame.columns[:first], *checks.required)}
    return out | {f"type of {c}": found.get(c) == t for c, t in checks.types.items()}


def _marked(frame: DataFrame, checks: Checks) -> DataFrame:
    rules = checks.rules | validation.within({c: b for c, b in checks.bounds.items() if c in frame.columns})
    names = validation.broken(rules) if rules else F.array().cast("array<string>")
    if checks.unique:
        shared = F.count("*").over(Window.partitionBy(*checks.unique)) > 1
        frame = frame.withColumn("_shared", shared)
        names = F.concat(names, F.when(F.col("_shared"), F.array(F.lit("unique_key"))).otherwise(F.array().cast("array<string>")))
    return frame.withColumn("broken", names).drop("_shared").withColumn(SOUND, F.size("broken") == 0)


def _metrics(frame: DataFrame, checks: Checks, numbers: list[str]) -> dict[str, Column]:
    rules = [*checks.rules, *(f"{c}_in_range" for c in checks.bounds if c in frame.columns), *(["unique_key"] if checks.unique else [])]
    out = {"n": F.count("*"), "n_sound": F.count_if(F.col(SOUND))}
    out |= {f"rule {r}": F.count_if(F.array_contains("broken", r)) for r in rules}
    out |= {f"there {c}": F.count(f"`{c}`") for c in frame.columns}
    out["incomplete"] = F.count_if(F.exists(F.array(*[F.col(f"`{c}`").isNull() for c in frame.columns]), lambda x: x))
    for c in numbers:
        x = F.when(F.col(SOUND), F.col(f"`{c}`").cast("double"))
        out |= {f"{s} {c}": f(x) for s, f in _STATS.items()} | {f"known {c}": F.count(x), f"distinct {c}": F.approx_count_distinct(x)}
    return out


def checked_write(frame: DataFrame, folder: str, checks: Checks, baseline: DataFrame | None = None, threshold: float = 0.1) -> Outcome:
    """Writes ``frame`` under ``folder`` and checks it in the same job. ``baseline``: a stored profile, with which the rows' own is compared.

    Fails on an empty frame, on structure, on columns that are empty or sparse, and on broken rows; drift and incomplete rows are reported
    and fail nothing. What failed is told by the report; the sound rows are there in any case."""
    spark = frame.sparkSession
    numbers = [f.name for f in frame.schema if f.dataType.simpleString().startswith(_NUMBERS)]
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    fixed = structure(frame, checks)
    marked = _marked(frame, checks)
    metrics = _metrics(frame, checks, numbers)
    plain = {k: f"m{i}" for i, k in enumerate(metrics)}
    marked.observe(seen, *[m.alias(plain[k]) for k, m in metrics.items()]).write.mode("overwrite").partitionBy(SOUND).parquet(folder)
    got = {k: seen.get[a] for k, a in plain.items()}

    n = got["n"]
    rows: list[tuple[str, str | None, int, bool]] = [("rows", None, n, n > 0), ("broken", None, n - got["n_sound"], n == got["n_sound"])]
    rows += [(k.split(" ")[0], k.rsplit(" ", 1)[1], int(not ok), ok) for k, ok in fixed.items()]
    rows += [(k.split(" ", 1)[1], None, v, v == 0) for k, v in got.items() if k.startswith("rule ")]
    for c in frame.columns:
        nulls = n - got[f"there {c}"]
        status = "ok" if c in checks.optional or not n else "empty" if nulls == n else "sparse" if nulls > n * checks.sparse else "ok"
        rows.append(("nulls", c, nulls, status == "ok"))
    rows.append(("incomplete", None, got["incomplete"], True))
    profile = profile_frame(spark, numbers, got)
    if baseline is not None:
        moved = validation.drift(profile, baseline, threshold).where("drifted").select("column", "statistic").collect()  # four a column
        rows += [("drift", f"{r.column}.{r.statistic}", 1, True) for r in sorted(moved)]
    report = spark.createDataFrame(rows, "check string, column string, n long, ok boolean")
    schema = [F.col(f"`{c}`") for c in frame.columns]
    written = spark.read.schema(marked.schema).parquet(folder)
    return Outcome(
        all(r[3] for r in rows), report, profile, written.where(F.col(SOUND)).select(*schema), written.where(~F.col(SOUND)).select(*schema, "broken")
    )


def profile_frame(spark: SparkSession, numbers: list[str], got: dict) -> DataFrame:
    """Observed numbers as a profile: (column, n, nulls, n_unique, mean, std, min, max); distinct values are estimates."""
    rows = [
        (c, got["n_sound"], got["n_sound"] - got[f"known {c}"], got[f"distinct {c}"], *(got[f"{s} {c}"] for s in _STATS)) for c in numbers
    ]
    return spark.createDataFrame(rows, "column string, n long, nulls long, n_unique long, mean double, std double, min double, max double")


def partition_sound(spark: SparkSession, folder: str, day: str, required: list[str], on: str = "date") -> bool:
    """Whether a day's partition is there, has rows, and has the required columns, none of them without any value."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return False
    rows = spark.read.parquet(folder)
    if on not in rows.columns:
        return False
    rows = rows.where(F.col(on).cast("date") == F.lit(day).cast("date"))
    if any(c not in rows.columns for c in required):
        return False
    counts = rows.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in required]).first()
    return counts["_n"] > 0 and all(counts[c] for c in required)
